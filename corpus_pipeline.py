"""A training corpus in five stages: drop toxic documents, keep one of each near-duplicate group, cut repeated passages out,
draw documents by source, language and topic, and encode what is left.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet in the shared checkpoint folder and read again
as the next one's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tersely.llm.bpe import bpe_stage
from tersely.llm.common import shared_folder, table
from tersely.llm.mixing import mixing_stage
from tersely.llm.repeats import repeats_stage
from tersely.llm.simhash import simhash_stage
from tersely.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing to target weights", mixing_stage),
    ("bpe encoding", bpe_stage),
]

#: SQL can't express the fitted model, the components or the suffix arrays; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
