"""Rows written down, so that a long plan goes on from them and lost executors cost only their own tasks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """``df`` from the reliable checkpoint folder that the session names in ``spark.checkpoint.dir``.

    In local mode a session that names none gets a temporary one; on a cluster that is an error, as executors would not share it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        if not folder and context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-written-"))
    return df.checkpoint()
