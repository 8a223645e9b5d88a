"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    A session that names none gets a temporary folder in local mode, where driver and tasks share it; elsewhere it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def raw(column: str) -> F.Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, at_least: int = 1) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of ``key`` from batches sorted by it; each but the last has ``at_least`` rows or more."""
    held: list[pd.DataFrame] = []
    rows, most = 0, at_least
    for batch in batches:
        held.append(batch.to_pandas())
        rows += len(held[-1])
        if rows < most:
            continue
        frame = pd.concat(held, ignore_index=True)
        values = frame[key].to_numpy()
        first = int(np.flatnonzero(values == values[-1])[0])  # the last key may go on in the next batch
        if first:
            yield frame.iloc[:first]
            frame = frame.iloc[first:].reset_index(drop=True)
        held, rows = [frame], len(frame)
        most = max(at_least, 2 * rows)
    if rows:
        yield pd.concat(held, ignore_index=True)
