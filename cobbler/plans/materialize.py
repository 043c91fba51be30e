"""Materialisation points for jobs whose intermediate result feeds several outputs.

``checkpoint`` writes the rows to the cluster's shared ``spark.checkpoint.dir``
and cuts the lineage: later stages read the files, a lost executor costs only
its own tasks, and the plans of the outputs stay small; it keeps the exact
partitioning (needed when partition boundaries carry meaning). ``table`` writes
a Parquet table into the same shared folder and reads it back: columnar, faster
to write and read, but partitioned anew by the scan. ``cache`` keeps the lineage
(recomputed on loss) and suits interactive use. ``none`` leaves the plan fully
lazy so Catalyst can prune it per output.

Tables made inside :func:`scratch` are dropped at its end, when the outputs that read them have been written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_MADE: list[list[str]] = []          # paths made inside each open scratch()

MODES = ("checkpoint", "table", "cache", "none")


def materialize(df: DataFrame, how: str = "checkpoint") -> DataFrame:
    if how not in MODES:
        raise ValueError(f"materialize mode must be one of {MODES}, got {how!r}")
    if how == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if how == "table":
        spark = df.sparkSession
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cobbler-tables/{uuid.uuid4().hex}"
        for made in _MADE[-1:]:
            made.append(path)
        df.write.parquet(path)
        return spark.read.parquet(path)
    if how == "cache":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that are materialised inside, at the end (also when the job fails)."""
    _MADE.append([])
    try:
        yield
    finally:
        for path in _MADE.pop():
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that Spark reads it from."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
