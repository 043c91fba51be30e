"""Helpers shared by the text operators: reading, ASCII lower-casing, size-checked broadcasts, tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from ..session import ship_package

#: A side is broadcast only if a count of its rows stays within this bound (rows of a few dozen bytes).
BROADCAST_ROWS = 1_000_000
#: Rows of an Arrow batch: texts of some kilobytes, so a batch is a few megabytes.
ARROW_ROWS = 1000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` only; a null text counts as empty. Other columns, whatever their names, are dropped."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Where every character is ASCII the built-in ``lower`` does just that, and faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


#: Rows of a file of a stored table whose size has a known bound.
FILE_ROWS = 200_000


def store(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` once as a table in the cluster's shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs its own tasks, later stages read files. Where ``rows``, a bound of the number
    of rows, is known, there are no more files than it needs: a small result of a shuffle with many partitions
    would else be as many files.
    """
    if rows is not None:
        df = df.coalesce(parts_for(rows, FILE_ROWS))
    return materialize(df, "table")


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if ``rows`` (a counted size, or a proven bound) allows one; else let Spark shuffle."""
    return F.broadcast(df) if rows <= limit else df


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with underscores added until ``df`` has no column of that name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parts_for(rows: int, per_part: int) -> int:
    return max(1, math.ceil(rows / per_part))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ready(spark: SparkSession) -> None:
    """Before Arrow steps: executors' Python workers need this package, and batches of whole texts are kept small.

    The batch size is a session setting; it is lowered, never raised.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
