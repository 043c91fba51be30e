"""A training-corpus pipeline of five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; its result is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobbler.llm import contamination, jaccard, lines, packing, quality
from cobbler.llm.common import store, table
from cobbler.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines, and lines one word apart from an earlier one, go.

    A document that loses lines and has no words left goes too; one that never had any stays. ``n_chars`` follows
    the text where it changed.
    """
    kept = lines.dedup_lines(docs).filter((F.col("__n_dropped") == 0) | F.col("text").rlike(lines.WORD))
    if "n_chars" in docs.columns:
        n = F.when(F.col("__n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        kept = kept.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, the document with the least id stays."""
    return jaccard.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality", quality_stage), ("line dedup", line_stage), ("n-gram jaccard", jaccard_stage),
          ("decontamination", benchmark_stage), ("packing", packing_stage)]

ORACLE_SQL = None       # the classifier and the token ids have no SQL; tests/llm compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
