"""Token counts with the whole-token shortcut (see ``pretokens.py``): one pass, no shuffle."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, whole_text
from .pretokens import counts, whole_tokens

LIMIT = 1024


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    Counts equal the tokenizers library's for the file (no tokens added, special strings in a text are
    one token). A null text counts as empty (0 tokens); null or repeated ids and any other columns do
    not matter, each row is counted by itself. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ready(spark)
    whole = spark.sparkContext.broadcast(tuple(whole_tokens(vocabulary)))     # bounded by the vocabulary file

    def count(batches):
        c = counts(vocabulary, whole.value)
        for b in batches:
            n = pa.array([c.count(t.as_py()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = whole_text(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return (rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
