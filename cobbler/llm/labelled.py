"""Joining documents with their labels, and the fixed folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, whole_text


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def with_label(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, text, y`` of the labelled rows; of several labels of one id the largest counts, nulls do not."""
    y = (labels.filter(F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
         .agg(F.max(label).cast("int").alias("y")).filter("doc_id IS NOT NULL"))
    return whole_text(docs).join(bounded(y, labels.count()), "doc_id")
