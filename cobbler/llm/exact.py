"""Exact dedup behind static binary-fuse filters.

An immutable snapshot (the documents up to a given id) is kept as exact buckets, one row per distinct
digest, with one binary-fuse filter per bucket, built once. Incoming digests are first grouped among
themselves, then screened by their bucket's filter: a negative is certainly new and joins nothing; a
positive joins the exact bucket. Every group of two or more rows has its texts compared byte for byte;
texts that share a digest without being equal are split into their own groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fuse
from .common import ascii_lower, bounded, parts_for, ready, shuffle_parts, store, whole_text

KEYS_PER_BUCKET = 250_000
FILTER = "bucket long, seed int, seg int, starts int, prints binary"


def digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def digests(docs: DataFrame, digest_of=digest) -> DataFrame:
    norm = ascii_lower(F.col("text"))
    return (whole_text(docs).select("doc_id", norm.alias("norm"))
            .select("doc_id", digest_of(F.col("norm")).alias("digest"), digest(F.col("norm")).alias("sha"))
            .withColumn("key", F.xxhash64("digest")))


def groups(rows: DataFrame) -> DataFrame:
    """One row per digest: the largest id and the number of rows (combined before the shuffle)."""
    return rows.groupBy("key", "digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))


def snapshot_filters(buckets: DataFrame) -> DataFrame:
    """One filter per bucket of at most about ``KEYS_PER_BUCKET`` distinct keys (hash-dealt)."""
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, seg, starts, prints = fuse.build(pdf["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "seed": [seed], "seg": [seg],
                             "starts": [starts], "prints": [prints]})
    return buckets.select("bucket", "key").groupBy("bucket").applyInPandas(one, FILTER)


def screen(incoming: DataFrame, filters: DataFrame) -> DataFrame:
    """Incoming distinct digests with ``maybe``: false only if the snapshot certainly lacks the key."""
    def test(inc: pd.DataFrame, flt: pd.DataFrame) -> pd.DataFrame:
        if len(flt) and len(inc):
            f = flt.iloc[0]
            maybe = fuse.contains(inc["key"].to_numpy(np.int64).view(np.uint64), int(f.seed), int(f.seg),
                                  int(f.starts), f.prints)
        else:
            maybe = np.zeros(len(inc), bool)
        return inc.assign(maybe=maybe)
    schema = "key long, digest binary, keep_id long, n long, bucket long, maybe boolean"
    return (incoming.select("key", "digest", "keep_id", "n", "bucket").groupBy("bucket")
            .cogroup(filters.groupBy("bucket")).applyInPandas(test, schema))


def deduplicate(docs: DataFrame, digest_of=digest, keys_per_bucket: int = KEYS_PER_BUCKET) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal if identical after lower-casing A-Z; a null text counts as empty. Of equal texts the
    row with the largest ``doc_id`` stays (null ids are smallest; rows that repeat that id all count as
    kept, since they are the same row). An empty table gives an empty result; columns other than
    ``doc_id`` and ``text`` are ignored. ``digest_of`` is a parameter so that tests can force collisions.
    """
    spark = docs.sparkSession
    ready(spark)
    rows = store(digests(docs, digest_of))
    total, split = rows.agg(F.count("*"), F.percentile_approx("doc_id", 0.5, 1000)).first()
    n_buckets = max(shuffle_parts(spark), parts_for(total, keys_per_bucket))
    bucket = F.pmod(F.col("key"), F.lit(n_buckets)).alias("bucket")
    is_new = F.coalesce(F.col("doc_id") > F.lit(split), F.lit(False))

    held = store(groups(rows.filter(~is_new)).select("*", bucket))
    arrived = screen(groups(rows.filter(is_new)).select("*", bucket), snapshot_filters(held))
    arrived = store(arrived)

    old = held.select("bucket", "key", "digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
    met = (arrived.filter("maybe").join(old, ["bucket", "key", "digest"])
           .select("key", "digest", F.greatest("keep_id", "old_id").alias("keep_id"),
                   (F.col("n") + F.col("old_n")).alias("n")))
    alone = arrived.filter("n > 1").unionByName(held.filter("n > 1").withColumn("maybe", F.lit(False)))
    multi = (alone.select("key", "digest", "keep_id", "n").unionByName(met)
             .groupBy("key", "digest").agg(F.max("keep_id").alias("keep_id"), F.max("n").alias("n")))
    multi = store(multi)

    members = store(rows.join(multi.select("key", "digest"), ["key", "digest"], "left_semi")
                    .select(F.col("doc_id").alias("id_")).distinct())
    suspects = bounded(members, members.count())
    texts = (whole_text(docs).join(suspects, F.col("doc_id").eqNullSafe(F.col("id_")), "left_semi")
             .select("doc_id", ascii_lower(F.col("text")).alias("norm"))
             .withColumns({"digest": digest_of(F.col("norm")), "sha": digest(F.col("norm"))})
             .withColumn("key", F.xxhash64("digest")))
    # equal bytes throughout a group: its least and greatest text agree (combined before the shuffle)
    unlike = store(texts.groupBy("key", "digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
                   .filter("a != b").select("key", "digest"))

    def joined(some: DataFrame) -> DataFrame:
        return some.join(multi, ["key", "digest"], "left").select(
            "doc_id", "sha", F.coalesce("keep_id", "doc_id").alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("group_size"))

    if unlike.isEmpty():
        out = joined(rows)
    else:   # a digest shared by unequal texts: those rows are grouped by the text itself
        split_rows = texts.join(unlike, ["key", "digest"], "left_semi")
        by_text = split_rows.groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = (joined(rows.join(unlike, ["key", "digest"], "left_anti"))
               .unionByName(split_rows.join(by_text, "norm").select("doc_id", "sha", "keep_id", "group_size")))
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))
