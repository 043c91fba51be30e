"""Filter interaction audit by forward-backward path counting on the lattice of filter subsets.

A state is the set of filters applied so far, an edge adds one filter, an order of filters is a path from the empty
state to the full one. What an edge removes depends on its two ends alone, never on the order in which its start was
reached, so the audit needs one table of edges (2^k states, k edges out of each at most) and not one pass per order:

* forward counts say how many orders reach a state, backward counts how many ways lead on from it; their product
  over an edge is the number of orders that use the edge, the weight of its removals in the Shapley sum;
* the steps of a given order are the edges of its path.

Documents enter as counts: each has a mask of the filters it fails, and rows with equal mask and part are summed before
anything is shuffled further. So the lattice works on at most 2^k rows for each part.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready

LETTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3
COPY = 1 << LETTERS.index("E")
SCANNED = "doc_id long, part string, digest binary, mask int"
_UPPER, _SYMBOLS, _CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text whose words are split at a time.
STRETCH = 1 << 20


# ---- what a document fails

def count_words(raw: bytes) -> tuple[int, int]:
    """Number of words and of distinct words; a long text is split stretch by stretch, its distinct words are kept."""
    n, seen, at = 0, set(), 0
    while at < len(raw):
        cut = _SPACE.search(raw, at + STRETCH) if at + STRETCH < len(raw) else None
        end = cut.start() if cut else len(raw)
        words = raw[at:end].split()             # bytes split at \x20 and \x09-\x0D only
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def own_mask(raw: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    n, distinct = count_words(raw)
    points = len(raw.translate(None, _CONTINUED))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return ((n < LEAST_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 | (100 * upper > UPPER_PERCENT * points) << 2
            | (len(raw.translate(None, _SYMBOLS)) < len(raw)) << 3)


def scanned(docs: DataFrame, part: str) -> DataFrame:
    """``doc_id, part, digest, mask`` of each row: SHA-256 of the text, and the filters A to D it fails."""
    ready(docs.sparkSession)

    def scan(batches):
        for b in batches:
            raws = b.column("raw").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array([hashlib.sha256(r).digest() for r in raws], pa.binary()),
                 pa.array([own_mask(r) for r in raws], pa.int32())], ["doc_id", "part", "digest", "mask"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(scan, SCANNED)


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents of a part fail just the filters of ``mask``, and how many of
    these have a label quality=1 or toxic=1.

    Texts are equal when their SHA-256 is. The row with the smallest doc_id of a text passes E (all of them, if that
    id is repeated); a row without an id passes too, since no id is smaller, and lets no other fail. A null text counts
    as empty, a null part as the empty string; of several labels of one id any 1 counts; labels without an id, and
    null labels, count nothing. Other columns are ignored.
    """
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marked = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key"))
              .agg(one("quality").alias("good"), one("toxic").alias("toxic")).filter("good + toxic > 0").withColumn("no_id", F.lit(False)))
    # rows without an id join nothing; the text's hash deals them out
    rows = scanned(docs, part).select(F.coalesce("doc_id", F.xxhash64("digest")).alias("key"), F.col("doc_id").isNull().alias("no_id"),
                                      "part", "digest", "mask")
    ids = (rows.join(marked, ["key", "no_id"], "left").groupBy("key", "no_id", "part", "digest", "mask")
           .agg(F.count("*").alias("n"), F.max(F.coalesce("good", F.lit(0))).alias("good"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")))
    least = F.min(F.when(~F.col("no_id"), F.struct("key", "n", "good", "toxic")))
    same = ids.groupBy("digest", "part", "mask", "no_id").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        least.alias("first"))
    # a text has one row here for each part, so this window is as small as the number of parts
    same = same.withColumn("keeper", F.min("first.key").over(Window.partitionBy("digest")))
    stays = F.col("first.key") == F.col("keeper")
    passed = lambda c, weight=1: F.when(F.col("no_id"), F.col(c)).when(stays, F.col("first.n") * weight).otherwise(0)
    kept = {"n": passed("n"), "good": passed("good", F.col("first.good")), "toxic": passed("toxic", F.col("first.toxic"))}
    sides = F.array(F.struct(F.col("mask").alias("mask"), *[c.alias(k) for k, c in kept.items()]),
                    F.struct((F.col("mask").bitwiseOR(F.lit(COPY))).alias("mask"), *[(F.col(k) - c).alias(k) for k, c in kept.items()]))
    return (same.select("part", F.explode(sides).alias("s")).filter("s.n > 0").groupBy("part", "s.mask")
            .agg(*[F.sum(f"s.{k}").alias(k) for k in kept]))


# ---- the lattice

def path_counts(k: int) -> tuple[list[int], list[int]]:
    """For each subset of ``k`` filters (as bits): orders that reach it from the empty one, and that lead on to the full one."""
    full = (1 << k) - 1
    forward, backward = [0] * (full + 1), [0] * (full + 1)
    forward[0] = backward[full] = 1
    for state in range(full + 1):               # a subset's number is below that of any set holding it
        for f in range(k):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in range(full, -1, -1):
        for f in range(k):
            if state >> f & 1:
                backward[state & ~(1 << f)] += backward[state]
    return forward, backward


def _edges(k: int) -> list[tuple[int, int]]:
    return [(state, f) for state in range(1 << k) for f in range(k) if not state >> f & 1]


def _meetings(spark: SparkSession, k: int) -> DataFrame:
    """What a document of each mask does at each edge: arrives, is removed there, or fails there after it was removed."""
    rows = [(mask, state, f, int(not mask & state), int(not mask & state and mask >> f & 1), int(bool(mask & state and mask >> f & 1)),
             int(mask == 1 << f)) for mask in range(1 << k) for state, f in _edges(k)]
    return spark.createDataFrame(rows, "mask int, state int, filter int, arrives int, leaves int, late int, alone int")


def _paths(spark: SparkSession, letters: str) -> DataFrame:
    """The edges of each order's path."""
    rows = []
    for order in permutations(range(len(letters))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(letters[x] for x in order), step, state, f))
            state |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")


def _path_weights(spark: SparkSession, k: int) -> DataFrame:
    """How many orders use each edge."""
    forward, backward = path_counts(k)
    return spark.createDataFrame([(s, f, forward[s] * backward[s | 1 << f]) for s, f in _edges(k)], "state int, filter int, orders long")


def edges(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """``part, state, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, orders``: every edge of the
    lattice for every part. ``orders`` is how many orders use the edge."""
    spark, k = masks.sparkSession, len(letters)
    # the tables of the lattice depend on the number of filters alone: 2^k masks by k 2^(k-1) edges
    met = masks.join(F.broadcast(_meetings(spark, k)), "mask")
    total = lambda weight, c="n": F.sum(F.col(c) * F.col(weight)).cast("long")
    sums = met.groupBy("part", "state", "filter").agg(
        (total("arrives") - total("leaves")).alias("kept"), total("leaves").alias("removed"), total("late").alias("redundant"),
        total("alone").alias("unique_fails"), total("leaves", "good").alias("good_lost"), total("leaves", "toxic").alias("toxic_lost"))
    return sums.join(F.broadcast(_path_weights(spark, k)), ["state", "filter"])


def orders(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Per part, order of the filters and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``masks`` has ``part, mask, n, good, toxic``. A part without documents has no rows; an empty table gives an empty result.
    """
    table = edges(masks, letters)
    of_filter = Window.partitionBy("part", "filter")            # 2^(k-1) edges
    table = table.withColumn("shapley", F.sum(F.col("removed") * F.col("orders")).over(of_filter).cast("long")).drop("orders")
    return (table.join(F.broadcast(_paths(masks.sparkSession, letters)), ["state", "filter"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """All orders of the filters A to E over ``docs``, for each part: see :func:`failures` and :func:`orders`."""
    return orders(failures(docs, labels, part))
