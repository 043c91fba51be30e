"""Best-fit packing planned on the histogram of lengths.

Documents are encoded once; only (document, piece, length) rows go on. The plan needs no documents, just
how many pieces have each length: best-fit decreasing over counts fills all sequences of the same free
space alike, so its work is bounded by the sequence length. Pieces take planned slots by joining on
their rank within their length; ranks are dealt by blocks, so no length meets in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, shuffle_parts, store, whole_text
from .pretokens import ids

MAX_TOKENS = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def encoded_pieces(docs: DataFrame, vocabulary: str, size: int = MAX_TOKENS, end: int = END) -> DataFrame:
    """Each document's ids plus ``end``; longer ones are cut so that only the first piece may be shorter."""
    ready(docs.sparkSession)

    tail = end.to_bytes(4, "little")

    def encode(batches):
        memo = ids(vocabulary)
        for b in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(b.column("doc_id"), b.column("text")):
                doc_id, raw = doc_id.as_py(), memo.ids(text.as_py()) + tail
                n = len(raw) // 4
                cuts = [0, *range(n % size or size, n + 1, size)]
                for piece, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    for col, v in zip(out, (doc_id, piece, a, z - a, zlib.crc32(raw[4 * a:4 * z]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32())] + [pa.array(c, pa.int64()) for c in out[2:]],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return whole_text(docs).mapInArrow(encode, PIECES)


def plan_slots(histogram: dict[int, int], size: int = MAX_TOKENS) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, from_rank, to_rank, first_sequence, per_sequence, offset)``.

    Piece ``r`` (from 0) of a length, with ``from_rank <= r < to_rank``, goes to sequence ``first_sequence +
    (r - from_rank) // per_sequence`` at ``offset + length * ((r - from_rank) % per_sequence)``. Sequences
    with the same free space are held as ranges, so the work depends on ``size`` and not on the counts.
    """
    plan, free, sizes = [], {}, []        # free space -> [(first sequence, number of them)]; its sorted keys
    opened = 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in free:
                insort(sizes, space)
            free.setdefault(space, []).append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):                       # nothing fits: open as many sequences as needed at once
                n = -(-left // (size // length))
                put(size, opened, n)
                opened += n
                continue
            space = sizes[at]
            first, n = free[space].pop()
            if not free[space]:
                del free[space]
                sizes.pop(at)
            per = space // length                      # best fit keeps filling the sequence it has begun
            full, rest = divmod(left, per)
            full = min(full, n)
            if full:
                plan.append((length, rank, rank + full * per, first, per, size - space))
                put(space - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left:                      # fewer than ``per`` remain: one sequence takes them
                plan.append((length, rank, rank + rest, first + full, per, size - space))
                put(space - rest * length, first + full, 1)
                rank, left, full = rank + rest, 0, full + 1
            put(space, first + full, n - full)
    return plan


def pack(docs: DataFrame, vocabulary: str, size: int = MAX_TOKENS, end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document.

    A null or empty text is the end token alone; null ids and repeated rows are packed like any other row;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = store(encoded_pieces(docs, vocabulary, size, end))
    blocks = 8 * shuffle_parts(spark)
    # a content hash deals repeated rows to one block; the row's own crc and start spread one document's pieces
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).alias("block")
    pieces = pieces.select("*", block)
    counts = store(pieces.groupBy("length", "block").agg(F.count("*").alias("n")))
    by_block = Window.partitionBy("length").orderBy("block")      # at most ``blocks`` rows for each length
    starts = counts.withColumn("before", F.sum("n").over(by_block) - F.col("n")).select("length", "block", "before")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(plan_slots(histogram, size), T.StructType([
        T.StructField(c, T.LongType()) for c in ("length_", "from_rank", "to_rank", "first_sequence", "per", "at")]))

    within = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (pieces.withColumn("row", F.row_number().over(within) - 1).join(starts, ["length", "block"])
              .withColumn("rank", F.col("before") + F.col("row")))
    # the plan's size is bounded by ``size``, whatever the number of documents
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("length_")) & (F.col("rank") >= F.col("from_rank"))
                         & (F.col("rank") < F.col("to_rank")))
    k = F.col("rank") - F.col("from_rank")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("first_sequence") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
                         (F.col("at") + F.col("length") * (k % F.col("per"))).cast("long").alias("offset"))
