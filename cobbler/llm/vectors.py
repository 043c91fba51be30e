"""Vector code compression: product codes whose codebooks are fitted exactly, with metric trees over the parts.

Vectors become integers, are cut into equal parts, and each part position has its own codebook, fitted by rounds of
assignment and update over all vectors. Rows are gathered into blocks of at most ``BLOCK``; each block's part vectors are
put into metric trees once (``balls.py``), which every round walks again: a ball whose list of candidate entries, inherited
from the ball above and shortened, has come down to one adds its cached sum and count. What a block gives to a round is
a sum and a count for each entry, added up by Spark; the driver sees the codebooks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balls import Balls, grow, owned
from .common import bounded, ready, store

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors of a block: its points and trees are a few megabytes, held by one task at a time.
BLOCK = 4096
#: Integer components stay below this, so that no squared distance of a vector leaves 64 bits.
LARGEST = 1 << 26
WIDEST = 1 << 10
BLOCKS = "ids binary, has_id binary, labels array<string>, points binary, trees array<array<binary>>"
SUMS = "part int, entry int, place int, n long, total long"
CODES = "vec_id long, label string, code string, error long"


def integers(vectors: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, label, x``: rows whose vector is there, not empty and finite throughout, as integers ``floor(scale * x)``."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col(vector).cast("array<double>").alias("v"))
    return (rows.filter("v IS NOT NULL AND size(v) > 0").filter(F.forall("v", finite))
            .select("vec_id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("x")))


def _checked(rows: DataFrame, parts: int) -> int:
    """The width of a part (0 without rows); all vectors must be alike in length, and their components in bounds."""
    least, most, highest = rows.agg(F.min(F.size("x")), F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    if least is None:
        return 0
    if least != most or least % parts or least > WIDEST:
        raise ValueError(f"vectors of {least} to {most} components can't be cut into {parts} equal parts (of {WIDEST} components at most)")
    if not 0 <= highest < LARGEST:
        raise ValueError(f"a component of {highest} as an integer; {LARGEST} and more would leave 64 bits")
    return least // parts


def _blocks(rows: DataFrame, parts: int, width: int) -> DataFrame:
    def build(ids: list, labels: list, x: list[np.ndarray]) -> pa.RecordBatch:
        points = np.concatenate(x)
        trees = [grow(points[:, p * width:(p + 1) * width]).pack() for p in range(parts)]
        has = np.array([i is not None for i in ids], np.uint8)
        return pa.RecordBatch.from_arrays(
            [pa.array([np.array([i or 0 for i in ids], np.int64).tobytes()], pa.binary()), pa.array([has.tobytes()], pa.binary()),
             pa.array([labels], pa.list_(pa.string())), pa.array([points.astype(np.int32).tobytes()], pa.binary()),
             pa.array([trees], pa.list_(pa.list_(pa.binary())))], ["ids", "has_id", "labels", "points", "trees"])

    def gather(batches):
        ids, labels, x = [], [], []
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                flat = some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts * width)
                room = BLOCK - len(ids)
                ids += some.column("vec_id")[:room].to_pylist()
                labels += some.column("label")[:room].to_pylist()
                x.append(flat[:room])
                if len(ids) == BLOCK:
                    yield build(ids, labels, x)
                    ids, labels, x = some.column("vec_id")[room:].to_pylist(), some.column("label")[room:].to_pylist(), [flat[room:]]
        if ids:
            yield build(ids, labels, x)
    return rows.mapInArrow(gather, BLOCKS)


def _walked(batches, books: list[np.ndarray], width: int) -> Iterator[tuple]:
    """Each block's row, its points, and for each part the tree and the part's points in the tree's order."""
    for b in batches:
        for k in range(b.num_rows):
            points = np.frombuffer(b.column("points")[k].as_py(), np.int32).reshape(-1, len(books) * width).astype(np.int64)
            trees = b.column("trees")[k]
            yield b.slice(k, 1), points, ((p, tree := Balls.unpack(trees[p].as_py(), width), points[tree.order, p * width:(p + 1) * width])
                                          for p in range(len(books)))


def _sums(blocks: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``part, entry, place, n, total``: how many parts each entry is nearest to, and their sums by component."""
    def add(batches):
        n = [np.zeros(len(book), np.int64) for book in books]
        total = [np.zeros((len(book), width), np.int64) for book in books]
        for _, _, parts in _walked(batches, books, width):
            for p, tree, points in parts:
                for entry, start, end, count, whole in owned(tree, points, books[p]):
                    if count is None:
                        np.add.at(n[p], entry, 1)
                        np.add.at(total[p], entry, points[start:end])
                    else:
                        n[p][entry] += count
                        total[p][entry] += whole
        rows = [(p, e, c, int(n[p][e]), int(total[p][e, c])) for p, book in enumerate(books) for e in range(len(book)) if n[p][e] for c in range(width)]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "place", "n", "total"), r)) for r in rows], schema=pa.schema(
            [("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.int64())]))
    return blocks.mapInArrow(add, SUMS).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def fit(blocks: DataFrame, books: list[np.ndarray], width: int, rounds: int) -> list[np.ndarray]:
    for _ in range(rounds):
        books = [book.copy() for book in books]
        sums = _sums(blocks, books, width).collect()        # a row for each component of the codebooks at most
        for r in sums:
            books[r["part"]][r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def _codes(blocks: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    def assign(batches):
        for b, points, parts in _walked(batches, books, width):
            n = len(points)
            codes, error = np.zeros((n, len(books)), np.int64), np.zeros(n, np.int64)
            for p, tree, own in parts:
                entry = np.empty(n, np.int64)
                for e, start, end, _, _ in owned(tree, own, books[p]):
                    entry[start:end] = e
                codes[tree.order, p] = entry
                error[tree.order] += ((own - books[p][entry]) ** 2).sum(axis=1)
            has = np.frombuffer(b.column("has_id")[0].as_py(), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b.column("ids")[0].as_py(), np.int64), pa.int64(), mask=has == 0), b.column("labels").flatten(),
                 pa.array(["".join(f"{c:02x}" for c in row) for row in codes.tolist()], pa.string()), pa.array(error, pa.int64())],
                ["vec_id", "label", "code", "error"])
    return blocks.mapInArrow(assign, CODES)


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error, label_error`` of every kept row, and the codebooks (``[entries, width]`` for each part).

    Rows with a null or empty vector, or one with null or non-finite components, are dropped. Each codebook starts as
    that part of the ``entries`` smallest kept ids (null ids after all others; rows of one id by their components; fewer
    rows give fewer entries). A round gives every part to its nearest entry, the lower one of equals, and moves each
    entry to the floor of its parts' mean; entries without parts stay. ``entries`` is 256 at most: a code has two hex
    digits for each part. Rows with a null label share one ``label_error``. Repeated rows get a row each; other columns
    are ignored; an empty table gives an empty result and no codebooks. Vectors of different lengths, and components of
    2^26 and more as integers, are refused with a ``ValueError``.
    """
    spark = vectors.sparkSession
    ready(spark)
    rows = integers(vectors, vector, scale)
    width = _checked(rows, parts)
    if not width:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    first = rows.select(F.col("vec_id").isNull().alias("last"), "vec_id", "x").orderBy("last", "vec_id", "x").limit(entries).collect()
    start = np.array([r["x"] for r in first], np.int64)
    blocks = store(_blocks(rows, parts, width))
    books = fit(blocks, [start[:, p * width:(p + 1) * width] for p in range(parts)], width, rounds)
    codes = store(_codes(blocks, books, width))
    of_label = store(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    of_label = bounded(of_label.withColumnRenamed("label", "label_"), of_label.count())
    return (codes.join(of_label, F.col("label").eqNullSafe(F.col("label_")))
            .select("vec_id", "label", "code", "error", "label_error")), books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()
