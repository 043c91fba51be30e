"""Benchmark decontamination with DataFrame operations only.

The benchmark's word windows are hashed; a bit table over their hashes goes to every task and screens
each training window inside its row, so that only suspects leave the scan. Suspects carry their words
and meet the broadcast set of windows by hash and word by word. Texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, fresh, store, whole_text

WINDOW = 10
#: Cells of each screening table per benchmark window, and the bounds of a table's size.
CELLS, MIN_CELLS, MAX_CELLS = 16, 1 << 16, 1 << 26
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def starts(n: Column, width: int) -> Column:
    """1-based starts of the windows of ``width`` words among ``n``; none if there are fewer words."""
    return F.when(n >= width, F.sequence(F.lit(1), n - (width - 1))).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows (``w`` words, ``h`` hash, ``width``) with the ids of the items that hold them.

    An item of fewer than ``window`` words, but not none, is one window. Null ids read as ''."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                             words(F.coalesce("text", F.lit(""))).alias("words")).withColumn("n", F.size("words"))
    long = items.select("item", F.explode(starts(F.col("n"), window)).alias("i"), "words").select(
        "item", F.slice("words", F.col("i"), window).alias("w"))
    short = items.filter((F.col("n") > 0) & (F.col("n") < window)).select("item", F.col("words").alias("w"))
    return (long.unionByName(short).groupBy("w").agg(F.collect_set("item").alias("items"))
            .withColumn("h", F.xxhash64("w")).withColumn("width", F.size("w")))


def screens(windows: DataFrame, n: int) -> tuple[int, bytes, bytes]:
    """Two byte tables in which the cells named by the windows' hashes are 1 (bounded by the benchmark)."""
    cells = MIN_CELLS
    while cells < min(CELLS * n, MAX_CELLS):
        cells *= 2
    low, high = bytearray(cells), bytearray(cells)
    for (h,) in windows.select("h").distinct().toLocalIterator():
        low[h % cells] = 1
        high[(h >> 32) % cells] = 1
    return cells, bytes(low), bytes(high)


def suspects(ws: Column, n: Column, widths: list[int], cells: int, low: bytes, high: bytes) -> Column:
    """Windows of the row that pass both screens: ``array<struct<pos, h, w>>``."""
    def passes(h: Column, cell_table: bytes) -> Column:
        return F.substring(F.lit(cell_table), F.pmod(h, F.lit(cells)).cast("int") + 1, 1) == F.lit(b"\x01")

    def of_width(width: int) -> Column:
        hashed = F.transform(starts(n, width), lambda i: F.struct(
            i.alias("pos"), F.xxhash64(F.slice(ws, i, width)).alias("h")))
        hit = F.filter(hashed, lambda s: passes(s["h"], low) & passes(F.shiftright(s["h"], 32), high))
        return F.transform(hit, lambda s: F.struct(
            s["pos"].alias("pos"), s["h"].alias("h"), F.slice(ws, s["pos"], width).alias("w")))

    found = [of_width(width) for width in widths]
    return F.concat(*found) if found else F.array().cast("array<struct<pos:int,h:bigint,w:array<string>>>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    A word is hit if it lies inside any occurrence of a benchmark window; ``spans`` lists the occurrences
    as (first word from 1, width). A null text has no words; rows are told apart by id and text, so null
    or repeated ids do no harm; empty tables give no hits; other columns are ignored.
    """
    wins = store(item_windows(benchmark, window))
    n_wins = wins.count()
    widths = sorted(r["width"] for r in wins.select("width").distinct().collect())      # at most ``window`` values
    cells, low, high = screens(wins, n_wins)

    scanned = (whole_text(docs).select("doc_id", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("ws"))
               .withColumn("n", F.size("ws"))
               .select("doc_id", "text_key", F.col("n").cast("long").alias("n_words"),
                       suspects(F.col("ws"), F.col("n"), widths, cells, low, high).alias("found")))
    scanned = store(scanned)
    met = (scanned.filter(F.size("found") > 0).select("doc_id", "text_key", F.explode("found").alias("s"))
           .select("doc_id", "text_key", "s.pos", "s.h", "s.w")
           .join(bounded(wins, n_wins), ["h", "w"]))
    per_doc = met.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.struct("pos", "width")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    per_doc = per_doc.select(
        F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"), "spans", "items",
        F.size(F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(s["pos"], s["pos"] + s["width"] - 1))))).cast("long").alias("n_hit"))
    none = F.array().cast("array<string>")
    return (scanned.drop("found")
            .join(per_doc, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left")
            .withColumn("items", F.coalesce("items", none))
            .select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    F.col("n_hit").isNotNull().alias("contaminated"), "spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark window."""
    id_, key = fresh("__id", docs), fresh("__key", docs)
    found = store(contamination(docs, benchmark, window).filter("contaminated")
                  .select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct(), docs.count())
    return docs.join(bounded(found, found.count()),
                     docs["doc_id"].cast("long").eqNullSafe(F.col(id_))
                     & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(key)), "left_anti")
