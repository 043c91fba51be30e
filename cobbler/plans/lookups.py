"""Existence checks of request keys against large tables.

``requests LEFT JOIN table`` makes the table the build side (a left outer join can
only build on its right), so a large table would be shuffled whole for every
batch. Instead the table is first reduced to the keys the requests name — a
semi join whose small side (the requests' distinct keys) AQE broadcasts when
measured small — and the requests are joined to that reduced result.

The semi join still shuffles the stored side before its size is known. With the session setting ``spark.cobbler.screenLookups``
(on in ``session.CLUSTER_CONF``) the stored scan is screened first: two byte tables, in which the cells of the wanted
keys' hashes are set, go into the plan as literals (a Bloom filter of two hashes), so that what is shuffled is
little more than what the semi join keeps. Collated keys (emails) are not screened, and a feed of more than ``SCREENED_KEYS``
keys, which would fill the tables, neither.

A check that most requests pass (:func:`count_known`) moves the distinct keys only: the keys whose check comes out otherwise than
"stored once" are few, and if so they are broadcast and the requests stay where they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import materialize

SCREEN = "spark.cobbler.screenLookups"
#: Cells of each table, and keys above which they would pass too much: at most one row in 64 of the others passes.
CELLS, SCREENED_KEYS = 1 << 20, 1 << 17
#: Rows of two numbers that are broadcast, once they are counted.
FEW = 1 << 17


def screened(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``table`` whose ``key`` may be among ``wanted``'s: all that are, few others."""
    hashes = wanted.select(F.xxhash64(key).alias("h")).distinct().limit(SCREENED_KEYS + 1).collect()
    if len(hashes) > SCREENED_KEYS:
        return table
    low, high = bytearray(CELLS), bytearray(CELLS)
    for r in hashes:
        low[r.h % CELLS] = 1
        high[(r.h >> 32) % CELLS] = 1
    h = F.xxhash64(key)
    passes = lambda cells, at: F.substring(F.lit(bytes(cells)), F.pmod(at, F.lit(CELLS)).cast("int") + 1, 1) == F.lit(b"\x01")
    return table.filter(passes(low, h) & passes(high, F.shiftright(h, 32)))


def keys_named(table: DataFrame, requests: DataFrame, key: str, cols: list[str] | None = None) -> DataFrame:
    """Rows of ``table`` (``key`` plus ``cols``) whose ``key`` some request names."""
    wanted = requests.select(key).where(F.col(key).isNotNull()).distinct()
    table = table.select(key, *(cols or []))
    kind = table.schema[key].dataType
    plain = getattr(kind, "collation", "UTF8_BINARY") == "UTF8_BINARY"      # hashes see bytes, collated keys compare otherwise
    if plain and table.sparkSession.conf.get(SCREEN, "false") == "true":
        wanted = wanted.withColumn(key, F.col(key).cast(kind))
        table = screened(table, wanted, key)
    return table.join(wanted, key, "left_semi")


def flag_known(requests: DataFrame, table: DataFrame, key: str, flag: str) -> DataFrame:
    """``requests`` plus a column ``flag``: true where ``key`` exists in ``table`` (its primary key), else null."""
    found = keys_named(table, requests, key).withColumn(flag, F.lit(True))
    return requests.join(found, key, "left")


def few(df: DataFrame, how: str = "table") -> DataFrame:
    """``df`` (a few numbers a row), made once and broadcast in joins if it has at most ``FEW`` rows, which is counted."""
    df = materialize(df, how)
    return F.broadcast(df) if df.count() <= FEW else df


def count_known(requests: DataFrame, table: DataFrame, key: str, n: str, usual: int, how: str = "table") -> DataFrame:
    """``requests`` plus a column ``n``: how often ``key`` is stored in ``table`` (0 for a null). Keys for which it is not
    ``usual`` (0 or 1) are looked up; only if these are many, the requests are shuffled. The result does not depend on ``usual``."""
    found = keys_named(table, requests, key).groupBy(key).agg(F.count(F.lit(1)).alias(n))
    if usual:
        wanted = requests.select(key).where(F.col(key).isNotNull()).distinct()
        found = wanted.join(found, key, "left").select(key, F.coalesce(n, F.lit(0)).cast("long").alias(n)).filter(F.col(n) != usual)
    other = F.when(F.col(key).isNull(), 0).otherwise(usual).cast("long")
    return requests.join(few(found, how), key, "left").withColumn(n, F.coalesce(n, other))
