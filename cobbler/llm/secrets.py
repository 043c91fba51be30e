"""Secret scans with DataFrame operations only: fixed patterns, and a battery of randomness tests.

One scan finds the fixed kinds and all other long tokens over code alphabets. A token's encoding is inferred
from its letters; under the hypothesis "drawn at random from that alphabet" three tests are taken: chi-squared
of the letter counts, runs above and below the middle, and lag-1 serial correlation. Their p-values are
combined (Fisher). Structured tokens (words, paths, counters) are rejected by Benjamini-Hochberg over all
tokens of the same encoding and length band, at false-discovery rate ``RATE``; what is not rejected, and
long enough for its alphabet that rejection was within reach, is reported as ``random``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store, whole_text

# The kinds' patterns and least lengths.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"       # a run from the first AKIA on; shorter runs hold no longer one
HEX = r"[0-9a-f]{16,}"              # a whole run
ASSIGN_LEAST = 12
KINDS = ["assign", "access", "hex", "random"]

#: '=' is padding only where the token ends, so the value of name=value starts a token of its own.
TOKEN = (r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?"
         r"|(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]{1,19}=+(?![A-Za-z0-9+/_=-])")
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding -> (pattern of the whole token, alphabet). The first that matches is taken; the last takes what is left.
ENCODINGS = {
    "hex": (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef"),
    "HEX": (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF"),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567"),
    "base36": (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", DIGITS + LOWER),
    "BASE36": (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", DIGITS + UPPER),
    "lower": (r"^[a-z]+$", LOWER),
    "upper": (r"^[A-Z]+$", UPPER),
    "letters": (r"^[A-Za-z]+$", UPPER + LOWER),
    "base62": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    "base64": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
    "base64url": (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", UPPER + LOWER + DIGITS + "-_"),
    "mixed": (r"^[0-9A-Za-z+/_-]+$", UPPER + LOWER + DIGITS + "+/-_"),
}
#: False-discovery rate of rejections; bits a token must hold; bins of -log10 p and their number.
RATE, LEAST_BITS, BINS, LAST_BIN = 0.05, 90.0, 100, 3000


def _located(text: Column, pattern: str, found: Column) -> Column:
    """(start, end) of the non-overlapping matches ``found``: what ``split`` leaves lies between them."""
    between = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(
        F.char_length(b).alias("gap"), F.char_length(m).alias("len")))
    nothing = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    located = F.aggregate(steps, start, lambda acc, s: F.struct(
        (acc["at"] + s["gap"] + s["len"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"),
                                              (acc["at"] + s["gap"] + s["len"]).alias("end")))).alias("out")),
        lambda acc: acc["out"])
    return F.when(F.size(found) > 0, located).otherwise(nothing)


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: located matches of each kind, and the tokens for the battery."""
    t = F.col("text")
    found = whole_text(docs).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text",
        F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(0)).alias("assign_m"),
        F.regexp_extract_all(t, F.lit(ACCESS), F.lit(0)).alias("access_m"),
        F.regexp_extract_all(t, F.lit(HEX), F.lit(0)).alias("hex_m"),
        F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0)).alias("token_m"))
    value = F.when(F.size("assign_m") > 0, F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)))
    located = found.select(
        "doc_id", "text_key", value.alias("value"), "token_m",
        *[_located(t, pattern, F.col(kind + "_m")).alias(kind)
          for kind, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("token", TOKEN))])
    long_enough = F.transform(F.filter(
        F.arrays_zip("assign", "value"), lambda z: F.char_length(z["value"]) >= ASSIGN_LEAST), lambda z: z["assign"])
    return located.select(
        "doc_id", "text_key", F.when(F.size("assign") > 0, long_enough).otherwise(F.col("assign")).alias("assign"), "access", "hex",
        F.when(F.size("token") > 0, F.arrays_zip("token", "token_m")).alias("tokens"))


def _two_sided(z: Column) -> Column:
    """2 * P(Z > |z|), by the logistic approximation of the normal tail (error below 2e-4)."""
    a = F.abs(z)
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.least(a * 1.5976 + a * a * a * 0.070565, F.lit(700.0))))


def battery(tokens: DataFrame) -> DataFrame:
    """``tokens`` (column ``tok``) with ``encoding``, ``n`` and ``bin`` (of -log10 of the combined p-value).

    Every token has an encoding; those of too few letters for their alphabet are left out.
    """
    body = F.regexp_replace("tok", "=+$", "")
    cases = [F.when(F.col("body").rlike(p), F.lit(name)) for name, (p, _) in ENCODINGS.items()]
    alphabet = reduce(lambda acc, e: acc.when(F.col("encoding") == e[0], F.lit(e[1][1])), ENCODINGS.items(), F)
    coded = (tokens.withColumn("body", body).withColumn("encoding", F.coalesce(*cases)).filter("encoding IS NOT NULL")
             .withColumns({"n": F.length("body"), "alphabet": alphabet}).withColumn("k", F.length("alphabet"))
             .filter(F.col("n") * F.log2("k") >= LEAST_BITS)
             .withColumn("chars", F.split("body", "")).withColumn("chars", F.filter("chars", lambda c: c != ""))
             .withColumn("v", F.transform("chars", lambda c: F.instr(F.col("alphabet"), c) - 1)))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    squares = F.aggregate(F.array_distinct("chars"), F.lit(0.0), lambda acc, c: acc + F.pow(
        F.col("n") - F.length(F.replace(F.col("body"), c, F.lit(""))), F.lit(2)))
    middle = (k - 1) / 2
    steps = F.zip_with(F.slice("v", 1, F.col("n") - 1), F.slice("v", 2, F.col("n") - 1), lambda x, y: F.struct(
        ((x - middle) * (y - middle)).alias("product"), F.when((x > middle) != (y > middle), 1.0).otherwise(0.0).alias("turn")))
    summed = coded.withColumns({
        "squares": squares,
        "high": F.size(F.filter("v", lambda x: x > middle)).cast("double"),
        "sums": F.aggregate(steps, F.struct(F.lit(0.0).alias("product"), F.lit(0.0).alias("turns")), lambda acc, s: F.struct(
            (acc["product"] + s["product"]).alias("product"), (acc["turns"] + s["turn"]).alias("turns")))})
    df = k - 1
    chi = k / n * F.col("squares") - n
    spread = F.lit(2.0) / (df * 9)
    z_chi = (F.pow(F.greatest(chi / df, F.lit(0.0)), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)
    mean = 2 * F.col("high") * (n - F.col("high")) / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when(var > 0, (F.col("sums.turns") + 1 - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(F.lit(20.0))
    z_serial = F.col("sums.product") / ((k * k - 1) / 12) / F.sqrt(n - 1)
    tested = summed.withColumns({"z_chi": z_chi, "z_runs": z_runs, "z_serial": z_serial})
    one_sided = F.when(F.col("z_chi") > 0, _two_sided(F.col("z_chi")) / 2).otherwise(1 - _two_sided(F.col("z_chi")) / 2)
    log_sum = -(F.log(one_sided) + F.log(_two_sided(F.col("z_runs"))) + F.log(_two_sided(F.col("z_serial"))))
    fisher = (F.col("l") - F.log(1 + F.col("l") + F.col("l") * F.col("l") / 2)) / F.log(F.lit(10.0))     # -log10 p
    return (tested.withColumn("l", log_sum)
            .withColumn("bin", F.least(F.floor(fisher * BINS).cast("int"), F.lit(LAST_BIN)))
            .withColumn("band", F.floor(F.log2("n")).cast("int"))
            .drop("body", "chars", "v", "squares", "high", "sums", "z_chi", "z_runs", "z_serial", "l", "alphabet", "k"))


def rejection_bins(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """Per encoding and length band the least bin that Benjamini-Hochberg rejects (no row: it rejects none).

    Counts come from all tokens; what is ordered is the bounded table of bins.
    """
    bins = tested.groupBy("encoding", "band", "bin").agg(F.count("*").alias("c"))
    up = Window.partitionBy("encoding", "band").orderBy(F.desc("bin"))
    ranked = bins.select("encoding", "band", "bin", F.sum("c").over(up.rowsBetween(Window.unboundedPreceding, 0)).alias("rank"),
                         F.sum("c").over(Window.partitionBy("encoding", "band")).alias("m"))
    p = F.pow(F.lit(10.0), -F.col("bin") / BINS)      # the largest p-value in the bin
    return (ranked.filter(p <= F.lit(rate) * F.col("rank") / F.col("m"))
            .groupBy("encoding", "band").agg(F.min("bin").alias("rejected_from")))


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start then kind. A ``random`` span is
    added only where it overlaps no span of a fixed kind. A null text counts as empty; rows are told apart
    by id and text; an empty table gives an empty result; other columns are ignored.
    """
    scanned = store(scan(docs))
    tokens = (scanned.filter("tokens IS NOT NULL").select("doc_id", "text_key", "assign", "access", "hex", F.explode("tokens").alias("z"))
              .select("doc_id", "text_key", F.concat("assign", "access", "hex").alias("base"),
                      F.col("z.token.start").alias("start"), F.col("z.token.end").alias("end"), F.col("z.token_m").alias("tok"))
              .filter(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))).drop("base"))
    tested = store(battery(tokens).select("doc_id", "text_key", "start", "end", "encoding", "band", "bin"))
    # at most one row per encoding and power of two
    bound = F.broadcast(rejection_bins(tested, rate))
    random = (tested.join(bound, ["encoding", "band"], "left").filter("rejected_from IS NULL OR bin < rejected_from")
              .groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("random"))
              .withColumnsRenamed({"doc_id": "id_", "text_key": "key_"}))
    joined = scanned.drop("tokens").join(
        random, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left")
    nothing = F.array().cast("array<struct<start:int,end:int>>")

    def named(k: int, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(kind), nothing), lambda s: F.struct(
            s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end")))

    def listed(kinds: list[str]) -> Column:
        spans = F.concat(*[named(k, kind) for k, kind in enumerate(kinds)])
        names = F.array(*map(F.lit, kinds))
        return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
            ":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return joined.select(
        "doc_id", *[F.size(k).cast("long").alias("n_" + k) for k in KINDS[:3]],
        F.sha2(listed(KINDS[:3]), 256).alias("base_sha256"), listed(KINDS).alias("spans"),
        F.coalesce(F.size("random"), F.lit(0)).cast("long").alias("n_random"))
