"""Line dedup by a deletion-neighbourhood join, with DataFrame operations only.

A line is its words, lower-cased in A-Z. Two lines of at least ``MIN_WORDS`` words match if one word was
replaced, added or removed (word edit distance at most 1); shorter lines match only if equal. Of matching
lines the earliest stays: a line is dropped if any matching line stands earlier (by doc_id, then line).

Lines that could match share their first or last half, which screens out nearly all others. The rest
emit every variant with one word removed, hashed together with the place of removal: two lines with the
same variant at the same place differ in that word only, and a line equal to another's variant lacks
one of its words. So a minimum over each variant gives the earliest match, and no pairs are formed.
Each match found is then verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, fresh, store, whole_text

MIN_WORDS = 8
#: Sums of word hashes are kept below 2**61, so that adding two cannot overflow.
MODULUS = (1 << 61) - 1
WORD = r"[^\x20\x09-\x0D]+"
LINE = ["a", "b"]           # the two hashes that name a distinct line


def line_words(line: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(line), F.lit(WORD), F.lit(0))


def half_keys(w: Column, n: Column, min_words: int) -> Column:
    """Hashes of the first and last half, for a partner of as many words, of one more and of one less (if that is enough)."""
    def both(h: Column) -> list[Column]:
        return [F.xxhash64(F.lit("first"), F.slice(w, 1, h)), F.xxhash64(F.lit("last"), F.slice(w, -h, h))]
    shorter = (n % 2 == 0) & (n > min_words)
    half = F.floor(n / 2).cast("int")
    keys = F.array(*both(half))
    return F.when(shorter, F.concat(keys, F.array(*both(half - 1)))).otherwise(keys)


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per line: its place, its number of words, the hashes that name it and its half keys.

    Lines without words are filtered from the stored rows: a filter here would be pushed below the words and
    make them twice.
    """
    lines = (whole_text(docs).select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
             .select("doc_id", "text_key", "line_no", line_words(F.col("line")).alias("w"))
             .withColumn("n", F.size("w")))
    return lines.select("doc_id", "text_key", "line_no", "n", F.xxhash64("w").alias("a"), F.xxhash64(F.lit("b"), "w").alias("b"),
                        F.when(F.col("n") >= min_words, half_keys(F.col("w"), F.col("n"), min_words)).alias("halves"))


def _read_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of ``wanted`` distinct lines, read at their first place."""
    per_doc = store(wanted.select("first.doc_id", "first.text_key", F.struct("first.line_no", "a", "b", "n", "first").alias("at"))
                    .groupBy("doc_id", "text_key").agg(F.collect_list("at").alias("ats"))
                    .withColumnsRenamed({"doc_id": "id_", "text_key": "key_"}), wanted.count())
    texts = whole_text(docs).withColumn("text_key", F.xxhash64("text"))
    return (texts.join(bounded(per_doc, per_doc.count(), 200_000),
                       F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")))
            .select(F.split("text", "\n").alias("lines"), F.explode("ats").alias("at"))
            .select("at.a", "at.b", "at.n", "at.first", line_words(F.get("lines", F.col("at.line_no"))).alias("w"))
            .dropDuplicates(LINE))


def _variant_sums(w: Column) -> Column:
    """For each word of ``w`` the hash sum of the others, each weighed by its place among them.

    One pass: words before the removed one keep their place, words after it move up by one.
    """
    def h(word: Column, place: Column) -> Column:
        return F.pmod(F.xxhash64(word, place), F.lit(MODULUS))

    def add(x: Column, y: Column) -> Column:
        return (x + y) % F.lit(MODULUS)
    zero = F.lit(0).cast("long")
    both = F.transform(w, lambda word, i: F.struct(h(word, i).alias("at"), h(word, i - 1).alias("up")))
    after = F.aggregate(both, zero, lambda acc, z: add(acc, z["up"]))
    start = F.struct(zero.alias("before"), after.alias("after"), F.array().cast("array<bigint>").alias("sums"))

    def step(acc, z):
        rest = F.pmod(acc["after"] - z["up"], F.lit(MODULUS))
        return F.struct(add(acc["before"], z["at"]).alias("before"), rest.alias("after"),
                        F.concat(acc["sums"], F.array(add(acc["before"], rest))).alias("sums"))
    return F.aggregate(both, start, step, lambda acc: F.concat(acc["sums"], F.array(acc["before"])))


def variants(lines: DataFrame) -> DataFrame:
    """Every line without one word (``place`` of the removed one) and every line itself (``place`` = n), as hashed keys."""
    spread = lines.select("a", "b", "n", F.posexplode(_variant_sums(F.col("w"))).alias("place", "v"))
    m = F.when(F.col("place") == F.col("n"), F.col("n")).otherwise(F.col("n") - 1)
    return spread.select(F.xxhash64("v", m).alias("variant"), m.alias("m"),
                         F.when(F.col("place") == F.col("n"), -1).otherwise(F.col("place")).alias("place"), "a", "b")


def earliest_matches(lines: DataFrame, min_words: int) -> DataFrame:
    """For each line with a match: the place of the earliest matching line, verified."""
    every = variants(lines)
    met = every.groupBy("variant").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo != hi").select("variant")
    v = store(every.join(met, "variant").join(lines.select("a", "b", "first"), LINE))
    me = F.struct("first", "a", "b")
    same_place = (v.filter("place >= 0").groupBy("variant", "place").agg(F.min(me).alias("near"), F.count("*").alias("c"))
                  .filter("c > 1").drop("c"))
    # a line of m words that equals another without one of its words; both need ``min_words`` words
    crossing = (v.filter(F.col("m") >= min_words).groupBy("variant")
                .agg(F.min(F.when(F.col("place") < 0, me)).alias("shorter"), F.min(F.when(F.col("place") >= 0, me)).alias("longer"))
                .filter("shorter IS NOT NULL AND longer IS NOT NULL"))
    by_place = v.filter("place >= 0").join(same_place, ["variant", "place"]).select("a", "b", "near")
    by_shape = v.join(crossing, "variant").select(
        "a", "b", F.when(F.col("place") < 0, F.col("longer")).otherwise(F.col("shorter")).alias("near"))
    best = by_place.unionByName(by_shape).groupBy(*LINE).agg(F.min("near").alias("near"))
    other = lines.select(F.col("a").alias("near_a"), F.col("b").alias("near_b"), F.col("w").alias("near_w"), F.col("n").alias("near_n"))
    pairs = (best.select("a", "b", F.col("near.first").alias("near_first"), F.col("near.a").alias("near_a"), F.col("near.b").alias("near_b"))
             .join(lines, LINE).filter("near_first < first").join(other, ["near_a", "near_b"]))
    return pairs.filter(within_one_word(F.col("w"), F.col("n"), F.col("near_w"), F.col("near_n"))).select("a", "b", "near_first")


def within_one_word(w: Column, n: Column, v: Column, m: Column) -> Column:
    """Word edit distance at most 1: common first and last words make up all but one of the longer line."""
    def agree(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(at == 0, F.least(n, m)).otherwise(at - 1)
    return agree(w, v) + agree(F.reverse(w), F.reverse(v)) >= F.greatest(n, m) - 1


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``doc_id, text_key, line_nos``: the line numbers (from 0, ascending) that go, for rows that lose any."""
    if min_words < 2:
        raise ValueError("a line of one word has no halves: min_words must be 2 or more")
    occ = store(occurrences(docs, min_words)).filter("n > 0")
    place = F.struct("doc_id", "text_key", "line_no")
    distinct = store(occ.groupBy(*LINE).agg(F.min(place).alias("first"), F.count("*").alias("times"),
                                            F.first("n").alias("n"), F.first("halves").alias("halves")), occ.count())
    several = distinct.count()
    halves = distinct.filter("halves IS NOT NULL").select("a", "b", F.explode("halves").alias("half"))
    shared = (halves.groupBy("half").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).filter("lo != hi").select("half"))
    likely = halves.join(shared, "half").select("a", "b").distinct()
    wanted = store(distinct.join(likely, LINE).select("a", "b", "n", "first"), several)
    lines = store(_read_lines(docs, wanted))           # each row becomes as many as it has words: many files
    matches = store(earliest_matches(lines, min_words), lines.count())
    ruled = (distinct.select("a", "b", "first", "times").join(matches, LINE, "left")
             .filter("times > 1 OR near_first IS NOT NULL")
             .select("a", "b", F.least("first", "near_first").alias("stays")))
    gone = (occ.select("doc_id", "text_key", "line_no", "a", "b").join(ruled, LINE)
            .filter(~F.struct("doc_id", "text_key", "line_no").eqNullSafe(F.col("stays"))))
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line_no")).alias("line_nos"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` rebuilt from the lines that stay, plus ``__n_lines, __n_dropped``.

    Lines end at '\\n'; lines without words always stay. A null text stays null. Rows are told apart by id
    and text, so rows that repeat both share one result; null ids are earliest. Other columns, whatever
    their names, pass through. An empty table gives an empty result.
    """
    id_, key, gone_, lines_ = (fresh(c, docs) for c in ("__id", "__key", "__gone", "__lines"))
    gone = store(dropped_lines(docs, min_words).withColumnsRenamed({"doc_id": id_, "text_key": key, "line_nos": gone_}), docs.count())
    marked = docs.join(bounded(gone, gone.count(), 200_000),
                       docs["doc_id"].cast("long").eqNullSafe(F.col(id_))
                       & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(key)), "left")
    lines = F.split("text", "\n")
    stretches = F.transform(F.sequence(F.lit(0), F.size(gone_)), lambda k: F.slice(
        F.col(lines_), F.coalesce(F.get(gone_, k - 1), F.lit(-1)) + 2,
        F.coalesce(F.get(gone_, k), F.size(lines_)) - F.coalesce(F.get(gone_, k - 1), F.lit(-1)) - 1))
    rebuilt = F.when(F.col(gone_).isNull(), F.col("text")).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return (marked.withColumn(lines_, F.when(F.col("text").isNotNull(), lines))
            .withColumn("__n_lines", F.coalesce(F.size(lines_), F.lit(0)).cast("long"))
            .withColumn("__n_dropped", F.coalesce(F.size(gone_), F.lit(0)).cast("long"))
            .withColumn("text", rebuilt).drop(lines_, gone_, id_, key))
