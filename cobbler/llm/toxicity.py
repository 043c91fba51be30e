"""Toxicity from class-conditional Kneser-Ney models.

An expression is a word, read as its first ``STEM`` letters and then its ending. Each class (toxic, ordinary) has an
interpolated Kneser-Ney model: discounted counts of the stem, then of the word given its stem. Both classes back
off to one shared distribution, the continuation counts of the pooled corpus (how many different words a
stem begins, and evenly over those words), so what is rare in both differs by little more than a constant. Counts are by
document and distinct text, taken by Spark over all labelled rows outside the held-out fold.

Every stem and word is in the model, a table. How far an expression's classes are told apart is weighed by the evidence:
its probabilities mix the class' own with the pooled one, by the posterior that the classes differ in it by more than a
log-ratio of ``SHARED`` (``PRIOR`` before any count). Little evidence makes a small ratio, never none. A word outside
the model has its stem's ratio and that of an unseen ending, an unseen stem that of the backoff.

The score compares length-normalised log-likelihoods: the mean over all words of log P(toxic) - log P(ordinary).
Documents' words meet the model in a join; the ``HEAD`` most frequent words, which would crowd single keys, are
looked up before it. Training rows are scored without their own counts to set the threshold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, ready, store, whole_text
from .labelled import fold, with_label

STEM = 4
FOLDS, HELD_OUT = 5, 0
#: Log-ratio that classes may differ by and still share an estimate; prior that an expression's classes differ by more.
SHARED, PRIOR = 0.7, 0.01
#: Words looked up before the join (a matter of speed: all others are joined).
HEAD = 100_000
#: Partial counts a task holds before it passes them on.
HELD = 200_000
#: Scores are tabulated in bins of this width to find the threshold.
STEP = 0.002

_words = re.compile(r"[^\W\d_]+").findall


def expressions(text: str) -> list[str]:
    return _words(text.lower())


def word_counts(train: DataFrame) -> DataFrame:
    """``word, ordinary, toxic``: in how many distinct training texts of each class a word occurs."""
    def count(batches):
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def drain():
            words = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *[pa.array([c[w] for w in words], pa.int64()) for c in held]],
                                             ["word", "ordinary", "toxic"])
            for c in held:
                c.clear()
            return out
        for b in batches:
            for text, y in zip(b.column("text"), b.column("y")):
                held[y.as_py()].update(set(expressions(text.as_py())))
                if len(held[0]) + len(held[1]) > HELD:
                    yield drain()
        yield drain()
    return (train.select("text", "y").mapInArrow(count, "word string, ordinary long, toxic long")
            .groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")))


def distinct_texts(labelled: DataFrame) -> DataFrame:
    """One row per text and class, so that copies of a document teach once."""
    kept = labelled.groupBy(F.xxhash64("text").alias("key"), "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return labelled.join(kept, "doc_id", "left_semi")


def _evidence(t: Column, o: Column, nt: Column, no: Column) -> Column:
    """Log of the odds, from the counts alone, that the classes differ by more than ``SHARED``."""
    n = t + o
    apart = F.log(F.greatest(t, F.lit(1e-9)) / F.greatest(o, F.lit(1e-9)) * no / nt)
    odds = nt / no * F.exp(F.greatest(F.least(apart, F.lit(SHARED)), F.lit(-SHARED)))
    g = F.when(t > 0, t * F.log(t / (n * odds / (1 + odds)))).otherwise(0.0) + F.when(o > 0, o * F.log(o / (n / (1 + odds)))).otherwise(0.0)
    return F.when(n > 0, g - F.log(1 + n) / 2).otherwise(0.0)


def _mixed(pt: Column, po: Column, share: Column, evidence: Column) -> Column:
    """Log-ratio of the class probabilities, each mixed with the pooled one."""
    own = 1 / (1 + (1 - PRIOR) / PRIOR * F.exp(-F.least(evidence, F.lit(500.0))))
    pooled = (1 - own) * (share * pt + (1 - share) * po)
    return F.log((own * pt + pooled) / (own * po + pooled))


def _ratio(whole: dict[str, float], without: str | None = None) -> tuple[Column, Column]:
    """Log-ratios of a row's stem, and of its word given the stem; ``without`` one text of that class, if given."""
    o, t, so, st, to, tt, types = (F.col(c).cast("double") for c in ("ordinary", "toxic", "so", "st", "to", "tt", "types"))
    no, nt, seen_o, seen_t, all_types = (F.lit(whole[c]) for c in ("no", "nt", "seen_o", "seen_t", "types"))
    d = whole["d"]
    only = lambda c: F.when(c <= 0, 1.0).otherwise(0.0)
    if without == "toxic":
        t, st, nt = t - 1, st - 1, nt - 1
        tt, seen_t = tt - only(t), seen_t - only(st)
    elif without:
        o, so, no = o - 1, so - 1, no - 1
        to, seen_o = to - only(o), seen_o - only(so)
    if without:
        types, all_types = types - only(o + t), all_types - only(o + t)
    backoff = F.greatest(types, F.lit(0.5)) / F.greatest(all_types, F.lit(1.0))
    stem_p = lambda c, n, seen: F.greatest(c - d, F.lit(0.0)) / n + d * seen / n * backoff
    of_stem = _mixed(stem_p(st, nt, seen_t), stem_p(so, no, seen_o), nt / (nt + no), _evidence(st, so, nt, no))
    word_p = lambda c, n, seen: F.greatest(c - d, F.lit(0.0)) / n + d * seen / n / (types + 1)
    of_word = _mixed(word_p(t, st, tt), word_p(o, so, to), st / (st + so), _evidence(t, o, st, so))
    return (F.when((nt > 0) & (no > 0), of_stem).otherwise(0.0), F.when((types > 0) & (st > 0) & (so > 0), of_word).otherwise(0.0))


class Model(NamedTuple):
    """``words``: word and its log-ratio, whole and without one text of class 0 or 1. ``stems``: stem, its own log-ratio and
    that of its unseen words. ``head``: the most frequent rows of ``words``. ``unseen``: the log-ratio of an unseen stem."""
    words: DataFrame
    stems: DataFrame
    head: dict[str, tuple[float, float, float]]
    unseen: float


def fit(counts: DataFrame) -> Model | None:
    """The model of all stems and words of ``counts``; none if a class has no words."""
    words = store(counts.withColumn("stem", F.substring("word", 1, STEM)))
    stems = store(words.groupBy("stem").agg(
        F.sum("ordinary").alias("so"), F.sum("toxic").alias("st"), F.count("*").alias("types"),
        F.count(F.when(F.col("ordinary") > 0, 1)).alias("to"), F.count(F.when(F.col("toxic") > 0, 1)).alias("tt")))
    total = stems.agg(F.sum("so"), F.sum("st"), F.sum("types"), F.count(F.when(F.col("so") > 0, 1)), F.count(F.when(F.col("st") > 0, 1)),
                      F.count("*")).first()
    if not total[0] or not total[1]:
        return None                                         # nothing to compare
    once, twice = words.agg(*[F.count(F.when(F.col("ordinary") + F.col("toxic") == k, 1)) for k in (1, 2)]).first()
    whole = dict(zip(("no", "nt", "types", "seen_o", "seen_t"), map(float, total)))
    whole["d"] = once / (once + 2 * twice) if once else 0.5          # the usual estimate of the discount
    rows = bounded(stems, total[5])
    of_words = store(words.join(rows, "stem").select(
        "word", (F.col("ordinary") + F.col("toxic")).alias("n"), sum(_ratio(whole)).alias("r"),
        sum(_ratio(whole, "ordinary")).alias("r0"), sum(_ratio(whole, "toxic")).alias("r1")))
    nothing = {"ordinary": F.lit(0), "toxic": F.lit(0)}
    own, ending = _ratio(whole)
    of_stems = store(stems.withColumns(nothing).select("stem", own.alias("own"), (own + ending).alias("unseen")))
    none = {c: F.lit(0) for c in ("ordinary", "toxic", "so", "st", "to", "tt", "types")}
    unseen = stems.limit(1).select("stem").withColumns(none).select(own).first()[0]
    head = {x[0]: tuple(x[1:]) for x in of_words.orderBy(F.desc("n"), "word").limit(HEAD).select("word", "r", "r0", "r1").collect()}
    return Model(of_words.drop("n"), bounded(of_stems, total[5]), head, unseen)


def kneser_ney(counts: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log-ratios of all stems, and of all words, of a small table (to look at; scoring joins the tables)."""
    model = fit(counts)
    if model is None:
        return {}, {}
    return ({x[0]: x[1] for x in model.stems.select("stem", "own").collect()}, {x[0]: x[1] for x in model.words.select("word", "r").collect()})


def mean_ratios(docs: DataFrame, model: Model | None, columns: str, without_own: bool = False) -> DataFrame:
    """``columns`` of ``docs`` (their DDL) and ``x``, the mean log-ratio of the words (0 without words).

    ``without_own``: a row's own text, of class ``y``, is left out of the counts.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    if model is None:
        return docs.select(*names, F.lit(0.0).alias("x"))
    shared = docs.sparkSession.sparkContext.broadcast(model.head)        # at most HEAD entries

    def look_up(batches):
        """Per row the sum over head words and the number of words, then a row for each other word."""
        head = shared.value
        for b in batches:
            at, words, times, sums = [], [], [], []
            sides = [1 + y for y in b.column("y").to_pylist()] if without_own else [0] * b.num_rows
            for k, (text, side) in enumerate(zip(b.column("text"), sides)):
                ws = Counter(expressions(text.as_py()))
                other = [w for w in ws if w not in head]
                at += [k] * (1 + len(other))
                words += [None, *other]
                times += [ws.total(), *[ws[w] for w in other]]
                sums += [math.fsum(n * head[w][side] for w, n in ws.items() if w in head), *[0.0] * len(other)]
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n).take(at) for n in [*names, "row_"]], pa.array(words, pa.string()), pa.array(times, pa.int64()), pa.array(sums, pa.float64())],
                [*names, "row_", "word", "n", "part"])
    rows = (docs.select(*names, "text").withColumn("row_", F.monotonically_increasing_id())
            .mapInArrow(look_up, columns + ", row_ long, word string, n long, part double")
            # a row's first line meets no word: its key spreads these lines over the tasks
            .withColumn("key", F.coalesce("word", F.concat(F.lit(" "), F.col("row_").cast("string"))))
            .withColumn("stem", F.substring("word", 1, STEM)))
    known = F.when(F.col("y") == 1, F.col("r1")).otherwise(F.col("r0")) if without_own else F.col("r")
    ratio = F.coalesce(known, F.col("unseen"), F.lit(model.unseen))
    first = F.col("word").isNull()
    return (rows.join(model.words.withColumnRenamed("word", "key"), "key", "left").join(model.stems, "stem", "left")
            .groupBy("row_", *names).agg(F.sum(F.when(first, F.col("part")).otherwise(F.col("n") * ratio)).alias("sum_"),
                                         F.max(F.when(first, F.col("n"))).alias("n_"))
            .select(*names, F.when(F.col("n_") > 0, F.col("sum_") / F.col("n_")).otherwise(0.0).alias("x")))


def threshold(train_x: DataFrame) -> float:
    """The mean ratio that separates all training rows with the best F1 (a bounded table of bins)."""
    bins = train_x.groupBy(F.floor(F.col("x") / STEP).alias("bin"), "y").count().collect()
    bad = sum(r["count"] for r in bins if r["y"] == 1)
    best, at, hit, said = -1.0, 25, 0, 0
    for b in sorted({r["bin"] for r in bins if r["bin"] > 1}, reverse=True):
        for r in bins:
            if r["bin"] == b:
                said += r["count"]
                hit += r["count"] * r["y"]
        if said and 2 * hit / (said + bad) > best:
            best, at = 2 * hit / (said + bad), b
    return at * STEP


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Labels are read only outside the held-out fold, and no label, language, source or id enters a score. A text without
    words, or a null one, scores low; without labels of both classes every score is low. A null id is in no
    fold and has no label. Repeated rows are scored alike; an empty table gives an empty result.
    """
    ready(docs.sparkSession)
    train = with_label(docs, labels, "toxic").filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    model = fit(word_counts(distinct_texts(train)))
    cut = threshold(mean_ratios(train, model, "y int", without_own=True))
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    slope = 4 / cut
    z = F.greatest(F.least((F.col("x") - F.lit(cut)) * slope, F.lit(40.0)), F.lit(-40.0))
    return (mean_ratios(whole_text(docs), model, "doc_id long")
            .select("doc_id", held.alias("held_out"), (1 / (1 + F.exp(-z))).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
