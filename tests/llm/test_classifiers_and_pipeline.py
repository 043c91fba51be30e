"""Held-out accuracy of the classifiers, and the pipeline against plain Python stages."""

import zlib

import numpy as np
import pytest
from .conftest import SF

from cobbler.llm import quality, toxicity
from cobbler.llm.passages import passage_features

SF001 = "/root/testdata/sf0.01"


def tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


@pytest.mark.parametrize("operator,label,folds,held", [(toxicity.score_toxicity, "toxic", 5, 0), (quality.score_quality, "quality", 4, 2)])
def test_held_out_accuracy(spark, operator, label, folds, held):
    docs, labels = tables(spark, SF001)
    rows = operator(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.7))
    y = {r.doc_id: r[label] for r in labels.collect()}
    tried = [(y[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in y]
    assert np.mean([a == b for a, b in tried]) >= 0.93, tried
    bad = 1 if label == "toxic" else 0
    assert np.mean([p == bad for t, p in tried if t == bad]) >= 0.7
    # labels of the held-out fold do not matter
    from pyspark.sql import functions as F
    flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held, 1 - F.col(label)).otherwise(F.col(label)))
    again = {r.doc_id: r.score for r in operator(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in rows)


@pytest.mark.parametrize("operator", [toxicity.score_toxicity, quality.score_quality])
def test_edge_rows(spark, edge, empty, labels, no_labels, operator):
    for some in (labels, no_labels):
        rows = operator(edge, some).collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
        by = {}
        for r in rows:
            by.setdefault(r.doc_id, set()).add((r.held_out, round(r.score, 12)))
        assert len(by[1]) == 1 and {h for h, _ in by[None]} == {False}
    assert operator(empty, labels).count() == 0


def test_passages_cover_the_whole_text():
    x, per = passage_features(["", "a b", "word " * 1000, "é" * 1500])
    assert per.tolist() == [1, 1, 5, 3] and len(x) == 10 and np.isfinite(x).all()
    together, _ = passage_features(["some text", "word " * 1000, "x y z", ""])
    for k, t in ((0, "some text"), (1, "word " * 1000), (6, "x y z"), (7, "")):
        alone, per = passage_features([t])
        assert np.array_equal(together[k:k + per[0]], alone)        # a text's neighbours do not matter


def test_gradient_by_differences():
    r = np.random.default_rng(2)
    x, per, y = r.normal(size=(7, quality.DIM)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    m = quality.Attention(np.zeros(quality.DIM), np.ones(quality.DIM), 0.3)

    def loss():
        s, _ = m.forward(x, per)
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))
    g = m.gradient(x, per, y)
    for k in m.p:
        flat = m.p[k].reshape(-1)
        for at in r.integers(0, flat.size, 3):
            old, e = flat[at], 1e-5
            flat[at] = old + e
            up = loss()
            flat[at] = old - e
            down = loss()
            flat[at] = old
            assert abs((up - down) / (2 * e) - g[k].reshape(-1)[at]) < 1e-6


def test_kneser_ney_probabilities_sum_to_one(spark):
    """Each class' model is a distribution: stems sum to 1, and so do the words of a stem."""
    from pyspark.sql import functions as F
    rows = [("stupid", 0, 9), ("stupor", 3, 1), ("table", 40, 5), ("tablet", 9, 0), ("rare", 1, 0), ("rarely", 0, 1)]
    counts = spark.createDataFrame(rows, "word string, ordinary long, toxic long")
    stems, words = toxicity.kneser_ney(counts)
    assert set(stems) <= {"stup", "tabl", "rare"} and all(w[:4] in ("stup", "tabl", "rare") for w in words)
    assert toxicity.kneser_ney(counts.filter(F.col("toxic") < 0)) == ({}, {})


def test_rare_expressions_count(spark, monkeypatch):
    """Every stem and word is in the model and adds to a score, also one seen in a few toxic texts only."""
    common = ["table", "chair", "window", "garden", "river", "street"]
    texts = [(k, " ".join(common + [f"filler{'abcdefghij'[k % 10]}"])) for k in range(60)] + [(100 + k, " ".join(common) + " " + "awful " * 6) for k in range(12)]
    texts += [(200 + k, " ".join(common) + f" zorgle awful {'uvw'[k]}") for k in range(3)]
    texts += [(900, "table chair window zorgle"), (901, "table chair window garden"), (902, "table chair window zorgling")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i >= 100)) for i, _ in texts if i < 900], "doc_id long, quality int, toxic int")
    counts = toxicity.word_counts(docs.join(labels, "doc_id").withColumnRenamed("toxic", "y"))
    words = {r.word for r in counts.collect()}
    stems, ratios = toxicity.kneser_ney(counts)
    assert set(ratios) == words and set(stems) == {w[:toxicity.STEM] for w in words}
    assert ratios["zorgle"] > 0 and all(ratios.values())
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert scores[900] >= scores[902] > scores[901]
    monkeypatch.setattr(toxicity, "HEAD", 2)            # which words are looked up before the join changes nothing
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    assert again.keys() == scores.keys() and all(abs(again[i] - x) < 1e-9 for i, x in scores.items())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp
    from .test_similarity_operators import components_by_force
    from .test_text_operators import benchmark_by_force, lines_by_force
    docs, labels = tables(spark, SF)
    assert [n for n, _ in cp.STAGES] == ["quality", "line dedup", "n-gram jaccard", "decontamination", "packing"]
    steps = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, steps[-1], SF).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == docs.columns for s in steps[:5])
    rows = [{r.doc_id: r.text for r in s.collect()} for s in steps[:5]]
    predicted = {r.doc_id: r.predicted for r in quality.score_quality(docs, labels).collect()}
    assert rows[1] == {i: t for i, t in rows[0].items() if predicted[i] == 1}
    pairs = sorted(rows[1].items())
    gone = lines_by_force(pairs, 8)
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t in pairs}
    assert rows[2] == {i: t for i, t in left.items() if not gone.get((i, rows[1][i])) or t.split()}
    parts = components_by_force(sorted(rows[2].items()))
    assert rows[3] == {i: rows[2][i] for i, _, c in parts if i == c}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows[4] == {r[0]: rows[3][r[0]] for r in benchmark_by_force(sorted(rows[3].items()), bench) if not r[5]}
    packed = steps[5].collect()
    assert {r.doc_id for r in packed} == set(rows[4])
    assert {tuple(r)[:5] for r in packed} == {tuple(r)[:5] for r in cp.run(spark, SF).collect()}
