"""The filter audit against a plain simulation of every order."""

import random
import re
from itertools import permutations
from math import factorial

from cobbler.llm import audit

from .conftest import SF


def fails(rows):
    """The letters that each (doc_id, text) fails."""
    first = {}
    for i, t in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append({x for x, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t])) if bad})
    return out


def simulated(rows, labels):
    """``rows``: (doc_id, text, part)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    failed = fails([r[:2] for r in rows])
    out, shapley = {}, {}
    for order in permutations("ABCDE"):
        gone = {}
        for step, f in enumerate(order, 1):
            for part in {r[2] or "" for r in rows}:
                here = [k for k, r in enumerate(rows) if (r[2] or "") == part]
                now = [k for k in here if k not in gone and f in failed[k]]
                late = sum(k in gone and f in failed[k] for k in here)
                gone.update(dict.fromkeys(now, step))
                out[part, "".join(order), step] = (
                    sum(k not in gone for k in here), len(now), late, sum(failed[k] == {f} for k in here),
                    sum(rows[k][0] in good for k in now), sum(rows[k][0] in toxic for k in now))
                shapley[part, f] = shapley.get((part, f), 0) + len(now)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def result(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_path_counts():
    forward, backward = audit.path_counts(5)
    assert forward[-1] == backward[0] == factorial(5)
    for s in range(32):
        n = bin(s).count("1")
        assert forward[s] == factorial(n) and backward[s] == factorial(5 - n)
    for size in range(5):               # each order uses one edge out of the states of each size
        assert sum(forward[s] * backward[s | 1 << f] for s, f in audit._edges(5) if bin(s).count("1") == size) == 120


def test_audit_equals_the_simulation_on_real_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    want = simulated(rows, [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    got = result(audit.audit(docs, labels))
    assert got == want
    for part in {k[0] for k in got}:    # efficiency: the sums of an order's removals, over orders, are the Shapley sums
        n = sum(r[2] == part for r in rows)
        kept = got[part, "ABCDE", 5][0]
        assert sum(got[part, "ABCDE", s][6] for s in range(1, 6)) == 120 * (n - kept)


def test_audit_edge_cases(spark, edge, labels, empty, no_labels):
    names = [c for c in edge.columns if c not in ("doc_id", "text")]
    clash = edge
    for old, new in zip(names, ("part", "mask", "no_id", "key", "n", "good", "toxic", "digest", "raw", "state", "filter", "s")):
        clash = clash.withColumnRenamed(old, new)
    clash = clash.selectExpr("*", "CASE WHEN doc_id < 3 THEN 'x' WHEN doc_id = 4 THEN '' END AS lang")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in clash.select("doc_id", "text", "lang").collect()]
    got = result(audit.audit(clash, labels))
    assert {k[0] for k in got} == {"", "x"} and got == simulated(rows, [tuple(r) for r in labels.collect()])
    assert result(audit.audit(clash, no_labels)) == simulated(rows, [])
    assert audit.audit(clash.limit(0), labels).count() == 0


def test_copies_across_parts_and_repeated_rows(spark, no_labels):
    rng = random.Random(5)
    texts = ["one two", "A B C", "x" * 50, "# " + "word " * 300, None, "", " ".join(str(k) for k in range(260))]
    rows = [(rng.randrange(12) if rng.random() < 0.8 else None, rng.choice(texts), rng.choice(["p", "q", None])) for _ in range(150)]
    labels = [(k, k % 2, k % 3 == 0 and 1 or 0) for k in range(12)] + [(3, 1, None), (None, 1, 1)]
    got = result(audit.audit(spark.createDataFrame(rows, "doc_id int, text string, lang string"),
                             spark.createDataFrame(labels, "doc_id int, quality int, toxic int")))
    assert got == simulated(rows, labels)


def test_words_of_long_texts_are_counted_by_stretches(monkeypatch):
    raw = " ".join(f"w{k % 700}" for k in range(5000)).encode() + "é\x0b\x1c x".encode()
    want = audit.count_words(raw)
    assert want == (len(raw.split()), len(set(raw.split())))
    monkeypatch.setattr(audit, "STRETCH", 37)
    assert audit.count_words(raw) == want
    big = b"ab cd " * 9_000_000          # 54 MB
    assert audit.count_words(big) == (18_000_000, 2)
