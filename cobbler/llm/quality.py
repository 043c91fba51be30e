"""Quality by attention-based multiple-instance learning.

Every passage of a document is encoded; gated attention, learned from document labels alone, weighs the passages, and
a logistic unit scores the weighted representation (the gated attention pooling of Ilse et al., 2018).
The network is fitted with numpy on a bounded sample of labelled rows, then every passage of every document is
encoded and scored in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, whole_text
from .labelled import fold, with_label
from .passages import DIM, passage_features

FOLDS, HELD_OUT = 4, 2
#: The fit reads at most this many labelled rows (those of the smallest hash of id), with all their passages; scoring
#: has no such bound.
FIT_ROWS = 6000
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 40, 128, 0.01, 1e-4
ACCEPT = 0.7
#: Characters encoded at once (a longer text is encoded by itself).
AT_ONCE = 300_000


class Attention:
    """f -> h = tanh(f W); a = softmax(w . (tanh(h V) * sigmoid(h U))); score = sigmoid((sum a h) . c)."""

    def __init__(self, mean, scale, prior=0.0, seed=11):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = {"W": r.normal(0, DIM ** -0.5, (DIM, HIDDEN)), "b": np.zeros(HIDDEN),
                  "V": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)), "U": r.normal(0, HIDDEN ** -0.5, (HIDDEN, GATE)),
                  "w": r.normal(0, GATE ** -0.5, GATE), "c": r.normal(0, HIDDEN ** -0.5, HIDDEN), "d": np.array([prior])}

    def forward(self, x, per):
        p = self.p
        starts = np.cumsum(per) - per
        bag = np.repeat(np.arange(len(per)), per)
        f = (x - self.mean) / self.scale
        h = np.tanh(f @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        s = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return s, (f, h, t, g, a, z, bag, starts)

    def gradient(self, x, per, y):
        p = self.p
        s, (f, h, t, g, a, z, bag, starts) = self.forward(x, per)
        ds = (s - y) / len(y)
        dz = np.outer(ds, p["c"])
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, starts)[bag])
        dtg = np.outer(de, p["w"])
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"W": f.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
                "c": z.T @ ds, "d": np.array([ds.sum()])}

    def fit(self, bags, y, seed=5):
        """Adam over shuffled batches of documents."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(EPOCHS):
            order = r.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = order[at:at + BATCH]
                grad = self.gradient(np.concatenate([bags[i] for i in some]), np.array([len(bags[i]) for i in some]), y[some])
                step += 1
                for k, d in grad.items():
                    d = d + DECAY * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v2[k] = 0.999 * v2[k] + 0.001 * d * d
                    self.p[k] = self.p[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def scores(model: Attention, texts: list[str]) -> np.ndarray:
    out, some, held = [np.zeros(0)], [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= AT_ONCE:
            out.append(model.forward(*passage_features(some))[0])
            some, held = [], 0
    if some:
        out.append(model.forward(*passage_features(some))[0])
    return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame) -> Attention:
    """Fit on the bounded sample; without labelled rows the untrained network scores everything 1/2."""
    labelled = with_label(docs, labels, "quality").filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    # ids are chosen without their texts; at most FIT_ROWS of them are broadcast
    chosen = labelled.select("doc_id", "y").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    sample = whole_text(docs).join(F.broadcast(chosen), "doc_id")

    def encode(batches):
        for b in batches:
            ys, rows = [], []
            for text, y in zip(b.column("text"), b.column("y")):
                x, _ = passage_features([text.as_py()])
                ys.append(y.as_py())
                rows.append(x.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(rows, pa.binary())], ["y", "bag"])
    rows = sample.select("text", "y").mapInArrow(encode, "y int, bag binary").collect()      # at most FIT_ROWS bags, a few hundred bytes for each passage
    if not rows:
        model = Attention(np.zeros(DIM), np.ones(DIM))
        model.p["c"][:] = 0
        return model
    bags = [np.frombuffer(r["bag"], "<f4").reshape(-1, DIM).astype(np.float64) for r in sorted(rows, key=lambda r: (r["y"], r["bag"]))]
    y = np.array(sorted(r["y"] for r in rows), float)
    every = np.concatenate(bags)
    good = np.clip(y.mean(), 0.01, 0.99)
    return Attention(every.mean(0), every.std(0) + 1e-3, float(np.log(good / (1 - good)))).fit(bags, y)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; ``predicted`` is 1 from a score of 0.7 on.

    Labels are read only outside the held-out fold; no label, language, source or id enters a score. A null
    text counts as empty (one passage of zeros). A null id is in no fold and has no label; repeated
    rows score alike; without labels every score is 1/2; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels))        # a few thousand numbers

    def score(batches):
        model = shared.value
        for b in batches:
            s = scores(model, b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return (whole_text(docs).mapInArrow(score, "doc_id long, score double")
            .select("doc_id", held.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier accepts."""
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(scores(shared.value, list(text)))
    return docs.filter(score(F.coalesce(F.col("text"), F.lit(""))) >= ACCEPT)
