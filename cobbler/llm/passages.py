"""Passage features with numpy: letter classes, byte pairs, word lengths and repetition of fixed-size passages."""

from __future__ import annotations

import numpy as np

PASSAGE = 1000          # bytes; the last passage of a text takes what is left
PAIRS = 48              # buckets for hashed byte pairs
_SINGLE = {"\n": 3, " ": 4, ".": 5, ",": 6, "!": 7, "?": 8, "|": 9}
CLASSES = 13


def _classes() -> np.ndarray:
    t = np.full(256, 10, np.int64)                  # other ASCII marks
    t[ord("A"):ord("Z") + 1], t[ord("a"):ord("z") + 1], t[ord("0"):ord("9") + 1] = 0, 1, 2
    t[128:], t[:32] = 11, 12
    for c, k in _SINGLE.items():
        t[ord(c)] = k
    return t


CLASS = _classes()
PAIR = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIRS
BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
DIM = CLASSES + PAIRS + 5


def passage_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, passages per text). An empty text is one passage of zeros."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    per = np.maximum(1, sizes // PASSAGE)
    first = np.cumsum(per) - per
    n = int(per.sum())
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw)), sizes)
    within = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    passage = np.repeat(first, sizes) + np.minimum(within // PASSAGE, np.repeat(per - 1, sizes))

    def per_passage(weights=None, at=passage):
        return np.bincount(at, weights, minlength=n).astype(np.float64)
    length = np.maximum(per_passage(), 1)
    classes = np.bincount(passage * CLASSES + CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES) / length[:, None]
    pair = PAIR[(data[:-1].astype(np.int64) << 8) | data[1:]] if len(data) > 1 else np.zeros(0, np.int64)
    inside = doc[1:] == doc[:-1]                # not the pair of one text's last byte and the next one's first
    pairs = np.bincount((passage[:-1] * PAIRS + pair)[inside], minlength=n * PAIRS).reshape(n, PAIRS) / length[:, None]

    letter = ~IS_SPACE[data]
    begins = letter.copy()
    begins[1:] &= IS_SPACE[data[:-1]] | (doc[1:] != doc[:-1])
    start = np.flatnonzero(begins)
    word_of = np.cumsum(begins) - 1
    n_words = np.maximum(per_passage(at=passage[start]), 1)
    if len(start):
        at = np.flatnonzero(letter)
        place = (at - start[word_of[at]]).astype(np.uint64)
        hashed = np.add.reduceat(BYTE[data[at] | 32] * (place * np.uint64(2) + np.uint64(1)), np.searchsorted(at, start))
        mixed = hashed * np.uint64(0x9E3779B97F4A7C15)
        by_passage = _distinct(passage[start], mixed, n) / n_words
        docs_words = np.maximum(np.bincount(doc[start], minlength=len(raw)), 1)
        by_doc = _distinct(doc[start], mixed, len(raw)) / docs_words
    else:
        by_passage, by_doc = np.zeros(n), np.zeros(len(raw))
    owner = np.repeat(np.arange(len(raw)), per)
    extra = np.stack([per_passage(letter) / n_words / 10, by_passage, by_doc[owner],
                      np.log1p(sizes[owner]) / 10, np.log1p(length) / 10], axis=1)
    return np.concatenate([classes, pairs, extra], axis=1).astype(np.float32), per


def _distinct(group: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return np.bincount(g[new], minlength=n)
