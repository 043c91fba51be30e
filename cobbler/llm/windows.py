"""Numpy helpers of the repeated-window search: anchors of a text and the windows around them."""

from __future__ import annotations

import numpy as np

GRAM = 24               # bytes whose hash decides which places are anchors
#: A long text is taken in stretches of this many window starts.
STRETCH = 1 << 20
#: Window hashes, and contexts, compared at once.
CELLS, ROWS = 1_000_000, 2_000

_rng = np.random.default_rng(20)
BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
BASE = (_rng.integers(1, 1 << 62, 2, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in BASE], np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """64-bit hashes of any stretch of ``data`` (bytes along the last axis) from one running sum."""

    def __init__(self, data: np.ndarray, which: int):
        n = data.shape[-1]
        self.sums = np.zeros((*data.shape[:-1], n + 1), np.uint64)
        np.cumsum(BYTE[which][data] * _powers(BASE[which], n), axis=-1, dtype=np.uint64, out=self.sums[..., 1:])
        self.inverse = _powers(INVERSE[which], n + 1)

    def of(self, start, end):
        return mix((self.sums[..., end] - self.sums[..., start]) * self.inverse[start])


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """Places that are the leftmost least of some ``width`` neighbours.

    The low bits of a hash give way to its place, so minima are unique and name their place; minima of
    all neighbourhoods come from running minima forwards and backwards within blocks of ``width``.
    """
    n = len(h)
    bits = np.uint64(max(1, n - 1).bit_length())
    named = ((h >> bits) << bits) | np.arange(n, dtype=np.uint64)
    grid = np.full(-(-n // width) * width, np.uint64(2**64 - 1), np.uint64)
    grid[:n] = named
    grid = grid.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n - width + 1], ahead[width - 1:n])
    return np.unique(least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def anchors(data: np.ndarray, length: int, choices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, core hashes, context hashes) of the anchors of ``data``.

    Every window of ``length`` bytes picks, among its first ``choices`` places, the one whose next bytes hash least, so
    equal windows pick the same. The core is the ``length - choices + 1`` bytes from an anchor; the context
    reaches ``choices - 1`` bytes further to both sides, as far as the text goes.
    """
    n, core, reach = len(data), length - choices + 1, choices - 1
    empty = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if n < length:
        return empty
    found = []
    for begin in range(0, n - length + 1, STRETCH):
        last = min(begin + STRETCH, n - length + 1)                 # window starts [begin, last)
        lo, hi = max(0, begin - reach), min(n, last + length + 2 * reach)
        h = Hashes(data[lo:hi], 0)
        at = np.arange(begin - lo, last + reach - lo)
        p = least_places(h.of(at, at + min(GRAM, core)), choices) + begin
        found.append((p, *anchor_hashes(data[lo:hi], p - lo, core, reach, h)))
    p, first = np.unique(np.concatenate([x[0] for x in found]), return_index=True)
    return p, np.concatenate([x[1] for x in found])[first], np.concatenate([x[2] for x in found])[first]


def anchor_hashes(data: np.ndarray, p: np.ndarray, core: int, reach: int, h: Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(core, context) hashes of the anchors ``p`` of ``data``; the context's tells how far it reaches, too."""
    left, right = np.maximum(p - reach, 0), np.minimum(p + core + reach, len(data))
    f = Hashes(data, 1).of(left, right)
    return (h or Hashes(data, 0)).of(p, p + core), mix(f + (p - left).astype(np.uint64) * BASE[0] + (right - p).astype(np.uint64) * BASE[1])


def repeated(group: np.ndarray, contexts: list[bytes], left: np.ndarray, lo: np.ndarray, hi: np.ndarray,
             length: int, choices: int) -> np.ndarray:
    """Which windows of each context occur in another context of its group: a row per context, a column per
    distance (0 to ``choices - 1``) of the window's start before the anchor; only distances ``lo`` to ``hi`` count.

    Distances are taken a few at a time where there are many contexts, so that about ``CELLS`` hashes are held.
    """
    m, most = len(contexts), length + choices - 1
    sizes = np.array([len(c) for c in contexts])
    out = np.zeros((m, choices), bool)
    step = max(1, min(choices, CELLS // max(1, m)))
    for d in range(0, choices, step):
        before = np.arange(d, min(d + step, choices))
        start = left[:, None] - before[None, :]
        valid = (start >= 0) & (start + length <= sizes[:, None]) & (before >= lo[:, None]) & (before <= hi[:, None])
        row, col = np.nonzero(valid)
        if not len(row):
            continue
        keys = [np.zeros(len(row), np.uint64) for _ in (0, 1)]
        for a in range(0, m, ROWS):
            some = slice(*np.searchsorted(row, [a, a + ROWS]))
            data = np.zeros((min(ROWS, m - a), most), np.uint8)
            for k, c in enumerate(contexts[a:a + ROWS]):
                data[k, :len(c)] = np.frombuffer(c, np.uint8)
            r, s = row[some] - a, start[row[some], col[some]]
            for which in (0, 1):
                h = Hashes(data, which)
                keys[which][some] = mix((h.sums[r, s + length] - h.sums[r, s]) * h.inverse[s])
        salt = group[row].astype(np.uint64) * BASE[0] + before[col].astype(np.uint64) * BASE[1]
        first, second = mix(keys[0] + salt), mix(keys[1] + salt)
        order = np.argsort(first, kind="stable")
        first, second = first[order], second[order]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
        hit = np.zeros(len(order), bool)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
        out[row[hit], before[col[hit]]] = True
    return out


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, as ascending disjoint ones that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.r_[True, s[1:] > e[:-1]]
    return s[new], e[np.r_[np.flatnonzero(new)[1:] - 1, len(s) - 1]]
