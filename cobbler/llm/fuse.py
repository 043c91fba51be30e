"""Binary fuse filters (3-wise, 8-bit fingerprints) over sets of 64-bit keys, built with numpy.

The construction follows the published description (Graf and Lemire, "Binary Fuse Filters", 2022):
three positions per key in neighbouring segments, peeled until no key is left, then fingerprints are
assigned in reverse. Peeling runs in rounds; the keys of one round cannot touch each other's
single position, so each round is one vector step.
"""

from __future__ import annotations

import math

import numpy as np

MAX_SEEDS = 100


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) & (2**64 - 1))
    for shift, mult in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(mult)
    return h ^ (h >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and the number of segments that can start a key's three."""
    seg = min(1 << max(2, int(math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    return seg, max(1, math.ceil(max(n, 2) * factor / seg) - 2)


def _places(h: np.ndarray, seg: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = np.uint64(seg - 1)
    a = ((h >> np.uint64(32)) * np.uint64(seg * starts)) >> np.uint64(32)
    b = (a + np.uint64(seg)) ^ ((h >> np.uint64(18)) & mask)
    c = (a + np.uint64(2 * seg)) ^ (h & mask)
    return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, start segments, fingerprints) of a filter that holds every key."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    seg, starts = _shape(n)
    size = (starts + 2) * seg
    for seed in range(MAX_SEEDS):
        h = _mixed(keys, seed)
        places = np.stack(_places(h, seg, starts))
        count = np.bincount(places.ravel(), minlength=size)
        held = np.bincount(places.ravel(), weights=np.tile(np.arange(n), 3), minlength=size)
        rounds, peeled = [], 0
        single = np.flatnonzero(count == 1)
        while len(single):
            who, first = np.unique(held[single].astype(np.int64), return_index=True)
            at = single[first]
            rounds.append((who, at))
            peeled += len(who)
            touched = places[:, who].ravel()
            np.subtract.at(count, touched, 1)
            np.subtract.at(held, touched, np.tile(who, 3))
            touched = np.unique(touched)
            single = touched[count[touched] == 1]
        if peeled == n:
            table, prints = np.zeros(size, np.uint8), _prints(h)
            for who, at in reversed(rounds):
                a, b, c = places[:, who]
                table[at] = 0
                table[at] = prints[who] ^ table[a] ^ table[b] ^ table[c]
            return seed, seg, starts, table.tobytes()
    raise RuntimeError(f"no binary fuse filter for {n} keys within {MAX_SEEDS} seeds")


def contains(keys: np.ndarray, seed: int, seg: int, starts: int, table: bytes) -> np.ndarray:
    """True for every key of the built set; true for about one in 256 others."""
    t, h = np.frombuffer(table, np.uint8), _mixed(keys, seed)
    a, b, c = _places(h, seg, starts)
    return _prints(h) == (t[a] ^ t[b] ^ t[c])
