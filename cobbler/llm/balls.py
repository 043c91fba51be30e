"""Metric trees over integer points by the anchors hierarchy, and what a set of entries owns of them (numpy, one block).

Middle-out: about sqrt(n) anchors are grown first, each new one at the point farthest from its anchor, taking over the
points that are nearer to it. Anchors are then merged pairwise into balls up to the root, and each anchor with many
points is cut the same way below. A ball keeps its points' sum and count, so that once a single entry is left as a
candidate for all of it, the ball is accounted for without looking at its points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: Points of a ball that is not cut further.
LEAF = 64
_SLACK = 1e-9


@dataclass
class Balls:
    """``order`` lists the points so that each ball is a stretch of it. Ball ``k`` holds ``order[start:end]``, its parts are
    ``children[k]`` (both negative for a leaf); the last ball is the root."""
    order: np.ndarray       # int32 [n]
    spans: np.ndarray       # int32 [balls, 2]
    children: np.ndarray    # int32 [balls, 2]
    centres: np.ndarray     # float64 [balls, width]
    radii: np.ndarray       # float64 [balls]
    sums: np.ndarray        # int64 [balls, width]

    FIELDS = {"order": (np.int32, 0), "spans": (np.int32, 2), "children": (np.int32, 2), "centres": (np.float64, None),
              "radii": (np.float64, 0), "sums": (np.int64, None)}

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS]

    @classmethod
    def unpack(cls, raw: list[bytes], width: int) -> Balls:
        out = []
        for data, (kind, columns) in zip(raw, cls.FIELDS.values()):
            a = np.frombuffer(data, kind)
            out.append(a if columns == 0 else a.reshape(-1, width if columns is None else columns))
        return cls(*out)


def anchors(points: np.ndarray) -> list[np.ndarray]:
    """The points (by number) of about sqrt(n) anchors; one alone if all points are equal."""
    n = len(points)
    middle = points.mean(axis=0)
    first = int(np.argmax(((points - middle) ** 2).sum(axis=1)))
    pivots = [points[first]]
    far = np.sqrt(((points - points[first]) ** 2).sum(axis=1))      # of each point from its anchor
    owner = np.zeros(n, np.int64)
    for new in range(1, math.isqrt(n - 1) + 1):
        p = int(np.argmax(far))
        if far[p] == 0:
            break
        apart = np.sqrt(((np.array(pivots) - points[p]) ** 2).sum(axis=1))
        near = np.flatnonzero(far * 2 >= apart[owner])              # all others are nearer to their own anchor
        d = np.sqrt(((points[near] - points[p]) ** 2).sum(axis=1))
        won = d < far[near]
        owner[near[won]], far[near[won]] = new, d[won]
        pivots.append(points[p])
    by_owner = np.argsort(owner, kind="stable")
    return [g for g in np.split(by_owner, np.cumsum(np.bincount(owner, minlength=len(pivots)))[:-1]) if len(g)]


class _Builder:
    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float64)
        self.exact = points
        self.parts: list[tuple] = []            # (left, right) of a joined ball, (members,) of a leaf

    def ball(self, members: np.ndarray) -> int:
        groups = anchors(self.points[members]) if len(members) > LEAF else []
        if len(groups) < 2:
            self.parts.append((members,))
            return len(self.parts) - 1
        return self.merge([self.ball(members[g]) for g in groups], [members[g] for g in groups])

    def merge(self, balls: list[int], members: list[np.ndarray]) -> int:
        """Join the two balls whose union is smallest until one is left."""
        k = len(balls)
        balls = balls + [0] * (k - 1)
        count = np.array([len(m) for m in members] + [0] * (k - 1), np.float64)
        centre = np.zeros((2 * k - 1, self.points.shape[1]))
        radius = np.zeros(2 * k - 1)
        for a, m in enumerate(members):
            centre[a] = self.points[m].mean(axis=0)
            radius[a] = math.sqrt(((self.points[m] - centre[a]) ** 2).sum(axis=1).max())
        size = np.full((2 * k - 1, 2 * k - 1), np.inf)
        alive = np.zeros(2 * k - 1, bool)
        alive[:k] = True

        def compare(a: int, others: np.ndarray) -> None:
            apart = np.sqrt(((centre[others] - centre[a]) ** 2).sum(axis=1))
            share = count[others] / (count[others] + count[a])      # the joint centre lies this far towards the other
            size[np.minimum(a, others), np.maximum(a, others)] = np.maximum(share * apart + radius[a], (1 - share) * apart + radius[others])

        for a in range(1, k):
            compare(a, np.arange(a))
        for new in range(k, 2 * k - 1):
            a, b = divmod(int(np.argmin(size)), 2 * k - 1)
            self.parts.append((balls[a], balls[b]))
            balls[new] = len(self.parts) - 1
            count[new] = count[a] + count[b]
            centre[new] = (count[a] * centre[a] + count[b] * centre[b]) / count[new]
            radius[new] = size[a, b]
            for gone in (a, b):
                alive[gone] = False
                size[gone, :] = size[:, gone] = np.inf
            others = np.flatnonzero(alive)
            if len(others):
                compare(new, others)
            alive[new] = True
        return balls[-1]


def grow(points: np.ndarray) -> Balls:
    """The tree of ``points`` (int64 ``[n, width]``, n > 0)."""
    b = _Builder(points)
    root = b.ball(np.arange(len(points)))
    total, width = len(b.parts), points.shape[1]
    out = Balls(np.zeros(len(points), np.int32), np.zeros((total, 2), np.int32), np.full((total, 2), -1, np.int32),
                np.zeros((total, width)), np.zeros(total), np.zeros((total, width), np.int64))
    assert root == total - 1
    at, waiting = 0, [root]                     # leaves in depth-first order: every ball is one stretch
    visited = []
    while waiting:
        k = waiting.pop()
        part = b.parts[k]
        out.spans[k, 0] = at
        visited.append(k)
        if len(part) == 1:
            out.order[at:at + len(part[0])] = part[0]
            at += len(part[0])
            out.spans[k, 1] = at
        else:
            out.children[k] = part
            waiting += [part[1], part[0]]
    for k in reversed(visited):                 # parts before the ball that they make up
        if out.children[k, 0] >= 0:
            out.spans[k, 1] = out.spans[out.children[k, 1], 1]
    ordered = points[out.order]
    for k in range(total):
        own = ordered[slice(*out.spans[k])]
        out.sums[k] = own.sum(axis=0)
        out.centres[k] = own.mean(axis=0)
        out.radii[k] = math.sqrt(((own - out.centres[k]) ** 2).sum(axis=1).max()) * (1 + _SLACK)
    return out


def owned(balls: Balls, points: np.ndarray, entries: np.ndarray):
    """Yield ``(entry, start, end, count, sum)`` for balls owned whole, and ``(entries of points, start, end, None, None)`` for
    the leaves where several candidates are left; together they cover every point once.

    ``points`` are in the tree's order. An entry stays a candidate of a ball unless the entry nearest to the ball's
    centre is nearer to every point of the ball, by a margin above what rounding could hide; leaves are decided
    exactly in integers, equal distances by the lower entry.
    """
    floats = entries.astype(np.float64)
    stack = [(len(balls.spans) - 1, np.arange(len(entries)))]
    while stack:
        k, candidates = stack.pop()
        start, end = balls.spans[k]
        if len(candidates) > 1:
            here = floats[candidates]
            far = ((here - balls.centres[k]) ** 2).sum(axis=1)
            best = int(np.argmin(far))
            reach = 2 * balls.radii[k] * np.sqrt(((here - here[best]) ** 2).sum(axis=1))    # how far the lead over one can shrink inside
            candidates = candidates[far - far[best] - reach <= _SLACK * (far + reach)]
        if len(candidates) == 1:
            yield int(candidates[0]), start, end, int(end - start), balls.sums[k]
        elif balls.children[k, 0] >= 0:
            stack += [(int(c), candidates) for c in balls.children[k]]
        else:
            d = ((points[start:end, None, :] - entries[candidates][None, :, :]) ** 2).sum(axis=2)
            yield candidates[np.argmin(d, axis=1)], start, end, None, None
