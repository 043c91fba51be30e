"""Repeated windows by a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``length`` bytes, most significant digits first, and a group of one is dropped as
soon as it forms. Not every suffix needs ordering: each window picks an anchor among its first places by content
alone (``windows.anchors``), so equal windows have equal anchors at equal distances. The passes are

1. the core of each anchor (the bytes that all its windows share), over all documents;
2. the whole context of an anchor: where it occurs twice, all its windows are repeated;
3. for contexts that differ within a core's group, the remaining depth: groups of many contexts are split
   further, half of the window distances at a time with the bytes these share, until they are small or the depth is
   reached; then the windows of a group are compared. Equal groups at full depth are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, ready, shuffle_parts, store, whole_text
from .windows import Hashes, anchor_hashes, anchors, merged, mix, repeated

LENGTH = 400
#: Contexts of one core that a task compares; larger groups are refined by further passes first. Small groups share
#: a call of about ``TOGETHER`` contexts.
AT_ONCE, TOGETHER = 50_000, 4_000
ANCHORS = "doc_id long, text_key long, p long, core long, context long"
CONTEXTS = "grp long, core long, context long, back int, lo int, hi int, bytes binary"
RANGES = "core long, context long, since int, until int"


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64), pa.int64())


def all_anchors(texts: DataFrame, length: int, choices: int) -> DataFrame:
    def find(batches):
        for b in batches:
            for doc_id, key, text in zip(b.column("doc_id"), b.column("text_key"), b.column("text")):
                p, core, context = anchors(np.frombuffer(text.as_py().encode(), np.uint8), length, choices)
                if len(p):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v.as_py()] * len(p), pa.int64()) for v in (doc_id, key)] + [pa.array(p, pa.int64()), _long(core), _long(context)],
                        ["doc_id", "text_key", "p", "core", "context"])
    return texts.mapInArrow(find, ANCHORS)


def _cut_contexts(texts: DataFrame, wanted: DataFrame, length: int, choices: int) -> DataFrame:
    """The bytes around ``wanted`` anchors (``doc_id, text_key, p``), with their core and context hashes."""
    core, reach = length - choices + 1, choices - 1
    per_doc = store(wanted.groupBy(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"))
                    .agg(F.collect_list(F.col("p").cast("int")).alias("ps")))
    places, = per_doc.agg(F.sum(F.size("ps"))).first()         # 4 bytes each
    found = texts.join(bounded(per_doc, places or 0, 8_000_000),
                       F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_"))).select("text", "ps")

    def cut(batches):
        for b in batches:
            for text, ps in zip(b.column("text"), b.column("ps")):
                data = text.as_py().encode()
                p = np.array(ps.as_py(), np.int64)
                cores, contexts = anchor_hashes(np.frombuffer(data, np.uint8), p, core, reach)
                left = np.minimum(p, reach)
                n = len(p)
                yield pa.RecordBatch.from_arrays(
                    [_long(cores), _long(cores), _long(contexts), pa.array(left, pa.int32()), pa.array(np.zeros(n), pa.int32()),
                     pa.array(np.full(n, reach), pa.int32()),
                     pa.array([data[a - x:a + core + reach] for a, x in zip(p.tolist(), left.tolist())], pa.binary())],
                    ["grp", "core", "context", "back", "lo", "hi", "bytes"])
    return found.mapInArrow(cut, CONTEXTS)


def _split(contexts: DataFrame, length: int, choices: int) -> DataFrame:
    """One more digit: each half of the distances, grouped by the bytes all its windows share."""
    core, reach = length - choices + 1, choices - 1

    def digit(batches):
        for b in batches:
            rows = b.to_pylist()
            out = []
            for r in rows:
                mid = (r["lo"] + r["hi"]) // 2
                data = np.frombuffer(r["bytes"], np.uint8)
                for lo, hi in ((r["lo"], mid), (mid + 1, r["hi"])):
                    # a window ``d`` before the anchor covers [back - d, back - d + length)
                    start, end = r["back"] - lo, r["back"] - hi + length
                    if lo > hi or start < 0 or end > len(data):
                        continue                    # the text ends before any window of this half does
                    h = Hashes(data[start:end], 1).of(np.array([0]), np.array([end - start]))
                    g = mix(h + np.uint64(r["grp"] & (2**64 - 1)) + np.uint64(lo * 4099 + hi))
                    out.append({**r, "grp": int(g.view(np.int64)[0]), "lo": lo, "hi": hi})
            yield pa.RecordBatch.from_pylist(out, schema=b.schema)
    assert core + reach == length
    return contexts.mapInArrow(digit, CONTEXTS)


def _compare(contexts: DataFrame, length: int, choices: int) -> DataFrame:
    """Ranges, relative to the anchor, that repeated windows of each context cover."""
    def ranges(batches):
        held, last = [], None

        def done(rows):
            grp = np.array([r[0] for r in rows], np.int64)
            hit = repeated(grp, [r[6] for r in rows], *[np.array([r[k] for r in rows]) for k in (3, 4, 5)], length, choices)
            out = [[], [], [], []]
            padded = np.zeros((len(rows), choices + 2), np.int8)
            padded[:, 1:-1] = hit
            change = np.diff(padded, axis=1)
            row, begin = np.nonzero(change == 1)
            _, end = np.nonzero(change == -1)          # distances [begin, end) are repeated
            for i, a, z in zip(row.tolist(), begin.tolist(), end.tolist()):
                for col, v in zip(out, (rows[i][1], rows[i][2], -(z - 1), length - a)):
                    col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                              ["core", "context", "since", "until"])
        for b in batches:
            for r in zip(*[b.column(k).to_pylist() for k in range(7)]):
                if len(held) >= TOGETHER and r[0] != last:
                    yield done(held)
                    held = []
                held.append(r)
                last = r[0]
        if held:
            yield done(held)
    return (contexts.repartition(shuffle_parts(contexts.sparkSession), "grp").sortWithinPartitions("grp").mapInArrow(ranges, RANGES))


def _in_groups(contexts: DataFrame, length: int, choices: int, at_once: int) -> DataFrame:
    """Refine groups of more than ``at_once`` contexts, then compare all."""
    ready_, rest = [], contexts
    for _ in range(choices.bit_length() + 1):
        sizes = rest.groupBy("grp").agg(F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("width"))
        large = store(sizes.filter((F.col("size") > at_once) & (F.col("width") > 0)).select("grp"))
        if large.isEmpty():
            break
        ready_.append(rest.join(large, "grp", "left_anti"))
        split = store(_split(rest.join(large, "grp"), length, choices))
        alone = split.groupBy("grp").agg(F.count("*").alias("c")).filter("c > 1").select("grp")
        rest = store(split.join(alone, "grp").select(*split.columns))
    full_depth = rest.filter("lo = hi").groupBy("grp").agg(F.count("*").alias("c")).filter(F.col("c") > at_once).select("grp")
    if ready_:      # at full depth, a group of several is repeated, whatever its size
        deep = rest.join(full_depth, "grp").select("core", "context", (-F.col("lo")).alias("since"), (length - F.col("lo")).alias("until"))
        small = rest.join(full_depth, "grp", "left_anti")
        for part in ready_:
            small = small.unionByName(part)
        return _compare(small, length, choices).unionByName(deep)
    return _compare(rest, length, choices)


def repeated_ranges(docs: DataFrame, length: int = LENGTH, at_once: int = AT_ONCE) -> DataFrame:
    """``id_, key_, ranges``: for each row with repeated windows, ascending byte ranges (they may pass the text's ends)."""
    choices = length // 2
    texts = whole_text(docs).withColumn("text_key", F.xxhash64("text"))
    found = store(all_anchors(texts, length, choices))
    # one place of each context comes along; which one does not matter
    kinds = store(found.groupBy("core", "context").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in ("doc_id", "text_key", "p")]))
    cores = kinds.groupBy("core").agg(F.sum("times").alias("total"), F.count("*").alias("contexts")).filter("total > 1")
    kinds = store(kinds.join(cores, "core").drop("total"))
    reach = choices - 1
    whole = kinds.filter("times > 1").select("core", "context", F.lit(-reach).alias("since"), F.lit(length).alias("until"))
    wanted = kinds.filter("contexts > 1").select("doc_id", "text_key", "p")
    contexts = store(_cut_contexts(texts, wanted, length, choices))
    partly = _in_groups(contexts, length, choices, at_once)
    cover = store(whole.unionByName(partly).groupBy("core", "context").agg(F.collect_set(F.struct("since", "until")).alias("cover")))
    hit = (found.join(cover, ["core", "context"])
           .select("doc_id", "text_key", F.explode("cover").alias("c"), "p")
           .select("doc_id", "text_key", F.struct((F.col("p") + F.col("c.since")).alias("a"), (F.col("p") + F.col("c.until")).alias("z")).alias("r")))
    return (hit.groupBy(F.col("doc_id").alias("id_"), F.col("text_key").alias("key_"))
            .agg(_union(F.array_sort(F.collect_set("r"))).alias("ranges")))


def _union(ranges: Column) -> Column:
    """Sorted ranges ``(a, z)`` as few that do not touch."""
    none = F.array().cast("array<struct<a:bigint,z:bigint>>")

    def step(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["z"], r["z"]).alias("z"))))
        return F.when((F.size(acc) > 0) & (last["z"] >= r["a"]), joined).otherwise(F.concat(acc, F.array(r)))
    return F.aggregate(ranges, none, step)


def remove_repeats(docs: DataFrame, length: int = LENGTH, at_once: int = AT_ONCE) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left, in order).

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same or another document;
    strings are judged on the input. A null text counts as empty. Rows are told apart by id and text, and rows that
    repeat both are different documents with equal strings, so all their windows go. An empty table gives an empty
    result; other columns are ignored.
    """
    ready(docs.sparkSession)
    texts = whole_text(docs).withColumn("text_key", F.xxhash64("text"))
    ranges = store(repeated_ranges(docs, length, at_once))
    marked = (texts.join(bounded(ranges, ranges.count(), 200_000),
                         F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("key_")), "left")
              .select("doc_id", "text", "ranges"))

    def cut(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for text, r in zip(b.column("text"), b.column("ranges")):
                data = text.as_py().encode()
                r = r.as_py() or []
                s = np.clip(np.array([x["a"] for x in r], np.int64), 0, len(data))
                e = np.clip(np.array([x["z"] for x in r], np.int64), 0, len(data))
                s, e = merged(s, e)
                left = b"".join(data[a:z] for a, z in zip(np.r_[0, e].tolist(), np.r_[s, len(data)].tolist()))
                for col, v in zip(out, (len(data), len(data) - len(left), len(s), hashlib.sha256(left).hexdigest(), left)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string()), pa.array(out[4], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return marked.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
