"""The cart-row state machine (K3) as column expressions over an ordered array of events.

State of one cart row (one (user, option) key): its quantity ``q`` (0: no row) and its id. Events are structs of ``ts_us``,
``request_id``, ``op`` (add, set, remove), ``a`` (quantity) and ``cid`` (the id addressed, or proposed by an add); ``stock`` is
the option's stock, constant within a batch. Times follow from which events were accepted.

:func:`fold` applies the events from a known state. :func:`transfer` gives their effect on every state that may come in,
as pieces over the incoming quantity for each class of incoming id: an interval ``lo..hi`` that becomes a constant ``v``,
or is shifted by ``v``. Only an add splits a piece (what fits is shifted, what does not stays), and no piece is
kept beyond the largest quantity that can come in. So stretches of a long run of events can be summarised apart, and
:func:`states_before` then passes one state through the summaries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADD, SET, REMOVE = "add", "set", "remove"
OUTCOME = "array<struct<request_id:bigint,status:string,ts_us:bigint,starts:boolean,updates:boolean>>"
PIECE = "struct<cls:bigint,lo:bigint,hi:bigint,const:boolean,v:bigint,keeps:boolean,id:bigint>"
ENTRY = "array<struct<pid:int,chunk:bigint,q:bigint,id:bigint>>"


def _long(x) -> Column:
    return (F.lit(x) if x is None or isinstance(x, int) else x).cast("bigint")


def fold(events: Column, q: Column, row_id: Column, stock: Column) -> Column:
    """``q``, ``id`` after the events and ``out``, the outcome of each: its status, and whether the row starts with it or is
    updated by it."""
    def step(acc, e):
        q, op, mine = acc["q"], e["op"], (acc["q"] > 0) & F.coalesce(acc["id"] == e["cid"], F.lit(False))
        ok = F.when(op == ADD, q + e["a"] <= stock).when(op == SET, mine & (e["a"] <= stock)).otherwise(mine)
        status = F.when(ok, "accepted").when((op == ADD) | mine, "stock").otherwise("not_found")
        starts = ok & (op == ADD) & (q == 0)
        outcome = F.struct(e["request_id"].alias("request_id"), status.alias("status"), e["ts_us"].alias("ts_us"), starts.alias("starts"),
                           (ok & (op != REMOVE)).alias("updates"))
        return F.struct(F.when(~ok, q).when(op == ADD, q + e["a"]).when(op == SET, e["a"]).otherwise(_long(0)).alias("q"),
                        F.when(starts, e["cid"]).otherwise(acc["id"]).alias("id"), F.concat(acc["out"], F.array(outcome)).alias("out"))
    start = F.struct(_long(q).alias("q"), _long(row_id).alias("id"), F.array().cast(OUTCOME).alias("out"))
    return F.aggregate(events, start, step)


def id_classes(events: Column) -> Column:
    """The ids that the events address: these are told apart, all others behave alike."""
    return F.array_distinct(F.transform(F.filter(events, lambda e: (e["op"] != ADD) & e["cid"].isNotNull()), lambda e: e["cid"]))


def transfer(events: Column, classes: Column, stock: Column, most: Column) -> Column:
    """The pieces of a stretch of events; ``most`` is the largest quantity that may come in."""
    def piece(cls, lo, hi, const, v, keeps, row_id):
        return F.struct(_long(cls).alias("cls"), _long(lo).alias("lo"), _long(hi).alias("hi"), const.alias("const"), _long(v).alias("v"),
                        keeps.alias("keeps"), _long(row_id).alias("id"))
    # no row; then a row with each of the ids, or with another one
    begin = F.concat(F.array(piece(None, 0, 0, F.lit(True), 0, F.lit(False), None)),
                     F.transform(F.concat(classes, F.array(_long(None))), lambda c: piece(c, 1, most, F.lit(False), 0, F.lit(True), None)))

    def split(p, e):
        op, fits = e["op"], stock - e["a"]          # an add is accepted from at most ``fits``
        mine = F.coalesce(F.when(p["keeps"], p["cls"]).otherwise(p["id"]) == e["cid"], F.lit(False)) & (~p["const"] | (p["v"] > 0))
        added = (op == ADD) & (~p["const"] | (p["v"] <= fits))
        put = mine & ((op == REMOVE) | ((op == SET) & (e["a"] <= stock)))
        starts = added & p["const"] & (p["v"] == 0)
        taken = piece(p["cls"], p["lo"], F.when(added & ~p["const"], F.least(p["hi"], fits - p["v"])).otherwise(p["hi"]), p["const"] | put,
                      F.when(added, p["v"] + e["a"]).when(put, F.when(op == SET, e["a"]).otherwise(_long(0))).otherwise(p["v"]),
                      p["keeps"] & ~starts, F.when(starts, e["cid"]).otherwise(p["id"]))
        over = piece(p["cls"], F.when(added & ~p["const"], F.greatest(p["lo"], fits - p["v"] + 1)).otherwise(p["hi"] + 1), p["hi"],
                     p["const"], p["v"], p["keeps"], p["id"])
        return F.array(taken, over)
    return F.aggregate(events, F.filter(begin, lambda p: p["lo"] <= p["hi"]).cast(f"array<{PIECE}>"),
                       lambda acc, e: F.filter(F.flatten(F.transform(acc, lambda p: split(p, e))), lambda p: p["lo"] <= p["hi"]))


def states_before(stretches: Column, q: Column, row_id: Column) -> Column:
    """The state that each stretch meets, as structs of its ``pid``, ``chunk`` and the state; ``stretches`` (structs of ``pid``,
    ``chunk``, ``classes``, ``pieces``) are in order."""
    def through(acc, s):
        cls = F.when((acc["q"] > 0) & F.array_contains(s["classes"], acc["id"]), acc["id"])
        hit = F.filter(s["pieces"], lambda p: (p["lo"] <= acc["q"]) & (acc["q"] <= p["hi"]) & p["cls"].eqNullSafe(cls))
        after = F.element_at(F.transform(hit, lambda p: F.struct(
            F.when(p["const"], p["v"]).otherwise(acc["q"] + p["v"]).alias("q"), F.when(p["keeps"], acc["id"]).otherwise(p["id"]).alias("id"))), 1)
        met = F.struct(s["pid"].alias("pid"), s["chunk"].alias("chunk"), acc["q"].alias("q"), acc["id"].alias("id"))
        return F.struct(after["q"].alias("q"), after["id"].alias("id"), F.concat(acc["out"], F.array(met)).alias("out"))
    start = F.struct(_long(q).alias("q"), _long(row_id).alias("id"), F.array().cast(ENTRY).alias("out"))
    return F.aggregate(stretches, start, through)["out"]
