"""The cart fold and its transfer summaries, as column expressions, equal a plain loop over the events."""

import random

from pyspark.sql import functions as F

from cobbler.functions import cart_fold

EVENT = "struct<ts_us:bigint,request_id:bigint,op:string,a:bigint,cid:bigint>"


def step(st, op, a, cid, stock):
    """One change of one cart row: the reference's per-request logic."""
    q, rid = st
    if op == "add":
        if q + a > stock:
            return st, "stock"
        return (q + a, cid if q == 0 else rid), "accepted"
    if q == 0 or rid != cid:
        return st, "not_found"
    if op == "remove":
        return (0, rid), "accepted"
    return ((a, rid), "accepted") if a <= stock else (st, "stock")


def loop(st, events, stock):
    out = []
    for _, request, op, a, cid in events:
        st, status = step(st, op, a, cid, stock)
        out.append((request, status))
    return st, out


def random_events(rnd, n):
    return [(1000 + i, i, op := rnd.choice(["add", "add", "set", "remove"]), rnd.randint(1, 6) if op != "remove" else 0, rnd.choice([7, 8, 9])) for i in range(n)]


def row_id(st):
    return st[1] if st[0] else None


def test_fold_equals_the_loop(spark):
    rnd = random.Random(3)
    rows = [(k, random_events(rnd, rnd.randint(0, 25)), rnd.randint(0, 9), rnd.choice([None, 7, 8, 5]), rnd.randint(0, 8)) for k in range(150)]
    rows = [(k, ev, q if rid else 0, rid, stock) for k, ev, q, rid, stock in rows]
    df = spark.createDataFrame(rows, f"k int, ev array<{EVENT}>, q long, id long, stock long")
    got = {r["k"]: r["s"] for r in df.select("k", cart_fold.fold(F.col("ev"), F.col("q"), F.col("id"), F.col("stock")).alias("s")).collect()}
    for k, ev, q, rid, stock in rows:
        st, out = loop((q, rid), ev, stock)
        assert (got[k]["q"], got[k]["id"] if st[0] else None) == (st[0], row_id(st))
        assert [(o["request_id"], o["status"]) for o in got[k]["out"]] == out
        st, want = (q, rid), []
        for _, _, op, a, cid in ev:
            now, status = step(st, op, a, cid, stock)
            want.append((status == "accepted" and op == "add" and st[0] == 0, status == "accepted" and op != "remove"))
            st = now
        assert [(o["starts"], o["updates"]) for o in got[k]["out"]] == want


def test_summaries_pass_every_state_as_the_loop_does(spark):
    """Any state in, through one or several stretches."""
    rnd = random.Random(5)
    rows = []
    for k in range(60):
        stock, ev = rnd.randint(0, 8), random_events(rnd, 40)
        cuts = [0, *sorted(rnd.sample(range(1, 40), 3)), 40]
        for q in (0, 1, 2, 3, 5, 8, 11):
            for rid in ([None] if q == 0 else [7, 8, 5]):
                rows.append((len(rows), [(0, i, ev[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))], q, rid, stock))
    df = spark.createDataFrame(rows, f"k int, parts array<struct<pid:int,chunk:bigint,ev:array<{EVENT}>>>, q long, id long, stock long")
    summary = F.transform("parts", lambda p: F.struct(
        p["pid"].alias("pid"), p["chunk"].alias("chunk"), cart_fold.id_classes(p["ev"]).alias("classes"),
        cart_fold.transfer(p["ev"], cart_fold.id_classes(p["ev"]), F.col("stock"), F.greatest("stock", "q")).alias("pieces")))
    got = df.select("k", summary.alias("s"), "q", "id").select("k", "s", cart_fold.states_before(F.col("s"), F.col("q"), F.col("id")).alias("met")).collect()
    got = {r["k"]: r for r in got}
    for k, parts, q, rid, stock in rows:
        st = (q, rid)
        for (_, _, ev), met in zip(parts, got[k]["met"]):
            assert (met["q"], met["id"] if st[0] else None) == (st[0], row_id(st)), (k, q, rid, stock)
            st, _ = loop(st, ev, stock)
        for (_, _, ev), s in zip(parts, got[k]["s"]):
            assert len(s["pieces"]) <= (len(s["classes"]) + 1) * (len(ev) + 1) + 1
