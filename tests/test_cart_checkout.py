"""K1-K3 and X1-X5, including every reject branch and a plain-loop check of the change feed."""

import datetime as dt
import random

import pytest

from cobbler.operators import cart, checkout
from cobbler.sources import schemas
from conftest import make_shop

T0 = dt.datetime(2025, 4, 1)


def feed(spark, rows):
    return spark.createDataFrame(
        [(i, T0 + dt.timedelta(minutes=i), *r) for i, r in enumerate(rows, start=1)], schemas.CART_CHANGES)


def test_cart_lines_and_totals(spark):
    t = make_shop(spark)
    lines = cart.cart_lines(t).collect()
    assert [(r.user_id, r.cart_id) for r in lines] == [(1, 12), (1, 11), (2, 14), (2, 13), (3, 15)]
    tot = {r.user_id: (r.total_items, r.total_price) for r in cart.cart_totals(t).collect()}
    # user 1: 2 x 159000 (d 0) + 1 x 159000 x 0.9 ; user 3: 1 x 1000 x 0.93 = 930
    assert tot[1] == (2, 461100) and tot[3] == (1, 930)


def test_cart_changes_every_branch(spark):
    t = make_shop(spark)
    rows = [
        (1, "add", None, None, 1),       # 1 invalid: no option
        (1, "add", 1, None, 0),          # 2 invalid: quantity 0
        (1, "add", 99, None, 1),         # 3 not_found: unknown option
        (1, "add", 1, None, 9),          # 4 stock: existing 2 + 9 > 10
        (1, "add", 1, None, 8),          # 5 accepted: 2 + 8 = 10
        (1, "add", 2, 900, 1),           # 6 stock: option 2 has stock 0 (new row not created)
        (1, "set", None, 900, 1),        # 7 not_found: row 900 never created
        (2, "set", None, 11, 1),         # 8 not_found: cart 11 belongs to user 1
        (1, "set", None, 11, 11),        # 9 stock: 11 > 10
        (1, "set", None, 11, 3),         # 10 accepted -> 3
        (1, "remove", None, 12, None),   # 11 accepted
        (1, "set", None, 12, 1),         # 12 not_found: removed
        (1, "add", 7, 901, 1),           # 13 accepted: re-creates the (1, 7) row as id 901
        (3, "add", 6, 950, 1),           # 14 accepted: new row 950
        (3, "set", None, 950, 2),        # 15 stock: option 6 has stock 1
        (3, "remove", None, 951, None),  # 16 not_found
        (3, "set", None, 15, None),      # 17 invalid: no quantity
        (3, "frobnicate", None, 15, 1),  # 18 invalid op
    ]
    out = cart.apply_cart_changes(t, feed(spark, rows))
    st = {r.request_id: r.status for r in out["status"].collect()}
    assert st == {1: "invalid", 2: "invalid", 3: "not_found", 4: "stock", 5: "accepted", 6: "stock",
                  7: "not_found", 8: "not_found", 9: "stock", 10: "accepted", 11: "accepted", 12: "not_found",
                  13: "accepted", 14: "accepted", 15: "stock", 16: "not_found", 17: "invalid", 18: "invalid"}
    c = {r.cart_id: (r.user_id, r.option_id, r.quantity) for r in out["cart"].collect()}
    assert c == {11: (1, 1, 3), 901: (1, 7, 1), 13: (2, 3, 5), 14: (2, 10, 1), 15: (3, 11, 1), 950: (3, 6, 1)}


def _loop(cart_rows, stock, rows):
    """The three request handlers as a plain loop (the reference's per-request semantics)."""
    by_id = {c[0]: list(c[1:4]) for c in cart_rows}          # cart_id -> [user, option, qty]
    st = {}
    for rid, _, user, op, opt, cid, q in sorted(rows, key=lambda r: (r[1], r[0])):
        if op == "add":
            if not opt or not q or q < 1:
                st[rid] = "invalid"; continue
            if opt not in stock:
                st[rid] = "not_found"; continue
            if stock[opt] < q:
                st[rid] = "stock"; continue
            row = next((k for k, v in by_id.items() if v[0] == user and v[1] == opt), None)
            if row is not None:
                if stock[opt] < by_id[row][2] + q:
                    st[rid] = "stock"; continue
                by_id[row][2] += q
            else:
                by_id[cid] = [user, opt, q]
            st[rid] = "accepted"
        elif op == "set":
            if not cid or q is None or q < 1:
                st[rid] = "invalid"; continue
            if cid not in by_id or by_id[cid][0] != user:
                st[rid] = "not_found"; continue
            if stock[by_id[cid][1]] < q:
                st[rid] = "stock"; continue
            by_id[cid][2] = q
            st[rid] = "accepted"
        else:
            if cid not in by_id or by_id[cid][0] != user:
                st[rid] = "not_found"; continue
            del by_id[cid]
            st[rid] = "accepted"
    return st, {k: tuple(v) for k, v in by_id.items()}


def test_cart_changes_against_plain_loop(spark):
    rnd = random.Random(11)
    t = make_shop(spark)
    stock = {r.option_id: r.stock_quantity for r in t["product_options"].collect()}
    cart_rows = [(r.cart_id, r.user_id, r.option_id, r.quantity) for r in t["cart"].collect()]
    rows = []
    for i in range(1, 600):
        user, opt = rnd.choice([1, 2, 3]), rnd.choice([1, 2, 3, 7, 10, 11, 99])
        op = rnd.choice(["add", "add", "set", "remove"])
        cid = user * 1000 + opt if op == "add" or rnd.random() < 0.8 else rnd.choice([11, 12, 13, 14, 15])
        q = rnd.choice([None, 0, 1, 1, 2, 3, 5]) if op != "remove" else None
        rows.append((i, T0 + dt.timedelta(seconds=rnd.randint(0, 300)), user, op,
                     opt if op == "add" else None, cid, q))
    df = spark.createDataFrame(rows, schemas.CART_CHANGES)
    out = cart.apply_cart_changes(t, df)
    want_st, want_cart = _loop(cart_rows, stock, rows)
    assert {r.request_id: r.status for r in out["status"].collect()} == want_st
    assert {r.cart_id: (r.user_id, r.option_id, r.quantity) for r in out["cart"].collect()} == want_cart


def test_checkout_statuses_and_outputs(spark):
    from conftest import ts
    shop = make_shop(spark)
    cart_rows = [(r.cart_id, r.user_id, r.option_id, r.quantity, r.created_at, r.updated_at)
                 for r in shop["cart"].collect()] + [(16, 5, 10, 1, ts(2025, 3, 6), ts(2025, 3, 6))]
    t = make_shop(spark, cart=cart_rows)
    req = spark.createDataFrame([
        (1, 1, "addr", "card", None),          # paid: all of user 1's rows (11, 12)
        (2, 1, "addr", "card", [11]),          # empty: row 11 was bought by request 1
        (3, 2, "addr", "card", [13, 14]),      # insufficient_stock: row 13 wants 5 of stock 3
        (4, 3, "", "card", None),              # invalid: no address
        (5, 9, "addr", "card", None),          # empty: no cart
        (6, 3, "addr", "card", [15]),          # paid: the invalid request before blocks nobody
        (7, 5, "addr", "card", None),          # unknown_reference: user 5 has a cart row but no account
        (8, 2, "addr", "card", [14]),          # paid: a user's next request on another row
        (1000, 2, "addr", "card", [13]),       # insufficient_stock comes before the stored order's id
    ], schemas.CHECKOUT_REQUESTS)
    as_of = dt.datetime(2025, 1, 15)           # variant 103's sale (10%) is running
    out = checkout.checkout(t, req, as_of)
    st = {r.request_id: r.status for r in out["status"].collect()}
    assert st == {1: "paid", 2: "empty", 3: "insufficient_stock", 4: "invalid", 5: "empty", 6: "paid",
                  7: "unknown_reference", 8: "paid", 1000: "insufficient_stock"}
    orders = {r.order_id: float(r.total_amount) for r in out["orders"].collect()}
    assert set(orders) == {1, 6, 8} and orders[1] == 2 * 159000 + 143100
    items = sorted((r.order_id, r.option_id, r.quantity, float(r.price)) for r in out["order_items"].collect())
    assert items[:2] == [(1, 1, 2, 159000.0), (1, 7, 1, 143100.0)] and len(items) == 4
    assert out["order_items"].select("order_item_id").distinct().count() == 4
    stock = {r.option_id: r.stock_quantity for r in out["product_options"].collect()}
    assert stock[1] == 8 and stock[7] == 3 and stock[3] == 3
    sold = {r.variant_id: r.sold_count for r in out["product_variants"].collect()}
    assert sold[101] == 1522 and sold[103] == 1201 and sold[102] is None
    assert sorted(r.cart_id for r in out["cart"].collect()) == [13, 16]   # rejected rows stay
    # invariant: stock before - after = quantity sold
    before = {r.option_id: r.stock_quantity for r in t["product_options"].collect()}
    bought = sum(r.quantity for r in out["order_items"].collect())
    assert sum(before.values()) - sum(stock.values()) == bought


def _serve_loop(cart_rows, stock, known, requests):
    """The checkout handler as a plain loop over the requests."""
    cart_rows, stock, out = dict(cart_rows), dict(stock), {}
    for rid, user, address, pay, ids in sorted(requests):
        if not address or not pay or user is None:
            out[rid] = ("invalid", 0)
            continue
        rows = [c for c, (u, _, _) in cart_rows.items() if u == user and (not ids or c in ids)]
        if not rows:
            out[rid] = ("empty", 0)
        elif any(stock[cart_rows[c][1]] < cart_rows[c][2] for c in rows):
            out[rid] = ("insufficient_stock", len(rows))
        elif user not in known:
            out[rid] = ("unknown_reference", len(rows))
        else:
            out[rid] = ("paid", len(rows))
            for c in rows:
                _, o, q = cart_rows.pop(c)
                stock[o] -= q
    return out, cart_rows, stock


def _contended(spark, seed, n=120):
    rnd = random.Random(seed)
    options = [(o, 101, str(o), rnd.randint(0, 9)) for o in range(1, 9)]
    cart_rows = {c: (rnd.randint(1, 6), rnd.randint(1, 8), rnd.randint(1, 3)) for c in range(1, 90)}
    t0 = dt.datetime(2025, 3, 1)
    t = make_shop(spark, product_options=options, cart=[(c, *v, t0, t0) for c, v in cart_rows.items()])
    requests = [(5000 + k, rnd.randint(1, 6), rnd.choice(["a", "a", "a", ""]), "card",
                 rnd.choice([None, rnd.sample(range(1, 90), 30), rnd.sample(range(1, 90), 12)])) for k in range(n)]
    return t, cart_rows, {o[0]: o[3] for o in options}, requests


@pytest.mark.parametrize("large", [0, 60, 100_000])
def test_checkout_in_order_equals_a_loop(spark, large):
    t, cart_rows, stock, requests = _contended(spark, 7)
    want, cart_left, stock_left = _serve_loop(cart_rows, stock, {1, 2, 3}, requests)
    out = checkout.checkout(t, spark.createDataFrame(requests, schemas.CHECKOUT_REQUESTS), dt.datetime(2025, 1, 15), large=large)
    assert {r.request_id: (r.status, r.line_count) for r in out["status"].collect()} == want
    assert {r.cart_id for r in out["cart"].collect()} == set(cart_left)
    assert {r.option_id: r.stock_quantity for r in out["product_options"].collect()} == stock_left
    assert min(stock_left.values()) >= 0


def test_a_chain_of_decisions_is_followed_to_its_end(spark):
    """Each request hangs on the one before; with and without sure decisions first."""
    options = [(o, 101, str(o), 1) for o in range(1, 13)]
    t0 = dt.datetime(2025, 3, 1)
    cart_rows = {10 * o + k: (1, o, 1) for o in range(1, 13) for k in (0, 1)}
    t = make_shop(spark, product_options=options, cart=[(c, *v, t0, t0) for c, v in cart_rows.items()])
    # each request wants an option's last piece, and the piece of the request before
    requests = [(7000 + o, 1, "a", "card", [10 * o, 10 * (o - 1) + 1] if o > 1 else [10]) for o in range(1, 13)]
    want, cart_left, stock_left = _serve_loop(cart_rows, {o[0]: o[3] for o in options}, {1, 2, 3}, requests)
    assert {s for s, _ in want.values()} == {"paid", "insufficient_stock"}
    feed = spark.createDataFrame(requests, schemas.CHECKOUT_REQUESTS)
    for large in (0, checkout.LARGE):
        out = checkout.checkout(t, feed, dt.datetime(2025, 1, 15), large=large)
        assert {r.request_id: (r.status, r.line_count) for r in out["status"].collect()} == want
        assert {r.option_id: r.stock_quantity for r in out["product_options"].collect()} == stock_left


def test_components_of_contention(spark, monkeypatch):
    """Users meet at scarce options only; two components are served apart, a flash sale is decided by sure steps."""
    t0 = dt.datetime(2025, 3, 1)
    options = [(1, 101, "1", 3), (2, 101, "2", 3), (3, 101, "3", 1000), (4, 101, "4", 5)]
    cart_rows = {100 + k: (k, 1 if k < 5 else 2, 1) for k in range(1, 10)}                  # users 1-4 want option 1, 5-9 option 2
    cart_rows |= {200 + k: (k, 3, 2) for k in range(1, 10)}                                 # and all of them plenty of option 3
    cart_rows |= {1000 + k: (1000 + k, 4, 1) for k in range(60)}                            # 60 users, 5 pieces of option 4
    users = [(k, f"u{k}@x", "n", "USER") for k in [*range(1, 10), *range(1000, 1060)]]
    t = make_shop(spark, product_options=options, cart=[(c, *v, t0, t0) for c, v in cart_rows.items()], users=users)
    requests = [(5000 + k, u, "a", "card", None) for k, u in enumerate([*range(9, 0, -1), *range(1000, 1060), *range(1, 10)])]
    want, cart_left, stock_left = _serve_loop(cart_rows, {o[0]: o[3] for o in options}, {u[0] for u in users}, requests)
    feed = spark.createDataFrame(requests, schemas.CHECKOUT_REQUESTS)
    req = checkout.prepare_requests(feed)
    lines = checkout.price_checkout_lines(t, req, dt.datetime(2025, 1, 15)).withColumnRenamed("stock_quantity", "stock").selectExpr("*", "true AS known")
    state = checkout._contention(lines)
    assert {r.option_id for r in state.filter("scarce").collect()} == {1, 2, 4}
    found = checkout.components(state.filter("scarce").selectExpr("user_id AS node", "option_id AS `group`"))
    assert sorted(r["count"] for r in found.groupBy("component").count().collect()) == [4, 5, 60]
    for large in (10, checkout.LARGE):
        out = checkout.checkout(t, feed, dt.datetime(2025, 1, 15), large=large)
        assert {r.request_id: (r.status, r.line_count) for r in out["status"].collect()} == want
        assert {r.cart_id for r in out["cart"].collect()} == set(cart_left)
        assert {r.option_id: r.stock_quantity for r in out["product_options"].collect()} == stock_left


def test_components_of_chains_stars_and_singles(spark):
    from cobbler.plans.components import components
    rnd = random.Random(2)
    members = [(k, 10_000 + k) for k in range(40)] + [(k + 1, 10_000 + k) for k in range(40)]           # a chain of 41
    members += [(100 + k, 1) for k in range(50)] + [(200, 2), (None, 2), (201, None)]
    members += [(300 + rnd.randrange(80), 500 + rnd.randrange(60)) for _ in range(70)] + members[:5]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    whole = [m for m in members if None not in m]
    for n, g in whole:
        a, b = sorted((root(("n", n)), root(("g", g))), reverse=True)
        parent[b] = a if a[0] == "n" else parent[b]
        parent[a] = b if a[0] == "g" else a
        if a[0] == b[0]:
            parent[max(a, b)] = min(a, b)
    groups = {}
    for n, _ in whole:
        groups.setdefault(root(("n", n)), set()).add(n)
    want = {n: min(s) for s in groups.values() for n in s}
    got = {r.node: r.component for r in components(spark.createDataFrame(members, "node long, `group` long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "node long, `group` long")).count() == 0


def test_checkout_in_five_batches_equals_one(spark):
    t, cart_rows, stock, requests = _contended(spark, 9, 60)
    want, cart_left, stock_left = _serve_loop(cart_rows, stock, {1, 2, 3}, requests)
    state, statuses = dict(t), {}
    for k in range(0, 60, 12):
        feed = spark.createDataFrame(requests[k:k + 12], schemas.CHECKOUT_REQUESTS)
        out = checkout.checkout(state, feed, dt.datetime(2025, 1, 15))
        for name in ("cart", "product_options", "product_variants"):
            state[name] = spark.createDataFrame(out[name].collect(), out[name].schema)
        statuses |= {r.request_id: (r.status, r.line_count) for r in out["status"].collect()}
    assert statuses == want
    assert {r.option_id: r.stock_quantity for r in state["product_options"].collect()} == stock_left


def test_checkout_outside_sale_pays_base_price(spark):
    t = make_shop(spark)
    req = spark.createDataFrame([(1, 1, "addr", "card", [12])], schemas.CHECKOUT_REQUESTS)
    lines = checkout.serve(t, req, dt.datetime(2025, 3, 1))[0].collect()
    assert [(r.cart_id, r.unit_price) for r in lines] == [(12, 159000)]


def test_hot_cart_row_spread_over_partitions_matches_loop(spark):
    """One (user, option) key holds most of the feed; it spans many range partitions."""
    rnd = random.Random(23)
    t = make_shop(spark)
    stock = {r.option_id: r.stock_quantity for r in t["product_options"].collect()}
    cart_rows = [(r.cart_id, r.user_id, r.option_id, r.quantity) for r in t["cart"].collect()]
    rows = []
    for i in range(1, 3001):
        hot = rnd.random() < 0.8
        user, opt = (1, 1) if hot else (rnd.choice([2, 3]), rnd.choice([3, 10, 11]))
        op = rnd.choice(["add", "add", "add", "set", "remove"])
        cid = rnd.choice([11, 1001]) if (hot and op != "add") else user * 1000 + opt
        if hot and op == "add" and rnd.random() < 0.5:
            cid = 1001
        q = rnd.choice([1, 2, 3, 4]) if op != "remove" else None
        rows.append((i, T0 + dt.timedelta(seconds=i // 3), user, op, opt if op == "add" else None, cid, q))
    df = spark.createDataFrame(rows, schemas.CART_CHANGES)
    out = cart.apply_cart_changes(t, df, partitions=16)
    want_st, want_cart = _loop(cart_rows, stock, rows)
    assert {r.request_id: r.status for r in out["status"].collect()} == want_st
    assert {r.cart_id: (r.user_id, r.option_id, r.quantity) for r in out["cart"].collect()} == want_cart


def test_checkout_invariants_on_generated_data(spark):
    """SURVEY §5 invariants: item totals add up to the order total; stock falls by exactly what
    was sold; a rejected request changes nothing."""
    from pyspark.sql import functions as F

    from cobbler.sources.testdata import GeneratedShop
    shop = GeneratedShop(spark, "/root/testdata/sf0.001")
    t = shop.tables()
    out = checkout.checkout(t, shop.checkout_requests, "1998-06-15 00:00:00")
    items = out["order_items"].groupBy(F.col("order_id")).agg(F.sum(F.col("price") * F.col("quantity")).alias("s"))
    for r in out["orders"].join(items, "order_id").collect():
        assert float(r.total_amount) == float(r.s)
    sold = out["order_items"].agg(F.sum("quantity")).first()[0] or 0
    before = t["product_options"].agg(F.sum("stock_quantity")).first()[0]
    after = out["product_options"].agg(F.sum("stock_quantity")).first()[0]
    assert before - after == sold
    rejected = out["status"].filter(F.col("status") != "paid").select("request_id")
    kept = {r.cart_id for r in out["lines"].join(rejected, "request_id", "left_semi").select("cart_id").collect()}
    bought = {r.cart_id for r in out["lines"].join(rejected, "request_id", "left_anti").select("cart_id").collect()}
    left = {r.cart_id for r in out["cart"].select("cart_id").collect()}
    assert kept - bought <= left and not bought & left        # their cart rows remain, unless bought by another request
    assert out["status"].filter(F.col("status") == "paid").count() > 0
    assert out["product_options"].filter("stock_quantity < 0").count() == 0


def test_edge_inputs(spark):
    from cobbler.operators import catalog, sales
    t = make_shop(spark)
    # a feed without ts applies in request_id order
    feed = spark.createDataFrame([(2, 1, "add", 1, None, 1), (1, 1, "add", 1, None, 8)],
                                 "request_id bigint, user_id bigint, op string, option_id bigint, cart_id bigint, "
                                 "quantity int")
    out = cart.apply_cart_changes(t, feed)
    assert {r.request_id: r.status for r in out["status"].collect()} == {1: "accepted", 2: "stock"}
    assert {r.cart_id: r.quantity for r in out["cart"].collect()}[11] == 10
    # an empty checkout batch changes nothing
    none = spark.createDataFrame([], schemas.CHECKOUT_REQUESTS)
    res = checkout.checkout(t, none, dt.datetime(2025, 1, 1))
    assert res["orders"].count() == 0 and res["cart"].count() == t["cart"].count()
    # empty results where nothing qualifies
    assert sales.sales_summary(t, "1990-01-01", "1990-12-31").count() == 0
    assert catalog.gender_catalog(t, dt.datetime(2025, 1, 1), "KIDS").count() == 0


def test_cart_feed_with_null_time_null_user_and_a_gone_option(spark):
    from conftest import ts
    rows = [(11, 1, 1, 2, ts(2025, 3, 1), ts(2025, 3, 1)), (12, 1, 77, 1, ts(2025, 3, 1), ts(2025, 3, 1)),
            (13, 2, 77, 1, ts(2025, 3, 1), ts(2025, 3, 1))]
    t = make_shop(spark, cart=rows)            # option 77 does not exist any more
    changes = spark.createDataFrame([
        (1, None, 1, "add", 1, None, 1), (2, T0, None, "add", 1, None, 1), (3, T0, 1, "set", None, 12, 2),
        (4, T0, 2, "remove", None, 13, None), (5, T0, 1, None, 1, None, 1), (6, T0, 1, "set", None, 11, 5)],
        "request_id bigint, ts timestamp, user_id bigint, op string, option_id bigint, cart_id bigint, quantity int")
    out = cart.apply_cart_changes(t, changes)
    assert {r.request_id: r.status for r in out["status"].collect()} == {
        1: "accepted", 2: "invalid", 3: "not_found", 4: "accepted", 5: "invalid", 6: "accepted"}
    assert {r.cart_id: r.quantity for r in out["cart"].collect()} == {11: 5, 12: 1}


def test_components_equal_a_union_find(spark):
    """The rows of the test of chains, stars and singles, against a union-find in which a root never points below itself."""
    from cobbler.plans.components import components
    rnd = random.Random(2)
    members = [(k, 10_000 + k) for k in range(40)] + [(k + 1, 10_000 + k) for k in range(40)]
    members += [(100 + k, 1) for k in range(50)] + [(200, 2), (None, 2), (201, None)]
    members += [(300 + rnd.randrange(80), 500 + rnd.randrange(60)) for _ in range(70)] + members[:5]
    parent, met = {}, {}

    def root(n):
        while parent.setdefault(n, n) != n:
            n = parent[n]
        return n
    for n, g in members:
        if n is not None:
            a, b = root(n), root(met.setdefault(g, n) if g is not None else n)
            parent[max(a, b)] = min(a, b)
    whole = {n for n, g in members if n is not None and g is not None}
    got = {r.node: r.component for r in components(spark.createDataFrame(members, "node long, `group` long")).collect()}
    assert got == {n: root(n) for n in whole}
    assert len(set(got.values())) > 3 and got[40] == 0 and got[200] == 200
