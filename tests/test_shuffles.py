"""How much the shop's queries shuffle: catalog tables cross once for small line streams, checks move keys only."""

import datetime as dt

import pytest
from conftest import make_shop
from pyspark.sql import functions as F

from cobbler.operators import cart, catalog, orders, reviews
from cobbler.plans import jobs, snapshots
from cobbler.session import apply_sql_conf
from cobbler.sources.testdata import GeneratedShop


PARTS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
LINES = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
         "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


@pytest.fixture
def shop(spark, tmp_path):
    apply_sql_conf(spark)
    day = dt.datetime(1999, 1, 1)
    part = [(k, f"part {k}", "brand", f"type {k % 2}", k, 10.0 + k) for k in range(5)]
    # ids that give their parts back, and ones that do not: nulls, a tenth line, a supplier above the scale, a negative part
    keys = [(1, 2, 1), (1, 2, 1), (1, 2, 3), (1, 7, 1), (2, 2, 9), (2, 2, 10), (2, 3, 0), (None, 2, 1), (None, 3, 1), (1, None, 1),
            (1, 2, None), (1, 2, None), (0, 1_000_002, 1), (1, 1_000_002, 1), (2, 2, 1), (-1, 3, 1), (-1, -3, -1)]
    line = [(k % 4, *key, float(k), 100.0 + k, k % 3 / 100, "RNA"[k % 3], "OF"[k % 2], day + dt.timedelta(days=k)) for k, key in enumerate(keys)]
    event = [(k, day, k % 3, ("click", "signup", "view", "purchase")[k % 4], 0.0, '{"k": %d}' % (k % 3)) for k in range(24)]
    order = [(k, k % 3, "FOP"[k % 3], 5.0, day, "high") for k in range(4)]
    for name, rows, schema in (("part", part, PARTS), ("lineitem", line, LINES), ("events", event, EVENTS), ("orders", order, ORDERS)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return GeneratedShop(spark, str(tmp_path))


def _exchanges(df, text="hashpartitioning"):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum(f"Exchange {text}" in x for x in plan.splitlines())


def _rows(df):
    return sorted(map(str, df.collect()))


def test_options_and_variants_of_any_keys_are_the_groups_of_lines(shop):
    li = shop.raw("lineitem")
    variant = F.col("l_partkey") * 1000000 + F.col("l_suppkey")
    options = li.groupBy("l_partkey", "l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("q")).select(
        (variant * 10 + F.col("l_linenumber")).alias("option_id"), variant.alias("variant_id"),
        (220 + 10 * F.col("l_linenumber")).cast("string").alias("size"), (F.col("q").cast("bigint") % 7).cast("int").alias("stock_quantity"))
    assert _rows(shop.product_options) == _rows(options)
    variants = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"), F.max("l_shipdate").alias("last")).select(
        variant.alias("variant_id"), F.col("l_partkey").alias("product_id"), F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("color_name"),
        F.when(F.col("l_suppkey") % 7 != 0, F.concat(F.lit("/images/"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string"), F.lit(".jpg")))
        .alias("representative_image_url"), F.to_date("last").alias("sale_end_date"), F.col("q").cast("bigint").alias("sold_count"))
    assert _rows(shop.product_variants.select(*variants.columns)) == _rows(variants)


def test_a_catalog_table_is_grouped_and_joined_in_one_shuffle(shop):
    t = shop.tables()
    stock = t["product_options"].join(t["product_options"].groupBy("option_id").agg(F.count("*").alias("n")), "option_id")
    assert _exchanges(stock) == 2          # each side once, for its groups and the join
    assert _exchanges(t["product_variants"]) == 1


def test_cart_lines_meet_each_catalog_table_once(spark, shop):
    t = shop.tables()
    catalog = {c: t[c] for c in ("product_options", "product_variants", "products")}
    # cart by option, variant and product; options, variants and products once each
    assert _exchanges(cart.cart_lines(catalog | {"cart": make_shop(spark)["cart"]}, sort=False)) == 6


def test_the_review_flag_joins_narrow_items(spark):
    apply_sql_conf(spark)
    plan = orders.order_lines(make_shop(spark))._jdf.queryExecution().executedPlan().toString()
    depth = lambda text: [x.index("Exchange") for x in plan.splitlines() if f"Exchange hashpartitioning({text}" in x]
    assert min(depth("option_id")) < min(depth("order_item_id"))        # the flag's join lies below the catalog's


def test_review_checks_move_no_texts_and_keep_them_in_new_rows(spark, monkeypatch):
    t = make_shop(spark)
    req = spark.createDataFrame([(100, dt.datetime(2025, 1, 1), 1, 3, None, 5, "a title", "words"), (101, dt.datetime(2025, 1, 1), 1, 3, 5000, 9, "no", "no")],
                                "request_id long, ts timestamp, user_id long, product_id long, order_item_id long, rating int, title string, content string")
    made, real = [], reviews.materialize
    monkeypatch.setattr(reviews, "materialize", lambda df, how: made.append(df.columns) or real(df, how))
    out = reviews.intake_reviews(t, req, dt.datetime(2025, 2, 1))
    assert made and not any({"title", "content"} & set(c) for c in made)
    assert {r.request_id: r.status for r in out["status"].collect()} == {100: "accepted", 101: "bad_rating"}
    assert [(r.title, r.content, r.rating) for r in out["reviews"].collect()] == [("a title", "words", 5)]


def test_requests_of_an_item_come_from_one_join(shop):
    req = shop.review_requests
    assert _exchanges(req, "hashpartitioning(l_orderkey") <= 1
    got = {r.request_id for r in req.collect()}
    items = [r.order_item_id for r in shop.order_items.collect()]
    assert {2 * 10 ** 12 + i for i in items} | {3 * 10 ** 12 + i for i in items if i % 1000 == 1} <= got


def test_keys_stored_twice_give_new_reviews_twice(spark):
    t = make_shop(spark)
    t["users"] = t["users"].unionByName(t["users"].filter("user_id = 1"))
    new = lambda n, user: (n, dt.datetime(2025, 1, 1), user, 5, None, 4, f"{n}", "x")
    req = spark.createDataFrame([new(100, 1), new(101, 2), new(102, None)],
                                "request_id long, ts timestamp, user_id long, product_id long, order_item_id long, rating int, title string, content string")
    got = reviews.intake_reviews(t, req, dt.datetime(2025, 2, 1))["reviews"].collect()
    assert sorted((r.review_id, r.title) for r in got) == [(100, "100"), (100, "100"), (101, "101"), (102, "102")]


def _final(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_items_are_numbered_in_one_shuffle_whatever_is_asked_of_them(shop):
    t = shop.tables()
    lines = orders.order_lines(t)
    # items, their ids and the items of reviews
    assert "ReusedExchange" in _final(lines)
    # what is made of a line's columns is made after the shuffle
    scans = {x.split("ReadSchema: ")[1] for x in lines._jdf.queryExecution().explainString(
        lines.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "ReadSchema: struct<l_orderkey" in x}
    assert len(scans) == 1
    plan = t["order_items"].select("order_item_id", "option_id", "price")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange hashpartitioning(l_orderkey"):]
    assert "1000000" not in below and "decimal(12,2)" not in below


def test_lines_with_catalog_columns_move_no_more_or_once(shop):
    t = shop.tables()
    plan = orders.order_lines(t)._jdf.queryExecution().executedPlan().toString()
    depth = lambda text: [x.index("Exchange") for x in plan.splitlines() if f"Exchange hashpartitioning({text}" in x]
    assert min(depth("option_id")) < min(depth("order_id"))
    final = _final(orders.order_history(t))
    assert final.count("Exchange rangepartitioning(") == 1 and "Exchange rangepartitioning(created_at" in final


@pytest.mark.parametrize("order", ["intended", "observed", None])
def test_history_of_odd_rows_is_each_header_with_its_lines(spark, order):
    apply_sql_conf(spark)
    t = make_shop(spark)
    same, other = dt.datetime(2025, 1, 1), dt.datetime(2024, 1, 1)
    head = lambda o, user, at: (o, user, 5, "there", "card", "paid", at)
    heads = [head(1, 1, same), head(2, 1, same), head(2, 1, same), head(2, 3, other), head(3, None, None), head(None, 1, same), head(4, 1, same)]
    t["orders"] = spark.createDataFrame([(*h[:2], float(h[2]), *h[3:]) for h in heads], "order_id long, user_id long, total_amount double, "
                                        "shipping_address string, payment_method string, status string, created_at timestamp")
    items = [(10, 1, 1), (11, 1, 7), (11, 2, 1), (None, 2, 1), (12, 2, 999), (13, 3, 3), (14, None, 1), (15, 9, 1)]
    t["order_items"] = spark.createDataFrame([(*i, 1, 2.0, same) for i in items], "order_item_id long, order_id long, option_id long, quantity int, price double, created_at timestamp")
    t["reviews"] = spark.createDataFrame([(1, 1, 11), (2, 1, 11), (3, 1, None), (4, 1, 99)], "review_id long, product_id long, order_item_id long")
    kept = [i for i in items if i[2] != 999]
    want = [(h[0], h[1], h[6], sorted(((i[0], i[2], i[0] == 11) for i in kept if i[1] == h[0]), key=lambda x: (x[0] is not None, x[0])))
            for h in heads if h[0] is not None and any(i[1] == h[0] for i in kept)]
    got = [(r.order_id, r.user_id, r.created_at, [(i.order_item_id, i.option_id, i.is_review_written) for i in r["items"]])
           for r in orders.order_history(t, order=order).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    if order == "intended":
        assert [(g[2], g[0]) for g in got] == sorted(((g[2], g[0]) for g in got), key=lambda x: (x[0] is None, -(x[0] or same).timestamp(), -x[1]))
    lines = [(r.order_id, r.user_id, r.order_item_id, r.option_id, r.is_review_written) for r in orders.order_lines(t).collect()]
    assert sorted(map(str, lines)) == sorted(str((w[0], w[1], *i)) for w in want for i in w[3])


REQUESTS = "request_id long, ts timestamp, user_id long, product_id long, order_item_id long, rating int, title string, content string"


def test_requests_move_for_their_items_only(spark, monkeypatch):
    apply_sql_conf(spark)
    t = make_shop(spark)
    req = spark.createDataFrame([(100 + k, dt.datetime(2025, 1, 1), 1 + k % 2, 3, k % 3 or None, 5, "a", "b") for k in range(9)], REQUESTS)
    made, real = [], reviews.materialize
    monkeypatch.setattr(reviews, "materialize", lambda df, how: made.append(df) or real(df, how))
    reviews.intake_reviews(t, req, dt.datetime(2025, 2, 1))
    plan = next(df for df in made if "_fk" in df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(order_item_id" in plan
    assert not any(f"Exchange hashpartitioning({k}" in plan for k in ("user_id", "product_id", "request_id"))


def test_repeated_and_missing_keys_of_a_feed_by_hand(spark):
    apply_sql_conf(spark)
    t = make_shop(spark)
    day = dt.datetime(2025, 1, 1)
    t["users"] = spark.createDataFrame([(1,), (2,), (2,), (3,)], "user_id long")
    t["products"] = spark.createDataFrame([(1,), (3,), (3,), (4,)], "product_id long")
    t["order_items"] = spark.createDataFrame([(10,), (11,), (11,), (0,), (0,), (12,), (None,)], "order_item_id long")
    t["reviews"] = spark.createDataFrame([(900, 1, 1, None), (901, None, 4, 12), (905, 3, 4, None)],
                                         "review_id long, user_id long, product_id long, order_item_id long")
    feed = [(100, 1, 1, 10, 5), (101, 2, 4, 10, 5), (102, 2, 4, 11, 5), (103, 2, 4, None, 5), (104, 1, 1, None, 5), (105, 7, 1, None, 5), (106, None, 3, None, 5),
            (107, 3, 3, 0, 5), (108, 3, 9, None, 5), (109, 3, None, None, 5), (110, 3, 1, None, 9), (900, 3, 1, None, 5), (111, 3, 1, None, 5), (112, 3, 1, 12, 5),
            (113, 3, 1, 77, 5), (114, 1, 3, None, 5), (114, 2, 1, None, 5), (114, 3, 9, None, 5), (None, 1, 4, None, 5), (115, None, 1, 11, 4)]
    req = spark.createDataFrame([(r, day, u, p, i, n, f"{r}", "x") for r, u, p, i, n in feed], REQUESTS)
    many = lambda name, key, k: sum(r[key] == k for r in t[name].collect()) if k is not None else 0
    rows = []
    for r, u, p, i, n in feed:
        times = max(1, many("products", "product_id", p)) * max(1, many("users", "user_id", u)) * max(1, many("order_items", "order_item_id", i)) * max(1, many("reviews", "review_id", r))
        base = "invalid" if not p or not n else "bad_rating" if not 1 <= n <= 5 else "not_found" if not many("products", "product_id", p) else None
        fk = (u is None or many("users", "user_id", u) > 0) and (not i or many("order_items", "order_item_id", i) > 0)
        rows.append([r, u, p, i, times, base, fk, many("reviews", "review_id", r) > 0, None])
    seq = lambda x: -1 if x[0] is None else x[0]
    valid = [x for x in rows if x[5] is None]
    stored = t["reviews"].collect()
    free = lambda x: x[6] and not x[7]
    for x in valid:
        if x[3]:
            first = min((seq(y) for y in valid if y[3] == x[3] and free(y)), default=None)
            x[8] = ("duplicate" if any(s.order_item_id == x[3] for s in stored) or (first is not None and first < seq(x)) else
                    "accepted" if first == seq(x) else "key_conflict" if x[6] else "unknown_reference")
    for x in valid:
        if not x[3]:
            same = lambda y: x[1] is not None and y[1:3] == x[1:3]
            item = min((seq(y) for y in valid if y[3] and same(y) and y[8] == "accepted"), default=None)
            gen = min((seq(y) for y in valid if not y[3] and same(y) and free(y)), default=None)
            taken = any((s.user_id, s.product_id) == (x[1], x[2]) for s in stored)
            gen = gen if gen is not None and not taken and (item is None or item > gen) else None
            first = min((v for v in (item, gen) if v is not None), default=None)
            x[8] = ("accepted" if x[1] is None and free(x) else "duplicate" if x[1] is not None and (taken or (first is not None and first < seq(x))) else
                    "accepted" if gen is not None and gen == seq(x) else "key_conflict" if x[6] else "unknown_reference")
    made = [x for x in rows for _ in range(x[4])]
    want = []
    for x in made:
        own = [y[8] for y in made if y[5] is None and y[0] is not None and y[0] == x[0]] or [None]
        want += [(x[0], x[5] or s) for s in own]
    out = reviews.intake_reviews(t, req, dt.datetime(2025, 2, 1))
    assert sorted(map(str, ((r.request_id, r.status) for r in out["status"].collect()))) == sorted(map(str, want))
    ok = {r for r, s in want if s == "accepted"}
    assert sorted(r.review_id for r in out["reviews"].collect()) == sorted(x[0] for x in made if x[0] in ok)


def test_stored_details_are_not_shuffled_for_few_options(spark):
    apply_sql_conf(spark)
    t = make_shop(spark)
    t["option_details"] = catalog.option_details(t)
    t["cart"] = t["cart"].unionByName(t["cart"].filter("cart_id = 11").withColumns({"cart_id": F.lit(99).cast("long"), "option_id": F.lit(None).cast("long")}))
    lines = cart.cart_lines(t, sort=False)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    plain = cart.cart_lines({k: v for k, v in t.items() if k != "option_details"}, sort=False)
    assert _rows(lines) == _rows(plain) and lines.count() == 5


def test_details_of_a_batch_are_read_from_what_it_wrote(spark, tmp_path):
    apply_sql_conf(spark)
    t = make_shop(spark)
    first = {n: t[n] for n in ("product_options", "product_variants", "products")}
    root = str(tmp_path / "shop")
    snapshots.publish(spark, root, 0, replace=first | {"option_details": catalog.option_details(first)})
    images = spark.createDataFrame([(101, "new.jpg", 1), (301, "other.jpg", 1), (999, "none.jpg", 1)], "variant_id long, image string, request_id long")
    read, real = [], catalog.option_details
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jobs.catalog, "option_details", lambda now: read.append(now["product_variants"].inputFiles()) or real(now))
        snapshots.run_batch(spark, root, 1, lambda now: jobs.set_images_job(now, images))
    assert len(read) == 1 and any("batch=1-" in f for f in read[0])
    now = snapshots.read_current(spark, root)
    kept = now.pop("option_details")
    assert _rows(kept) == _rows(real(now).select(*kept.columns))
    assert {r.image for r in kept.filter("variant_id IN (101, 301)").collect()} == {"new.jpg", "other.jpg"}
