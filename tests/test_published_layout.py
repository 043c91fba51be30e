"""What a published shop adds: items by month, the sales rollup, files rewritten only where a batch touches them."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cobbler.operators import sales
from cobbler.plans import jobs, snapshots
from cobbler.sources import schemas
from conftest import D, make_shop, ts


def _root():
    return tempfile.mkdtemp(prefix="shop-", dir="/tmp")


def _summary(t, *days):
    return sorted((r.variant_id, r.total_qty, float(r.total_revenue), [tuple(h) for h in r.daily_history])
                  for r in sales.sales_summary(t, *days, sort=False).collect())


def test_day_range_reads_only_its_months_and_rollup_equals_items(spark):
    t = make_shop(spark, orders=make_shop(spark)["orders"].collect() + [
        (1005, 1, D("5"), "a", "card", "paid", ts(2025, 4, 30, 23)), (1006, 1, D("5"), "a", "card", "PAID", ts(2025, 5, 1)), (1007, 1, D("5"), "a", "card", "paid", None)],
        order_items=make_shop(spark)["order_items"].collect() + [(5100 + k, 1005 + k, 1, 2, D("3"), None) for k in range(3)] + [(5200, 9999, 1, 1, D("1"), None)])
    root = _root()
    snapshots.publish(spark, root, 0, replace=jobs.first_batch(t))
    stored = snapshots.read_current(spark, root)
    items = {k: v for k, v in stored.items() if k != "sales_rollup"}
    for days in (("2025-03-01", "2025-03-31"), ("2025-04-30", "2025-05-01"), ("2025-03-02", "2025-12-31"), ("1990-01-01", "1990-01-02")):
        assert _summary(stored, *days) == _summary(items, *days) == _summary(t, *days)
    plan = sales.sales_summary(items, "2025-04-01", "2025-04-30")._jdf.queryExecution().executedPlan().toString()
    assert any("PartitionFilters" in line and "order_month" in line and "202504" in line for line in plan.splitlines())
    plan = sales.sales_summary(stored, "2025-04-01", "2025-04-30")._jdf.queryExecution().executedPlan().toString()
    assert "order_id" not in plan               # neither items nor orders are read
    assert sum(1 for d in os.listdir(snapshots.current_paths(spark, root)[1]["order_items"][0]) if d.startswith("order_month=")) == 4


def test_checkout_adds_to_the_rollup_and_the_month(spark):
    root = _root()
    snapshots.publish(spark, root, 0, replace=jobs.first_batch(make_shop(spark)))
    for batch, req in ((1, [(2001, 1, "addr", "card", None)]), (2, [(2002, 3, "addr", "card", None), (2003, 2, "addr", "card", [14])])):
        feed = spark.createDataFrame(req, schemas.CHECKOUT_REQUESTS)
        snapshots.run_batch(spark, root, batch, lambda t, feed=feed: jobs.checkout_job(t, feed, dt.datetime(2025, 1, 15)))
    stored = snapshots.read_current(spark, root)
    items = {k: v for k, v in stored.items() if k != "sales_rollup"}
    assert _summary(stored, "2024-01-01", "2026-01-01") == _summary(items, "2024-01-01", "2026-01-01")
    assert stored["order_items"].filter("order_month = 202501").count() == 4
    parts = stored["sales_rollup"].count()
    snapshots.compact(spark, root, parts=2, merge=jobs.MERGE)
    again = snapshots.read_current(spark, root)
    assert again["sales_rollup"].count() <= parts and again["sales_rollup"].groupBy("option_id", "sales_day").count().filter("count > 1").count() == 0
    assert _summary(again, "2024-01-01", "2026-01-01") == _summary(stored, "2024-01-01", "2026-01-01")


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def _wide_shop(spark):
    """200 variants with two options each, in several files."""
    day = dt.date(2025, 1, 1)
    return make_shop(
        spark, product_variants=[(k, 1 + k % 6, "c", None, None, None, None, None, day, 0) for k in range(200)],
        product_options=[(10 * k + j, k, str(250 + j), 5) for k in range(200) for j in range(2)],
        cart=[(1000 + u, u, 10 * (u % 200), 1, ts(2025, 1, 1), ts(2025, 1, 1)) for u in range(300)],
        users=[(u, f"u{u}@x", "n", "USER") for u in range(300)])


def test_a_small_batch_rewrites_only_the_files_it_touches(spark, uncoalesced):
    root = _root()
    snapshots.publish(spark, root, 0, replace=_wide_shop(spark))
    before = snapshots.current_paths(spark, root)[1]
    assert all(len(before[t]) >= 3 for t in snapshots.SLICED)
    feed = spark.createDataFrame([(1, 3, "addr", "card", None), (2, 4, "addr", "card", None)], schemas.CHECKOUT_REQUESTS)
    t0 = snapshots.read_current(spark, root)
    snapshots.run_batch(spark, root, 1, lambda t: jobs.checkout_job(t, feed, dt.datetime(2025, 1, 15)))
    after = snapshots.current_paths(spark, root)[1]
    for name in snapshots.SLICED:
        assert 0 < len(set(before[name]) & set(after[name])) < len(before[name]), name
    now = snapshots.read_current(spark, root)
    assert {r.cart_id for r in t0["cart"].collect()} - {r.cart_id for r in now["cart"].collect()} == {1003, 1004}
    stock = {r.option_id: r.stock_quantity for r in now["product_options"].collect()}
    assert len(stock) == 400 and {o for o, s in stock.items() if s != 5} == {30, 40} and stock[30] == 4
    assert sum(r.sold_count for r in now["product_variants"].collect()) == 2

    changes = spark.createDataFrame([(1, 199, 30, True, [("251", 77), ("new", 1)])], schemas.VARIANT_CHANGES)
    snapshots.run_batch(spark, root, 2, lambda t: jobs.update_variants_job(t, changes))
    images = spark.createDataFrame([(1, 0, "img/0.jpg")], schemas.IMAGE_CHANGES)
    snapshots.run_batch(spark, root, 3, lambda t: jobs.set_images_job(t, images))
    later = snapshots.current_paths(spark, root)[1]
    assert set(after["cart"]) == set(later["cart"]) and set(after["product_options"]) & set(later["product_options"])
    end = snapshots.read_current(spark, root)
    assert {(r.size, r.stock_quantity) for r in end["product_options"].filter("variant_id = 199").collect()} == {("250", 5), ("251", 77), ("new", 1)}
    assert end["product_options"].count() == 401 and end["product_variants"].count() == 200
    v = {r.variant_id: r for r in end["product_variants"].collect()}
    assert v[199].discount_rate == 30 and v[0].representative_image_url == "img/0.jpg" and v[1].discount_rate is None


def test_a_change_that_touches_nothing_and_one_that_empties_a_table(spark, uncoalesced):
    root = _root()
    snapshots.publish(spark, root, 0, replace={"cart": _wide_shop(spark)["cart"]})
    before = snapshots.current_paths(spark, root)[1]["cart"]
    none = spark.createDataFrame([(10**6,)], "user_id long")
    snapshots.publish(spark, root, 1, change={"cart": snapshots.Change(none, lambda old: old)})
    assert set(before) <= set(snapshots.current_paths(spark, root)[1]["cart"]) and snapshots.read_current(spark, root)["cart"].count() == 300
    every = spark.range(300).select(F.col("id").alias("user_id"))
    snapshots.publish(spark, root, 2, change={"cart": snapshots.Change(every, lambda old: old.limit(0))})
    assert snapshots.read_current(spark, root)["cart"].count() == 0
    some = make_shop(spark)["cart"]
    snapshots.publish(spark, root, 3, change={"cart": snapshots.Change(some.select("user_id"), lambda old: old.unionByName(some))})
    assert snapshots.read_current(spark, root)["cart"].count() == 5


def test_tables_of_a_job_are_dropped_when_its_batch_is_published(spark):
    from cobbler.session import ensure_checkpoint_dir
    made = os.path.join(ensure_checkpoint_dir(spark), "cobbler-tables")
    before = set(os.listdir(made)) if os.path.isdir(made) else set()
    root = _root()
    snapshots.publish(spark, root, 0, replace=make_shop(spark))
    feed = spark.createDataFrame([(1, 1, "addr", "card", None)], schemas.CHECKOUT_REQUESTS)
    snapshots.run_batch(spark, root, 1, lambda t: jobs.checkout_job(t, feed, dt.datetime(2025, 1, 15)))
    assert set(os.listdir(made)) == before
    assert snapshots.read_current(spark, root)["orders"].count() == 6


def test_bad_bodies_are_set_apart(spark):
    from cobbler.sources.tables import parse_bodies
    good = '{"request_id": 1, "user_id": 1, "op": "add", "option_id": 1, "quantity": 2, "ts": "2025-04-01T00:00:00Z", "more": [1]}'
    bodies = [good, good[:-1], '{"request_id": 2, "quantity": "two"}', '{"user_id": 1, "op": "add"}', "", "  ", None, "null", "[]", "7",
              '{"request_id": "x"}', '{"request_id": null}']
    ok, bad = parse_bodies(spark.createDataFrame([(b,) for b in bodies], "body string"), schemas.CART_CHANGES)
    assert ok.columns == schemas.CART_CHANGES.fieldNames() and [(r.request_id, r.op, r.quantity) for r in ok.collect()] == [(1, "add", 2)]
    reasons = [(r.body, r.reason, r.request_id) for r in bad.collect()]
    assert len(reasons) == len(bodies) - 1
    assert {b: r for b, r, _ in reasons if b in (good[:-1], "", "  ", None, '{"user_id": 1, "op": "add"}', '{"request_id": "x"}')} == {
        good[:-1]: "malformed", "": "empty", "  ": "empty", None: "empty", '{"user_id": 1, "op": "add"}': "missing request_id", '{"request_id": "x"}': "malformed"}
    assert ('{"request_id": 2, "quantity": "two"}', "malformed", 2) in reasons
    root = _root()
    snapshots.publish(spark, root, 0, replace=make_shop(spark))
    feed = spark.createDataFrame([(b,) for b in bodies], "body string")
    snapshots.run_batch(spark, root, 1, lambda t: jobs.quarantined(jobs.cart_changes_job, schemas.CART_CHANGES, "cart")(t, feed))
    t = snapshots.read_current(spark, root)
    assert t["malformed_requests"].count() == len(bodies) - 1 and {r.status for r in t["malformed_requests"].collect()} == {"malformed"}
    assert t["cart_change_status"].count() == 1


def test_lookups_screen_the_stored_side_at_its_scan(spark):
    from cobbler.functions.columns import ci_key
    from cobbler.plans import lookups
    path = _root() + "/users"
    spark.range(200_000).selectExpr("id AS user_id", "concat('U', id, '@x') AS email").write.parquet(path)
    stored = spark.read.parquet(path)
    feed = spark.createDataFrame([(k * 1000 + 7,) for k in range(300)] + [(None,), (10**9,)], "user_id int")
    plain = {r.user_id for r in lookups.keys_named(stored, feed, "user_id").collect()}
    wanted = feed.selectExpr("cast(user_id as long) user_id").dropna().distinct()
    left = lookups.screened(stored, wanted, "user_id")
    assert len(plain) == 200 and 200 <= left.count() <= 260
    spark.conf.set(lookups.SCREEN, "true")
    try:
        found = lookups.keys_named(stored, feed, "user_id", ["email"])
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        join = next(i for i, line in enumerate(plan.splitlines()) if "Join LeftSemi" in line)
        assert any("Filter" in line and "xxhash64" in line for line in plan.splitlines()[join + 1:])       # below the join, at the scan
        assert {r.user_id for r in found.collect()} == plain
        mails = spark.createDataFrame([("u5@X",), ("none",)], "email string").select(ci_key("email").alias("k"))
        assert [r.k for r in lookups.keys_named(stored.select(ci_key("email").alias("k")), mails, "k").collect()] == ["U5@x"]
    finally:
        spark.conf.unset(lookups.SCREEN)


def test_option_details_are_listed_by_file_where_a_shop_keeps_them(spark, uncoalesced):
    from cobbler.operators import catalog
    root, t = _root(), _wide_shop(spark)
    snapshots.publish(spark, root, 0, replace=t | {"option_details": catalog.option_details(t)})
    rows = [r for r in snapshots.manifest(spark, root) if r.table == "option_details"]
    assert len(rows) >= 3 and all(r.lo is not None and r.lo <= r.hi for r in rows)
    before = set(snapshots.current_paths(spark, root)[1]["option_details"])
    changes = spark.createDataFrame([(1, 199, 30, True, [("251", 77)])], schemas.VARIANT_CHANGES)
    snapshots.run_batch(spark, root, 1, lambda now: jobs.update_variants_job(now, changes))
    after = set(snapshots.current_paths(spark, root)[1]["option_details"])
    assert 0 < len(before & after) < len(before)
    assert "option_details" not in snapshots.SLICED         # a shop without the table has no files of it
