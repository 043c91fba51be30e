"""Snapshot publishing (H6) and the cart change feed as a stream."""

import datetime as dt
import json
import os
import tempfile

from cobbler.plans import snapshots
from cobbler.streaming.cart_feed import start_cart_feed
from conftest import make_shop


def _scratch():
    return tempfile.mkdtemp(prefix="cobbler-test-", dir="/tmp")


def test_publish_replace_and_append(spark):
    root = _scratch()
    t = make_shop(spark)
    snapshots.publish(spark, root, 0, replace=t)
    assert snapshots.read_current(spark, root)["cart"].count() == 5
    new_orders = t["orders"].limit(1)
    snapshots.publish(spark, root, 1, replace={"cart": t["cart"].filter("user_id = 1")},
                      append={"orders": new_orders})
    cur = snapshots.read_current(spark, root)
    assert cur["cart"].count() == 2 and cur["orders"].count() == 6 and cur["products"].count() == 6
    last, paths = snapshots.current_paths(spark, root)
    assert last == 1 and len(paths["orders"]) == 2


def test_cart_feed_stream_applies_micro_batches(spark):
    root, feed_dir, ckpt = _scratch(), _scratch(), _scratch()
    snapshots.publish(spark, root, 0, replace=make_shop(spark))
    t0 = dt.datetime(2025, 4, 1)
    batches = [
        [(1, t0, 1, "add", 1, None, 3), (2, t0 + dt.timedelta(seconds=1), 3, "add", 6, 950, 1)],
        [(3, t0 + dt.timedelta(seconds=2), 1, "remove", None, 12, None),
         (4, t0 + dt.timedelta(seconds=3), 3, "set", None, 950, 1)],
    ]
    keys = ["request_id", "ts", "user_id", "op", "option_id", "cart_id", "quantity"]
    for i, rows in enumerate(batches):
        with open(os.path.join(feed_dir, f"part-{i}.json"), "w") as f:
            for r in rows:
                d = dict(zip(keys, r))
                d["ts"] = d["ts"].isoformat()
                f.write(json.dumps(d) + "\n")
        stamp = 1_700_000_000 + 100 * i                      # the file source orders by modification time
        os.utime(os.path.join(feed_dir, f"part-{i}.json"), (stamp, stamp))
    q = start_cart_feed(spark, root, feed_dir, ckpt, max_files_per_trigger=1)
    q.awaitTermination(120)
    cur = snapshots.read_current(spark, root)
    cart = {r.cart_id: r.quantity for r in cur["cart"].collect()}
    assert cart == {11: 5, 13: 5, 14: 1, 15: 1, 950: 1}
    st = {r.request_id: r.status for r in cur["cart_change_status"].collect()}
    assert st == {1: "accepted", 2: "accepted", 3: "accepted", 4: "accepted"}
    assert snapshots.current_paths(spark, root)[0] == 2


def test_checkout_and_review_jobs_publish_batches(spark):
    from cobbler.plans import jobs
    from cobbler.sources import schemas
    root = _scratch()
    snapshots.publish(spark, root, 0, replace=make_shop(spark))
    req = spark.createDataFrame([(1, 1, "addr", "card", None), (2, 2, "addr", "card", [13])],
                                schemas.CHECKOUT_REQUESTS)
    snapshots.run_batch(spark, root, 1, lambda t: jobs.checkout_job(t, req, dt.datetime(2025, 1, 15)))
    cur = snapshots.read_current(spark, root)
    assert cur["orders"].count() == 6 and cur["order_items"].count() == 8
    assert sorted(r.cart_id for r in cur["cart"].collect()) == [13, 14, 15]
    assert {r.option_id: r.stock_quantity for r in cur["product_options"].collect()}[1] == 8
    assert cur["product_options"].columns == [f.name for f in schemas.PRODUCT_OPTIONS.fields]
    rv = spark.createDataFrame([(50, 1, 2, 5002, 5, "t", "")], schemas.REVIEW_REQUESTS)
    snapshots.run_batch(spark, root, 2, lambda t: jobs.review_intake_job(t, rv, dt.datetime(2025, 2, 1)))
    cur = snapshots.read_current(spark, root)
    assert cur["reviews"].count() == 8 and cur["review_status"].first().status == "accepted"


def test_json_sink_keeps_null_fields(spark):
    from pyspark.sql import functions as F

    from cobbler.operators import catalog
    from cobbler.sources.tables import json_text, write_json
    t = make_shop(spark)
    out = _scratch() + "/admin"
    write_json(catalog.admin_catalog(t).filter("group_id in (5, 6)"), out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".json"))
    assert '"variants":null' in text and '"options":null' in text and '"image":null' in text
    row = spark.range(1).select(json_text(F.struct(F.lit(None).cast("int").alias("a"))).alias("j")).first()
    assert row.j == '{"a":null}'


def test_review_feed_stream(spark):
    from cobbler.plans import jobs
    from cobbler.sources import schemas
    from cobbler.streaming.feeds import start_feed
    root, feed_dir, ckpt = _scratch(), _scratch(), _scratch()
    snapshots.publish(spark, root, 0, replace=make_shop(spark))
    rows = [{"request_id": 70, "user_id": 3, "product_id": 4, "rating": 5},
            {"request_id": 71, "user_id": 3, "product_id": 4, "rating": 4},
            {"request_id": 72, "user_id": 3, "product_id": 77, "rating": 4}]
    with open(os.path.join(feed_dir, "part-0.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rows) + "\n")
    q = start_feed(spark, root, feed_dir, schemas.REVIEW_REQUESTS,
                   lambda t, b: jobs.review_intake_job(t, b, dt.datetime(2025, 2, 1)), ckpt, feed="reviews")
    q.awaitTermination(120)
    cur = snapshots.read_current(spark, root)
    assert {r.request_id: r.status for r in cur["review_status"].collect()} == {
        70: "accepted", 71: "duplicate", 72: "not_found"}
    assert cur["reviews"].count() == 8


def test_command_line_init_query_and_job(spark):
    from cobbler.__main__ import main
    tables_dir, shop, out = _scratch(), _scratch(), _scratch()
    for name, df in make_shop(spark).items():
        df.write.mode("overwrite").parquet(f"{tables_dir}/{name}")
    assert main(["init", "--shop", shop, "--tables", tables_dir]) == 0
    assert main(["query", "admin_catalog", "--shop", shop, "--out", out + "/admin"]) == 0
    lines = [json.loads(x) for f in os.listdir(out + "/admin") if f.endswith(".json")
             for x in open(os.path.join(out, "admin", f))]
    assert len(lines) == 6 and {r["group_id"] for r in lines if r["variants"] is None} == {5}
    assert main(["query", "cart_lines", "--shop", shop, "--out", out + "/cart", "--user", "2", "--user", "3"]) == 0
    lines = [json.loads(x) for f in os.listdir(out + "/cart") if f.endswith(".json") for x in open(os.path.join(out, "cart", f))]
    assert {r["user_id"] for r in lines} == {2, 3}
    images = os.path.join(out, "images.json")
    with open(images, "w") as f:
        f.write(json.dumps({"request_id": 1, "variant_id": 101, "image": "new.jpg"}) + "\n")
    feed = os.path.join(out, "checkout.json")
    with open(feed, "w") as f:
        f.write(json.dumps({"request_id": 1, "user_id": 1, "shipping_address": "a", "payment_method": "c"}) + "\n")
    assert main(["job", "checkout", "--shop", shop, "--feed", feed, "--batch", "1",
                 "--as-of", "2025-01-15 00:00:00"]) == 0
    cur = snapshots.read_current(spark, shop)
    assert cur["orders"].count() == 6 and cur["checkout_status"].first().status == "paid"
    assert main(["job", "images", "--shop", shop, "--feed", images, "--batch", "2"]) == 0
    variants = snapshots.read_current(spark, shop)["product_variants"]
    assert variants.filter("variant_id = 101").first().representative_image_url == "new.jpg"


def test_every_write_path_publishes_in_the_table_schemas(spark):
    from decimal import Decimal

    from cobbler.plans import jobs
    from cobbler.sources import schemas
    root = _scratch()
    snapshots.publish(spark, root, 0, replace=make_shop(spark))
    as_of = dt.datetime(2025, 5, 1)
    t0 = dt.datetime(2025, 4, 1)
    feeds = [
        lambda t: jobs.cart_changes_job(t, spark.createDataFrame(
            [(1, t0, 1, "add", 1, None, 1), (2, t0, 2, "remove", None, 13, None)], schemas.CART_CHANGES)),
        lambda t: jobs.load_products_job(t, spark.createDataFrame(
            [(10, "new", Decimal("1.00"), [("blue", None, 5, [("250", 3)])])], schemas.NESTED_PRODUCTS), as_of),
        lambda t: jobs.add_variants_job(t, spark.createDataFrame(
            [(700, 10, "olive", None, 0, [("260", 2)])], schemas.NEW_VARIANTS), as_of),
        lambda t: jobs.update_variants_job(t, spark.createDataFrame(
            [(1, 700, 5, True, [("260", 9), ("265", 1)])], schemas.VARIANT_CHANGES)),
        lambda t: jobs.set_images_job(t, spark.createDataFrame(
            [(1, 700, "o.jpg")], "request_id bigint, variant_id bigint, image string")),
        lambda t: jobs.user_intake_job(t, spark.createDataFrame(
            [(9, "dee@shop.test", "dee", None, True)], schemas.USER_REQUESTS)),
    ]
    for i, job in enumerate(feeds, start=1):
        snapshots.run_batch(spark, root, i, job)
    cur = snapshots.read_current(spark, root)
    for name, schema in schemas.TABLES.items():
        assert cur[name].schema.simpleString() == schema.simpleString().replace(" NOT NULL", ""), name
    assert {r.cart_id for r in cur["cart"].collect()} == {11, 12, 14, 15}
    v = {r.variant_id: r for r in cur["product_variants"].collect()}
    assert v[700].discount_rate == 5 and v[700].representative_image_url == "o.jpg"
    opts = sorted((r.size, r.stock_quantity) for r in cur["product_options"].collect() if r.variant_id == 700)
    assert opts == [("260", 9), ("265", 1)]
    assert cur["products"].count() == 7 and cur["users"].count() == 4


def test_published_orders_are_clustered_by_date(spark):
    import glob

    import pyarrow.parquet as pq

    from cobbler.sources.testdata import GeneratedShop
    root = _scratch()
    orders = GeneratedShop(spark, "/root/testdata/sf0.01").tables()["orders"].repartition(8)  # scattered input
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        snapshots.publish(spark, root, 0, replace={"orders": orders})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    ranges = []
    for f in sorted(glob.glob(f"{root}/orders/batch=0-*/*.parquet")):
        md = pq.ParquetFile(f).metadata
        col = [i for i in range(md.num_columns) if md.schema.column(i).name == "created_at"][0]
        st = [md.row_group(g).column(col).statistics for g in range(md.num_row_groups)]
        ranges.append((min(s.min for s in st), max(s.max for s in st)))
    ranges.sort()
    assert len(ranges) > 1
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))     # files cover disjoint date ranges


def _users_job(spark, rows):
    from cobbler.plans import jobs
    from cobbler.sources import schemas
    feed = spark.createDataFrame(rows, schemas.USER_REQUESTS)
    return lambda t: jobs.user_intake_job(t, feed)


def test_a_rerun_batch_changes_nothing(spark):
    from cobbler.plans import jobs
    from cobbler.sources import schemas
    root = _scratch()
    snapshots.publish(spark, root, 0, replace=make_shop(spark))
    add = spark.createDataFrame([(1, dt.datetime(2025, 4, 1), 1, "add", 1, None, 3)], schemas.CART_CHANGES)
    for _ in range(2):
        snapshots.run_batch(spark, root, 1, lambda t: jobs.cart_changes_job(t, add))
        assert {r.cart_id: r.quantity for r in snapshots.read_current(spark, root)["cart"].collect()}[11] == 5
    for _ in range(2):
        snapshots.run_batch(spark, root, 2, _users_job(spark, [(9, "dee@shop.test", "dee", None, True)]))
        cur = snapshots.read_current(spark, root)
        assert cur["users"].count() == 4 and cur["user_status"].count() == 1


def test_late_batches_and_second_writers_are_refused(spark):
    import pytest
    root = _scratch()
    t = make_shop(spark)
    snapshots.publish(spark, root, 0, replace=t)
    snapshots.run_batch(spark, root, 3, _users_job(spark, [(9, "dee@shop.test", "dee", None, True)]))
    with pytest.raises(snapshots.LateBatch):
        snapshots.run_batch(spark, root, 2, _users_job(spark, [(8, "eve@shop.test", "eve", None, True)]))

    def meanwhile(tables):      # another writer commits while this job runs
        snapshots.publish(spark, root, 4, append={"users": t["users"].limit(1)})
        return {}, {"users": t["users"].limit(1)}
    with pytest.raises(snapshots.ConcurrentPublish):
        snapshots.run_batch(spark, root, 5, meanwhile)
    assert snapshots.current_paths(spark, root)[0] == 4
    assert snapshots.read_current(spark, root)["users"].count() == 5


def test_an_unreadable_manifest_is_an_error(spark):
    import pytest
    root = _scratch()
    snapshots.publish(spark, root, 0, replace=make_shop(spark))
    with pytest.MonkeyPatch.context() as m:
        def broken(self, *a, **k):
            raise OSError("storage is away")
        m.setattr(type(spark.read), "json", broken)
        with pytest.raises(OSError):
            snapshots.publish(spark, root, 1, append={"users": make_shop(spark)["users"]})
    assert snapshots.current_paths(spark, root)[0] == 0


def test_two_feeds_on_one_shop_lose_nothing(spark):
    from cobbler.plans import jobs
    from cobbler.sources import schemas
    from cobbler.streaming.feeds import start_feed
    root = _scratch()
    snapshots.publish(spark, root, 0, replace=make_shop(spark))
    for name, ids in (("a", [50, 51]), ("b", [60, 61])):
        source, ckpt = _scratch(), _scratch()
        for i in ids:
            with open(os.path.join(source, f"{i}.json"), "w") as f:
                f.write(json.dumps({"request_id": i, "email": f"u{i}@shop.test", "name": "n", "has_password": True}) + "\n")
        for _ in range(2):      # the second run finds its own micro-batches published
            q = start_feed(spark, root, source, schemas.USER_REQUESTS, jobs.user_intake_job, ckpt, feed=name,
                           max_files_per_trigger=1)
            q.awaitTermination(120)
    users = [r.user_id for r in snapshots.read_current(spark, root)["users"].collect()]
    assert sorted(users) == [1, 2, 3, 50, 51, 60, 61]


def test_many_small_batches_are_compacted(spark):
    root = _scratch()
    t = make_shop(spark)
    snapshots.publish(spark, root, 0, replace={"users": t["users"]})
    for i in range(1, 5):
        snapshots.publish(spark, root, i, append={"users": t["users"].limit(1)})
    assert len(snapshots.current_paths(spark, root)[1]["users"]) == 5
    snapshots.compact(spark, root, parts=4)
    assert len(snapshots.current_paths(spark, root)[1]["users"]) == 1
    assert snapshots.read_current(spark, root)["users"].count() == 7
