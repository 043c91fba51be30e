"""S1-S3, O1-O3, R1-R2, L5."""

import datetime as dt

from pyspark.sql import functions as F

from cobbler.operators import orders, reviews, sales
from cobbler.sources import schemas
from conftest import make_shop


def test_sales_status_case_insensitive_and_inclusive_days(spark):
    t = make_shop(spark)
    daily = sales.daily_variant_sales(t, "2025-03-01", "2025-03-03").collect()
    got = sorted((r.variant_id, r.sales_date, r.daily_qty, float(r.daily_revenue)) for r in daily)
    # 1000 PAID, 1001 delivered (23:59:59 kept), 1003 Shipped (mixed case); 1002 pending dropped,
    # 1004 is on 2025-03-04 (outside)
    assert got == [(101, "2025-03-01", 1, 159000.0), (101, "2025-03-02", 1, 0.5),
                   (101, "2025-03-03", 1, 1000.0), (103, "2025-03-02", 2, 270000.0)]
    assert daily[0].name.endswith(")") and "(" in daily[0].name


def test_sales_summary_totals_equal_sum_of_days(spark):
    t = make_shop(spark)
    s = sales.sales_summary(t, "2025-03-01", "2025-03-04").collect()
    assert [r.variant_id for r in s] == [103, 101, 301]          # revenue descending
    v101 = [r for r in s if r.variant_id == 101][0]
    assert v101.total_qty == 3 and float(v101.total_revenue) == 160000.5
    assert [h.date for h in v101.daily_history] == ["2025-03-01", "2025-03-02", "2025-03-03"]
    assert sum(float(h.revenue) for h in v101.daily_history) == float(v101.total_revenue)
    rounded = sales.sales_summary(t, "2025-03-01", "2025-03-04", round_revenue=True).collect()
    assert [r.total_revenue for r in rounded if r.variant_id == 101] == [160001]


def test_sales_default_range_is_2025(spark):
    assert sales.sales_summary(make_shop(spark)).count() == 3


def test_review_flag_has_no_fan_out(spark):
    t = make_shop(spark)
    lines = orders.order_lines(t).collect()
    assert len(lines) == 6                                        # item 5001 has two reviews: still one line
    flag = {r.order_item_id: r.is_review_written for r in lines}
    assert flag[5001] is True and flag[5000] is False


def test_order_history_items_sorted_and_orders(spark):
    t = make_shop(spark)
    users = spark.createDataFrame([(1,)], "user_id bigint")
    h = orders.order_history(t, users).collect()
    assert [r.order_id for r in h] == [1001, 1000]                # newest first
    assert [i.order_item_id for i in h[0].items] == [5001, 5005]
    obs = orders.order_history(t, users, order="observed").collect()
    assert [r.order_id for r in obs] == [1000, 1001]              # the reference's observed order (T8)


def test_review_list_and_rating_summary(spark):
    t = make_shop(spark)
    p = spark.createDataFrame([(2,)], "product_id bigint")
    assert [r.review_id for r in reviews.review_list(t, p).collect()] == [4, 3]
    rs = {r.product_id: (r.review_count, r.avg_rating) for r in reviews.rating_summary(t).collect()}
    assert rs[1] == (2, 4.5)
    assert rs[2] == (2, 2.5)          # a null rating counts 0 in the sum, 1 in the count (N6)
    assert rs[3] == (3, 4.3)          # 13 / 3 = 4.33
    assert rs[4] == (0, 0.0)


def test_intake_reviews_every_branch(spark):
    from cobbler.sources import schemas as S
    users = [(1, "a@x", "a", "USER"), (2, "b@x", "b", "USER"), (3, "c@x", "c", "USER"),
             (8, "h@x", "h", "USER"), (9, "i@x", "i", "USER")]
    t = make_shop(spark, users=users)
    assert t["users"].schema == S.USERS
    ts = dt.datetime
    rows = [
        (1, ts(2025, 1, 1), 9, None, None, 5, "", None),       # invalid: no product
        (2, ts(2025, 1, 2), 9, 1, None, 0, None, None),        # invalid: rating 0 is falsy
        (3, ts(2025, 1, 3), 9, 1, None, 6, None, None),        # bad_rating
        (4, ts(2025, 1, 4), 9, 77, None, 3, None, None),       # not_found
        (5, ts(2025, 1, 5), 1, 1, None, 4, None, None),        # duplicate: stored (1, 1)
        (6, ts(2025, 1, 6), 9, 4, None, 4, "", "fine"),        # accepted general
        (7, ts(2025, 1, 7), 9, 4, None, 5, None, None),        # duplicate: earlier in batch
        (8, ts(2025, 1, 8), 9, 1, 5001, 5, None, None),        # duplicate: item 5001 has a review
        (9, ts(2025, 1, 9), 9, 2, 5002, 5, None, None),        # accepted item review
        (10, ts(2025, 1, 10), 9, 2, 5002, 5, None, None),      # duplicate item in batch
        (11, ts(2025, 1, 11), 9, 2, None, 5, None, None),      # duplicate: earlier item review of (9, 2)
        (12, ts(2025, 1, 12), 8, 6, None, 5, None, None),      # accepted general ...
        (13, ts(2025, 1, 13), 8, 6, 5003, 5, None, None),      # ... then an item review still passes
        (14, ts(2025, 1, 14), None, 3, None, 5, None, None),   # null user never matches: accepted
        (15, ts(2025, 1, 15), None, 3, None, 5, None, None),   # accepted again
        (16, ts(2025, 1, 16), 9, 2, 7777, 5, None, None),      # unknown_reference: no such order item
        (17, ts(2025, 1, 17), 77, 4, None, 5, None, None),     # unknown_reference: no such user
        (18, ts(2025, 1, 18), 77, 1, 5001, 5, None, None),     # duplicate wins over the failed insert
        (19, ts(2025, 1, 19), 77, 2, 5004, 5, None, None),     # unknown user: insert fails ...
        (20, ts(2025, 1, 20), 2, 2, 5004, 5, None, None),      # ... so it blocks nobody: accepted
        (-97, ts(2025, 1, 21), 3, 4, None, 5, None, None),     # key_conflict: the id is stored review 3's ...
        (21, ts(2025, 1, 22), 3, 4, None, 5, None, None),      # ... so it stores nothing and blocks nobody
        (-96, ts(2025, 1, 23), 9, 6, 5005, 5, None, None),     # key_conflict for an item review too
        (-95, ts(2025, 1, 24), 9, 1, 5001, 5, None, None),     # duplicate comes first
    ]
    rows = [(100 + r[0], *r[1:]) for r in rows]                # stored reviews have the ids 1 to 7
    req = spark.createDataFrame(rows, "request_id bigint, ts timestamp, user_id bigint, product_id bigint, "
                                      "order_item_id bigint, rating int, title string, content string")
    out = reviews.intake_reviews(t, req, dt.datetime(2025, 2, 1))
    st = {r.request_id - 100: r.status for r in out["status"].collect()}
    assert st == {-97: "key_conflict", -96: "key_conflict", -95: "duplicate", 21: "accepted",
                  1: "invalid", 2: "invalid", 3: "bad_rating", 4: "not_found", 5: "duplicate", 6: "accepted",
                  7: "duplicate", 8: "duplicate", 9: "accepted", 10: "duplicate", 11: "duplicate",
                  12: "accepted", 13: "accepted", 14: "accepted", 15: "accepted", 16: "unknown_reference",
                  17: "unknown_reference", 18: "duplicate", 19: "unknown_reference", 20: "accepted"}
    new = {r.review_id - 100: r for r in out["reviews"].collect()}
    assert new[6].title is None and new[6].content == "fine" and new[6].created_at == dt.date(2025, 2, 1)
    assert new[9].order_item_id == 5002 and new[12].order_item_id is None


def test_intake_reviews_against_plain_loop(spark):
    """Brute force: the reference's handler as a loop over a shuffled feed."""
    import random
    rnd = random.Random(7)
    t = make_shop(spark, reviews=[])
    rows = []
    for i in range(400):
        rows.append((i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=rnd.randint(0, 50)),
                     rnd.choice([None, 1, 2, 3, 77]), rnd.choice([0, 1, 2, 3, 9]),
                     rnd.choice([None, None, 0, 5000, 5001, 7777]), rnd.choice([0, 1, 5, 6]), None, None))
    req = spark.createDataFrame(rows, "request_id bigint, ts timestamp, user_id bigint, product_id bigint, "
                                      "order_item_id bigint, rating int, title string, content string")
    got = {r.request_id: r.status for r in reviews.intake_reviews(t, req, dt.datetime(2025, 2, 1))["status"]
           .collect()}
    known = {1, 2, 3, 4, 5, 6}
    users = {1, 2, 3}
    items = {5000, 5001, 5002, 5003, 5004, 5005}
    stored = []
    want = {}
    for r in sorted(rows, key=lambda x: (x[1], x[0])):
        rid, _, user, prod, item, rating = r[:6]
        if not prod or not rating:
            want[rid] = "invalid"
        elif rating < 1 or rating > 5:
            want[rid] = "bad_rating"
        elif prod not in known:
            want[rid] = "not_found"
        elif item:
            if any(s[2] == item for s in stored):
                want[rid] = "duplicate"
            elif (user is not None and user not in users) or item not in items:
                want[rid] = "unknown_reference"           # the insert fails on a foreign key
            else:
                stored.append((user, prod, item))
                want[rid] = "accepted"
        else:
            if user is not None and any(s[0] == user and s[1] == prod for s in stored):
                want[rid] = "duplicate"
            elif user is not None and user not in users:
                want[rid] = "unknown_reference"
            else:
                stored.append((user, prod, None))
                want[rid] = "accepted"
    assert got == want


def test_review_schema_matches_table(spark):
    t = make_shop(spark)
    req = spark.createDataFrame([(101, 1, 4, None, 5, "t", "c")], schemas.REVIEW_REQUESTS)
    new = reviews.intake_reviews(t, req, dt.datetime(2025, 2, 1))["reviews"]
    assert new.columns == [f.name for f in schemas.REVIEWS.fields]
    assert new.select(F.col("review_id")).first()[0] == 101
