"""Plan properties checked with explain(): filters reach the scan, columns are pruned, the top-n
comes before the size arrays, and the item stream is never broadcast on a static estimate."""

import os

import pytest

from cobbler.operators import catalog, orders, sales
from cobbler.session import apply_sql_conf
from cobbler.sources.testdata import GeneratedShop

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="generated test data not present")


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_sales_range_and_status_reach_the_orders_scan(spark):
    apply_sql_conf(spark)
    t = GeneratedShop(spark, SF).tables()
    p = plan(sales.sales_summary(t, "1996-01-01", "2000-12-31"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in p
    assert "LessThan(o_orderdate,2001-01-01T00:00)" in p
    li_schemas = [line for line in p.splitlines() if line.startswith("ReadSchema: struct<l_orderkey")]
    assert li_schemas and all("l_tax" not in s and "l_comment" not in s for s in li_schemas)


def test_popular_list_takes_top_n_before_sizes(spark):
    apply_sql_conf(spark)
    t = GeneratedShop(spark, SF).tables()
    p = plan(catalog.popular_variants(t))
    assert "TakeOrderedAndProject" in p and "BroadcastExchange" in p


def test_item_stream_not_broadcast_statically(spark):
    apply_sql_conf(spark)
    t = GeneratedShop(spark, SF).tables()
    p = plan(orders.order_history(t), "simple")
    # the initial (pre-AQE) plan must not broadcast the 600k-row item window
    initial = p.split("== Initial Plan ==")[-1] if "Initial Plan" in p else p
    for chunk in initial.split("BroadcastExchange")[1:]:
        assert "Window [row_number()" not in chunk.split("+- Exchange")[0]


def test_cart_fold_runs_without_python(spark):
    import datetime as dt

    from cobbler.operators import cart
    from cobbler.sources import schemas
    from conftest import make_shop
    feed = spark.createDataFrame([(1, dt.datetime(2025, 4, 1), 1, "add", 1, None, 1)], schemas.CART_CHANGES)
    out = cart.apply_cart_changes(make_shop(spark), feed, materialize_fold="none")
    for df in out.values():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "MapInArrow"))
