"""Sales by variant and day (S1), rolled up per variant (S2), over an inclusive day range (S3).

Plan: filter orders by day range and sold status (pushed to the scan), join
the items, pre-aggregate per (option, day) before touching the catalog, then
map options to variants and aggregate per (variant, day). Names and images are
joined last, to the already-small result, because they depend on variant_id
only. Published items carry the month of their order (``order_month``, a partition
column), and the day range becomes a filter on it, so that a scan reads the
range's months only. A shop that keeps the rollup (``sales_rollup``: sums per option and day,
to which each batch of orders adds a part) answers from it without reading items at all. Hot variants are harmless: every step is a partial/final aggregation, and
the per-variant history array is bounded by the number of days in the range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_datetime, column_type, day_range
from ..functions.fixed import SALES_DEFAULT_END as DEFAULT_END
from ..functions.fixed import SALES_DEFAULT_START as DEFAULT_START
from ..functions.fixed import SOLD_STATUSES


def order_month(created_at: Column | str) -> Column:
    """The month of an order as a number, 202504; items are stored by it."""
    day = F.to_date(created_at)
    return (F.year(day) * 100 + F.month(day)).cast("int")


def with_order_month(items: DataFrame, orders: DataFrame) -> DataFrame:
    """``items`` with the month of their order (null for items of no order)."""
    months = orders.select("order_id", order_month("created_at").alias("order_month"))
    return items.drop("order_month").join(months, "order_id", "left")


def _sold(orders: DataFrame, start=None, end=None) -> DataFrame:
    """``order_id, sales_day`` of sold orders, within the day range if one is given."""
    if start is not None:
        orders = orders.filter(day_range("created_at", start, end, column_type(orders, "created_at")))
    return (orders.filter(F.upper("status").isin(*SOLD_STATUSES))
            .select("order_id", F.to_date("created_at").alias("sales_day")))


def _per_option(items: DataFrame, sold: DataFrame) -> DataFrame:
    # group on the 4-byte date; the day's text is made once per result row, after aggregation
    lines = items.select("order_id", "option_id", "quantity", "price").join(sold, "order_id")
    return lines.groupBy("option_id", "sales_day").agg(
        F.sum("quantity").cast("bigint").alias("qty"), F.sum(F.col("quantity") * F.col("price")).cast("decimal(38,2)").alias("revenue"))


def rollup(orders: DataFrame, items: DataFrame) -> DataFrame:
    """``option_id, sales_day, qty, revenue`` of sold orders: what a batch of new orders adds to ``sales_rollup``."""
    return _per_option(items, _sold(orders))


def merge_rollup(parts: DataFrame) -> DataFrame:
    """One row per option and day. Parts only ever add up, so they can be merged at any time, or when read."""
    return parts.groupBy("option_id", "sales_day").agg(
        F.sum("qty").cast("bigint").alias("qty"), F.sum("revenue").cast("decimal(38,2)").alias("revenue"))


def _daily(t: dict[str, DataFrame], start, end) -> DataFrame:
    if "sales_rollup" in t:
        per_option = t["sales_rollup"].filter(F.col("sales_day").between(*(F.lit(as_datetime(d).date()) for d in (start, end))))
    else:
        items = t["order_items"]
        if "order_month" in items.columns:
            lo, hi = (as_datetime(d) for d in (start, end))
            items = items.filter(F.col("order_month").between(lo.year * 100 + lo.month, hi.year * 100 + hi.month))
        per_option = _per_option(items, _sold(t["orders"], start, end))
    per_variant = (per_option.join(t["product_options"].select("option_id", "variant_id"), "option_id")
                   .groupBy("variant_id", "sales_day")
                   .agg(F.sum("qty").cast("bigint").alias("daily_qty"),
                        F.sum("revenue").alias("daily_revenue")))
    return per_variant.select("variant_id", F.date_format("sales_day", "yyyy-MM-dd").alias("sales_date"),
                              "daily_qty", "daily_revenue")


def _variant_names(t: dict[str, DataFrame]) -> DataFrame:
    v = t["product_variants"].select("variant_id", "product_id", "color_name",
                                     F.col("representative_image_url").alias("image"))
    p = t["products"].select("product_id", F.col("name").alias("product_name"))
    return v.join(p, "product_id").select(
        "variant_id", F.concat("product_name", F.lit(" ("), "color_name", F.lit(")")).alias("name"),
        "image")


def daily_variant_sales(t: dict[str, DataFrame], start=DEFAULT_START, end=DEFAULT_END) -> DataFrame:
    """Per variant and day (``yyyy-MM-dd``): quantity and revenue of sold orders in the range."""
    d = _daily(t, start or DEFAULT_START, end or DEFAULT_END)
    return d.join(_variant_names(t), "variant_id").select(
        "variant_id", "name", "image", "sales_date", "daily_qty", "daily_revenue")


def sales_summary(t: dict[str, DataFrame], start=DEFAULT_START, end=DEFAULT_END,
                  round_revenue: bool = False, sort: bool = True) -> DataFrame:
    """Per variant, total quantity and revenue plus the day-by-day history, by revenue descending.

    ``daily_history`` is an array of {date, qty, revenue} in date order. ``total_revenue``
    stays decimal; ``round_revenue=True`` gives the reference's rounded integer.
    """
    d = _daily(t, start or DEFAULT_START, end or DEFAULT_END)
    totals = d.groupBy("variant_id").agg(
        F.sum("daily_qty").cast("bigint").alias("total_qty"),
        F.sum("daily_revenue").alias("total_revenue"),
        F.array_sort(F.collect_list(F.struct(
            F.col("sales_date").alias("date"), F.col("daily_qty").alias("qty"),
            F.col("daily_revenue").alias("revenue")))).alias("daily_history"))
    if round_revenue:
        totals = totals.withColumn("total_revenue", F.round("total_revenue", 0).cast("bigint"))
    out = totals.join(_variant_names(t), "variant_id").select(
        "variant_id", "name", "image", "total_qty", "total_revenue", "daily_history")
    if sort:
        out = out.orderBy(F.desc("total_revenue"), "variant_id")
    return out
