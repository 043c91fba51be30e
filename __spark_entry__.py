"""

Every query builds the shop's tables from the driver's generated tables
(``cobbler.sources.testdata``, rules in FIXTURES.md §3) and runs one library
operator over all of them. ``oracle_sql`` asks DuckDB the same question.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from cobbler.operators import cart, catalog, checkout, loads, orders, reviews, sales  # noqa: E402
from cobbler.plans import jobs, snapshots  # noqa: E402
from cobbler.plans.render import joined  # noqa: E402
from cobbler.session import apply_sql_conf, ensure_checkpoint_dir  # noqa: E402
from cobbler.sources import schemas  # noqa: E402
from cobbler.sources.tables import parse_bodies  # noqa: E402
from cobbler.sources.testdata import GeneratedShop  # noqa: E402
from duck_oracle import queries as oq  # noqa: E402

try:    # the training-data operators are an optional subpackage
    from cobbler.llm import queries as lq  # noqa: E402
except ImportError:
    lq = None
try:
    import corpus_pipeline  # noqa: E402
except ImportError:
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _shop(spark: SparkSession, sf_dir: str, *stored: str) -> GeneratedShop:
    apply_sql_conf(spark)          # UTC, AQE, skew join, broadcast only from measured sizes
    return GeneratedShop(spark, sf_dir, stored=stored)      # tables that the query reads several times


def _to_double(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# ---------------- sales ----------------

def q_daily_variant_sales(spark, sf_dir):
    t = _shop(spark, sf_dir).tables()
    return _to_double(sales.daily_variant_sales(t, oq.SALES_START, oq.SALES_END), "daily_revenue")


def q_sales_summary(spark, sf_dir):
    t = _shop(spark, sf_dir).tables()
    return _summary_text(sales.sales_summary(t, oq.SALES_START, oq.SALES_END))


def _summary_text(s: DataFrame) -> DataFrame:
    return _to_double(s, "total_revenue").withColumn("daily_history", joined("daily_history", ["date", "qty", "revenue"]))


def q_sales_summary_published(spark, sf_dir):
    """S2 over a published shop: items lie in folders by month, those outside the range are not read."""
    t = _shop(spark, sf_dir).tables()
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cobbler-shops/{uuid.uuid4().hex}"
    tables = jobs.first_batch({n: t[n] for n in ("orders", "order_items", "product_options", "product_variants", "products")})
    tables.pop("sales_rollup")
    snapshots.publish(spark, root, 0, replace=tables)
    return _summary_text(sales.sales_summary(snapshots.read_current(spark, root), oq.SALES_START, oq.SALES_END))


def q_sales_summary_after_checkout(spark, sf_dir):
    """S2 from the stored rollup, to which the checkout of all requests has added its part."""
    shop = _shop(spark, sf_dir)
    t = shop.tables()
    out = checkout.checkout(t, shop.checkout_requests, oq.CHECKOUT_AS_OF)
    parts = sales.rollup(t["orders"], t["order_items"]).unionByName(sales.rollup(out["orders"], out["order_items"]))
    kept = {n: t[n] for n in ("product_options", "product_variants", "products")} | {"sales_rollup": sales.merge_rollup(parts)}
    return _summary_text(sales.sales_summary(kept, oq.SALES_START, oq.SALES_END))


# ---------------- catalog ----------------

def q_product_page(spark, sf_dir):
    return _to_double(catalog.product_page(_shop(spark, sf_dir).tables()), "base_price")


def q_in_stock_sizes(spark, sf_dir):
    s = catalog.in_stock_sizes(_shop(spark, sf_dir).tables())
    return s.withColumn("sizes", joined("sizes", sep=","))


def q_popular_variants(spark, sf_dir):
    s = catalog.popular_variants(_shop(spark, sf_dir).tables())
    return _to_double(s, "original_price").withColumn("sizes", joined("sizes", sep=","))


def q_gender_catalog(spark, sf_dir):
    s = catalog.gender_catalog(_shop(spark, sf_dir).tables(), oq.CATALOG_AS_OF, "MEN")
    return _to_double(s, "original_price").withColumns({
        "images": joined("images", sep=","), "sizes": joined("sizes", sep=","),
        "categories": joined("categories", sep=",")})


def q_admin_catalog(spark, sf_dir):
    s = catalog.admin_catalog(_shop(spark, sf_dir).tables())

    def variant_text(v):
        opts = F.array_join(F.transform(v["options"], lambda o: F.concat_ws(
            ":", o["size"].cast("string"), F.coalesce(o["stock"].cast("string"), F.lit("")))), ",")
        return F.concat_ws("|", *[F.coalesce(x, F.lit("")) for x in (
            v["variant_id"].cast("string"), v["color_name"], v["image"],
            v["discount_rate"].cast("string"), v["registration_date"].cast("string"), opts)])
    return _to_double(s, "base_price").withColumn(
        "variants", F.array_join(F.transform("variants", variant_text), ";"))


def q_table_counts(spark, sf_dir):
    return catalog.table_counts(_shop(spark, sf_dir).tables())


def q_color_size_counts(spark, sf_dir):
    return _to_double(catalog.color_size_counts(_shop(spark, sf_dir).tables()), "base_price")


def q_variant_images(spark, sf_dir):
    return catalog.variant_images(_shop(spark, sf_dir).tables())


# ---------------- orders and reviews ----------------

def q_reviewed_items(spark, sf_dir):
    return orders.review_written_flag(_shop(spark, sf_dir).tables())


def q_order_lines(spark, sf_dir):
    return _to_double(orders.order_lines(_shop(spark, sf_dir).tables()),
                      "total_amount", "price", "base_price")


def q_order_history(spark, sf_dir):
    h = orders.order_history(_shop(spark, sf_dir).tables())
    return _to_double(h, "total_amount").withColumn("items", joined("items", orders.ITEM_FIELDS))


def q_review_list(spark, sf_dir):
    return reviews.review_list(_shop(spark, sf_dir).tables())


def q_rating_summary(spark, sf_dir):
    return reviews.rating_summary(_shop(spark, sf_dir).tables())


def _review_intake(spark, sf_dir):
    shop = _shop(spark, sf_dir, "order_items", "review_requests")
    t = shop.tables()
    return t, reviews.intake_reviews(t, shop.review_requests, oq.INTAKE_AS_OF)


def q_review_intake(spark, sf_dir):
    return _review_intake(spark, sf_dir)[1]["status"]


def q_reviews_after_intake(spark, sf_dir):
    t, out = _review_intake(spark, sf_dir)
    return t["reviews"].unionByName(out["reviews"])


# ---------------- cart and checkout ----------------

def q_cart_lines(spark, sf_dir):
    return _to_double(cart.cart_lines(_shop(spark, sf_dir).tables()), "base_price")


def q_cart_lines_after_batches(spark, sf_dir):
    """K1 of a published shop after its catalog batches: new variants, stock and discount changes, images. The batches
    rewrite the files they touch and keep the table of option details that the cart joins."""
    shop = _shop(spark, sf_dir)
    t = shop.tables()
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cobbler-shops/{uuid.uuid4().hex}"
    first = {n: t[n] for n in ("product_options", "product_variants", "products", "cart")}
    snapshots.publish(spark, root, 0, replace=first | {"option_details": catalog.option_details(first)})
    snapshots.run_batch(spark, root, 1, lambda now: jobs.add_variants_job(now, shop.new_variants, oq.LOAD_AS_OF))
    snapshots.run_batch(spark, root, 2, lambda now: jobs.update_variants_job(now, shop.variant_changes))
    snapshots.run_batch(spark, root, 3, lambda now: jobs.set_images_job(now, shop.image_changes))
    return _to_double(cart.cart_lines(snapshots.read_current(spark, root)), "base_price")


def q_cart_totals(spark, sf_dir):
    return cart.cart_totals(_shop(spark, sf_dir).tables())


def _cart_changes(spark, sf_dir):
    shop = _shop(spark, sf_dir)
    return cart.apply_cart_changes(shop.tables(), shop.cart_changes)


def q_cart_change_status(spark, sf_dir):
    return _cart_changes(spark, sf_dir)["status"]


def q_cart_after_changes(spark, sf_dir):
    return _cart_changes(spark, sf_dir)["cart"]


def q_cart_change_bodies(spark, sf_dir):
    """The cart feed from JSON bodies: what is a request, by kind, and what is set apart, by reason."""
    good, bad = parse_bodies(_shop(spark, sf_dir).cart_change_bodies, schemas.CART_CHANGES)
    some = lambda df, kind: df.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n"), F.sum(F.coalesce("request_id", F.lit(0))).cast("bigint").alias("ids"))
    return some(good, F.col("op")).unionByName(some(bad, F.col("reason")))


def _checkout(spark, sf_dir):
    shop = _shop(spark, sf_dir)
    return checkout.checkout(shop.tables(), shop.checkout_requests, oq.CHECKOUT_AS_OF)


def q_checkout_lines(spark, sf_dir):
    return _checkout(spark, sf_dir)["lines"]


def q_checkout_status(spark, sf_dir):
    return _checkout(spark, sf_dir)["status"]


def q_checkout_orders(spark, sf_dir):
    o = _checkout(spark, sf_dir)["orders"].drop("created_at")
    return _to_double(o, "total_amount")


def q_checkout_items(spark, sf_dir):
    return _to_double(_checkout(spark, sf_dir)["order_items"].select("order_id", "option_id", "quantity", "price"), "price")


def q_stock_after(spark, sf_dir):
    return _checkout(spark, sf_dir)["product_options"]


def q_sold_after(spark, sf_dir):
    return _checkout(spark, sf_dir)["product_variants"].select("variant_id", "sold_count")


def q_cart_after_checkout(spark, sf_dir):
    return _checkout(spark, sf_dir)["cart"].select("cart_id", "user_id", "option_id", "quantity")


# ---------------- loads ----------------

def q_options_after_update(spark, sf_dir):
    shop = _shop(spark, sf_dir)
    o = loads.update_variants(shop.tables(), shop.option_changes, shop.discount_changes)["product_options"]
    return o.withColumn("option_id", F.when(~F.col("is_new"), F.col("option_id")))


def q_variants_after_update(spark, sf_dir):
    shop = _shop(spark, sf_dir)
    v = loads.update_variants(shop.tables(), shop.option_changes, shop.discount_changes)["product_variants"]
    return v.select("variant_id", "discount_rate")


def _load_products(spark, sf_dir):
    shop = _shop(spark, sf_dir)
    return loads.load_products(shop.nested_products, oq.LOAD_AS_OF)


def q_load_status(spark, sf_dir):
    return _load_products(spark, sf_dir)["status"]


def q_loaded_variants(spark, sf_dir):
    v = _load_products(spark, sf_dir)["product_variants"]
    return v.select("product_id", "color_name", "representative_image_url", "discount_rate", "registration_date")


def q_loaded_options(spark, sf_dir):
    out = _load_products(spark, sf_dir)
    return (out["product_options"].join(out["product_variants"].select("variant_id", "product_id"), "variant_id")
            .select("product_id", "size", "stock_quantity"))


def _add_variants(spark, sf_dir):
    shop = _shop(spark, sf_dir)
    return loads.add_variants(shop.tables(), shop.new_variants, oq.LOAD_AS_OF)


def q_variant_add_status(spark, sf_dir):
    return _add_variants(spark, sf_dir)["status"]


def q_variants_added(spark, sf_dir):
    v = _add_variants(spark, sf_dir)["product_variants"]
    return v.select("variant_id", "product_id", "color_name", "representative_image_url", "discount_rate",
                    "registration_date")


def q_options_added(spark, sf_dir):
    return _add_variants(spark, sf_dir)["product_options"].select("variant_id", "size", "stock_quantity")


def q_variants_after_images(spark, sf_dir):
    shop = _shop(spark, sf_dir)
    v = loads.set_variant_images(shop.tables(), shop.image_changes)
    return v.select("variant_id", "representative_image_url")


def _user_intake(spark, sf_dir):
    shop = _shop(spark, sf_dir)
    return loads.intake_users(shop.tables(), shop.user_requests)


def q_user_intake(spark, sf_dir):
    return _user_intake(spark, sf_dir)["status"]


def q_users_after_intake(spark, sf_dir):
    shop = _shop(spark, sf_dir)
    t = shop.tables()
    return t["users"].unionByName(loads.intake_users(t, shop.user_requests)["users"])


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the admin sales summary (joins, day range, two-level aggregation) on sf0.001."""
    return q_sales_summary(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    optional = dict(lq.QUERIES) if lq else {}
    if corpus_pipeline:
        optional["pipeline"] = corpus_pipeline.run
    return optional | {
        "daily_variant_sales": q_daily_variant_sales,
        "sales_summary": q_sales_summary,
        "sales_summary_published": q_sales_summary_published,
        "sales_summary_after_checkout": q_sales_summary_after_checkout,
        "product_page": q_product_page,
        "in_stock_sizes": q_in_stock_sizes,
        "popular_variants": q_popular_variants,
        "gender_catalog": q_gender_catalog,
        "admin_catalog": q_admin_catalog,
        "table_counts": q_table_counts,
        "color_size_counts": q_color_size_counts,
        "variant_images": q_variant_images,
        "reviewed_items": q_reviewed_items,
        "order_lines": q_order_lines,
        "order_history": q_order_history,
        "review_list": q_review_list,
        "rating_summary": q_rating_summary,
        "review_intake": q_review_intake,
        "reviews_after_intake": q_reviews_after_intake,
        "cart_lines": q_cart_lines,
        "cart_lines_after_batches": q_cart_lines_after_batches,
        "cart_totals": q_cart_totals,
        "cart_change_status": q_cart_change_status,
        "cart_after_changes": q_cart_after_changes,
        "cart_change_bodies": q_cart_change_bodies,
        "checkout_lines": q_checkout_lines,
        "checkout_status": q_checkout_status,
        "checkout_orders": q_checkout_orders,
        "checkout_items": q_checkout_items,
        "stock_after": q_stock_after,
        "sold_after": q_sold_after,
        "cart_after_checkout": q_cart_after_checkout,
        "options_after_update": q_options_after_update,
        "variants_after_update": q_variants_after_update,
        "load_status": q_load_status,
        "loaded_variants": q_loaded_variants,
        "loaded_options": q_loaded_options,
        "variant_add_status": q_variant_add_status,
        "variants_added": q_variants_added,
        "options_added": q_options_added,
        "variants_after_images": q_variants_after_images,
        "user_intake": q_user_intake,
        "users_after_intake": q_users_after_intake,
    }


def oracle_sql() -> dict[str, str]:
    sql = oq.SQL | (lq.SQL if lq else {})
    if corpus_pipeline and corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {k: v for k, v in sql.items() if k in queries()}
