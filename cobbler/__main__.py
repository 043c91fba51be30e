"""Command line: the shop's read queries and write paths over a published shop folder.

    python -m cobbler init  --shop ROOT --tables DIR           # publish DIR/<table> Parquet as batch 0
    python -m cobbler query NAME --shop ROOT --out PATH [--as-of TS] [--start D] [--end D] [--user ID ...] [--product ID ...]
    python -m cobbler job   NAME --shop ROOT --feed PATH --batch N [--as-of TS]

Queries write JSON lines with null fields kept (the reference's responses);
jobs read a JSON-lines request feed and publish their tables as batch N.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from .functions import fixed
from .operators import cart, catalog, orders, reviews, sales
from .plans import jobs, snapshots
from .session import CLUSTER_CONF, build_session
from .sources import schemas
from .sources.tables import read_bodies, read_table, write_json

QUERIES = {
    "product_page": lambda t, a: catalog.product_page(t),
    "popular_variants": lambda t, a: catalog.popular_variants(t),
    "in_stock_sizes": lambda t, a: catalog.in_stock_sizes(t),
    "gender_catalog": lambda t, a: catalog.gender_catalog(t, a.as_of, a.gender or fixed.CATALOG_GENDER),
    "admin_catalog": lambda t, a: catalog.admin_catalog(t),
    "table_counts": lambda t, a: catalog.table_counts(t),
    "color_size_counts": lambda t, a: catalog.color_size_counts(t),
    "variant_images": lambda t, a: catalog.variant_images(t),
    "daily_variant_sales": lambda t, a: sales.daily_variant_sales(t, a.start, a.end),
    "sales_summary": lambda t, a: sales.sales_summary(t, a.start, a.end),
    "order_lines": lambda t, a: orders.order_lines(t, a.user_ids),
    "order_history": lambda t, a: orders.order_history(t, a.user_ids),
    "review_list": lambda t, a: reviews.review_list(t, a.product_ids),
    "rating_summary": lambda t, a: reviews.rating_summary(t),
    "cart_lines": lambda t, a: cart.cart_lines(t, a.user_ids),
    "cart_totals": lambda t, a: cart.cart_totals(t, a.user_ids),
}

JOBS = {  # name -> (feed schema, job(tables, feed, args))
    "cart_changes": (schemas.CART_CHANGES, lambda t, f, a: jobs.cart_changes_job(t, f)),
    "checkout": (schemas.CHECKOUT_REQUESTS, lambda t, f, a: jobs.checkout_job(t, f, a.as_of)),
    "load_products": (schemas.NESTED_PRODUCTS, lambda t, f, a: jobs.load_products_job(t, f, a.as_of)),
    "add_variants": (schemas.NEW_VARIANTS, lambda t, f, a: jobs.add_variants_job(t, f, a.as_of)),
    "update_variants": (schemas.VARIANT_CHANGES, lambda t, f, a: jobs.update_variants_job(t, f)),
    "images": (schemas.IMAGE_CHANGES, lambda t, f, a: jobs.set_images_job(t, f)),
    "reviews": (schemas.REVIEW_REQUESTS, lambda t, f, a: jobs.review_intake_job(t, f, a.as_of)),
    "users": (schemas.USER_REQUESTS, lambda t, f, a: jobs.user_intake_job(t, f)),
}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cobbler")
    sub = p.add_subparsers(dest="cmd", required=True)
    i = sub.add_parser("init")
    i.add_argument("--shop", required=True)
    i.add_argument("--tables", required=True)
    q = sub.add_parser("query")
    q.add_argument("name", choices=sorted(QUERIES))
    q.add_argument("--shop", required=True)
    q.add_argument("--out", required=True)
    q.add_argument("--user", type=int, action="append", help="only these users (cart, orders); repeatable")
    q.add_argument("--product", type=int, action="append", help="only these products (reviews); repeatable")
    j = sub.add_parser("job")
    j.add_argument("name", choices=sorted(JOBS))
    j.add_argument("--shop", required=True)
    j.add_argument("--feed", required=True)
    j.add_argument("--batch", type=int, required=True)
    for s in (q, j):
        s.add_argument("--as-of", dest="as_of", default=None)
        s.add_argument("--start", default=None)
        s.add_argument("--end", default=None)
        s.add_argument("--gender", default=None)
    p.add_argument("--master", default=None, help="Spark master (default: from spark-submit)")
    p.add_argument("--cluster", action="store_true",
                   help="apply the large-cluster settings (session.CLUSTER_CONF)")
    a = p.parse_args(argv)
    if getattr(a, "as_of", None) is None:
        a.as_of = dt.datetime.now().replace(microsecond=0)   # the reference reads the wall clock

    extra = dict(CLUSTER_CONF) if a.cluster else None
    spark = build_session(master=a.master or None,
                          shuffle_partitions=int(CLUSTER_CONF["spark.sql.shuffle.partitions"]) if a.cluster else 8,
                          extra=extra)
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # Spark Connect
        pass
    if a.cmd == "init":
        tables = {name: read_table(spark, a.tables, name) for name in schemas.TABLES}
        snapshots.publish(spark, a.shop, 0, replace=jobs.first_batch(tables))
    elif a.cmd == "query":
        for key in ("user", "product"):
            ids = getattr(a, key)
            setattr(a, f"{key}_ids", spark.createDataFrame([(i,) for i in ids], f"{key}_id bigint") if ids else None)
        write_json(QUERIES[a.name](snapshots.read_current(spark, a.shop), a), a.out)
    else:
        schema, job = JOBS[a.name]
        feed = read_bodies(spark, a.feed)
        snapshots.run_batch(spark, a.shop, a.batch, lambda t: jobs.quarantined(job, schema, a.name)(t, feed, a))
    return 0


if __name__ == "__main__":
    sys.exit(main())
