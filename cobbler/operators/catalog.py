"""Catalog queries: product page, popular list, in-stock sizes, gender catalog, admin catalog,
table counts, colour/size counts and the variant image list (C1-C8).

Variant and option tables are as large as the catalog, so they are joined by
key with shuffles that AQE may turn into broadcasts from measured sizes; only
results with a proven bound (a top-n) are broadcast by hint. Per-key arrays
(sizes of a variant, variants of a product) are built with partial
aggregation; their length is the size of one variant's or product's listing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import as_datetime, one_month_back, size_number, ts_literal
from ..functions.pricing import price_floored, price_rounded, sale_active
from ..plans.lookups import few


def option_details(t: dict[str, DataFrame]) -> DataFrame:
    """Every option with its variant's and product's attributes, keyed by option_id.

    The catalog side of every line-item join (order items, cart rows, checkout
    lines): the catalog tables are joined among themselves once, so the large
    line stream crosses the catalog with a single join on option_id instead of
    one shuffle per dimension. Catalyst prunes the columns a caller does not use.
    A shop that keeps this table (``option_details``, maintained by its batches) is read from there.
    """
    if "option_details" in t:
        return t["option_details"]
    return _of_variants(t["product_options"].select("option_id", "variant_id", "size", "stock_quantity"), t)


def with_option_details(lines: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    """``lines`` with the columns of :func:`option_details`, for line streams that are small next to the catalog (carts,
    checkouts): unless the shop keeps the table, lines meet options, variants and products one after another, so that each
    catalog table is shuffled once and no join of catalog tables is. The stored table is reduced to the options that
    the lines name first: where these are few, it is not shuffled."""
    if "option_details" in t:
        named = few(lines.select("option_id").where(F.col("option_id").isNotNull()).distinct())
        return lines.join(t["option_details"].join(named, "option_id", "left_semi"), "option_id")
    o = t["product_options"].select("option_id", "variant_id", "size", "stock_quantity")
    return _of_variants(lines.join(o, "option_id"), t)


def _of_variants(options: DataFrame, t: dict[str, DataFrame]) -> DataFrame:
    v = t["product_variants"].select("variant_id", "product_id", "color_name",
                                     F.col("representative_image_url").alias("image"), "discount_rate",
                                     "sale_start_date", "sale_end_date")
    p = t["products"].select("product_id", F.col("name").alias("product_name"), "base_price")
    return options.join(v, "variant_id").join(p, "product_id")


def product_page(t: dict[str, DataFrame], n: int = fixed.PRODUCT_PAGE_SIZE) -> DataFrame:
    """The first ``n`` products (id, name, base price), by product_id (T13 tie-break)."""
    return t["products"].select("product_id", "name", "base_price").orderBy("product_id").limit(n)


def in_stock_sizes(t: dict[str, DataFrame], variants: DataFrame | None = None) -> DataFrame:
    """Per variant, the sizes with stock > 0 in string order. ``variants`` narrows by semi join."""
    o = t["product_options"].filter(F.col("stock_quantity") > 0).select("variant_id", "size")
    if variants is not None:
        o = o.join(variants.select("variant_id"), "variant_id", "left_semi")
    return o.groupBy("variant_id").agg(F.array_sort(F.collect_list("size")).alias("sizes"))


def popular_variants(t: dict[str, DataFrame], n: int = fixed.POPULAR_LIST_SIZE) -> DataFrame:
    """The ``n`` most recently registered variants with price rule P1, image and in-stock sizes.

    The top-n is taken first (``TakeOrderedAndProject``), so sizes are aggregated
    for those n variants only; the n-row result is safe to broadcast.
    """
    v = t["product_variants"].select("variant_id", "product_id", "color_name", "discount_rate",
                                     "representative_image_url", "registration_date")
    p = t["products"].select("product_id", "name", "base_price")
    top = (v.join(p, "product_id")
           .orderBy(F.desc_nulls_last("registration_date"), "variant_id").limit(n))
    top = F.broadcast(top)        # n rows
    sizes = in_stock_sizes(t, top)
    w = Window.orderBy(F.desc_nulls_last("registration_date"), "variant_id")
    return (top.join(sizes, "variant_id", "left")
            .select(F.col("variant_id").alias("id"), "name", F.col("color_name").alias("detail"),
                    F.col("base_price").alias("original_price"),
                    price_rounded("base_price", "discount_rate").alias("price"),
                    F.col("representative_image_url").alias("image"),
                    F.coalesce("sizes", F.array().cast("array<string>")).alias("sizes"),
                    F.row_number().over(w).cast("bigint").alias("rank"))
            .orderBy("rank"))


def gender_catalog(t: dict[str, DataFrame], as_of, gender: str = fixed.CATALOG_GENDER) -> DataFrame:
    """C4: one row per product of ``gender`` that has variants, shown through its first variant.

    Fields follow the reference's list card: main variant (lowest variant_id), its
    in-stock sizes, every variant's image in variant order (nulls kept), price
    rule P2, category tags (new / sale / lifestyle / slipon) as of ``as_of``.
    """
    as_of = as_datetime(as_of)
    v = t["product_variants"]
    prods = (t["products"].filter(F.upper("gender") == gender.upper())
             .join(t["materials"].select("material_id", F.col("title").alias("material")),
                   "material_id", "left")
             .select("product_id", "name", F.col("base_price").alias("original_price"), "gender",
                     "badge", "material"))
    pv = v.join(prods.select("product_id"), "product_id", "left_semi")
    fields = ["variant_id", F.col("color_name").alias("detail"),
              F.col("representative_image_url").alias("image"),
              F.col("discount_rate").alias("discount"), "registration_date", "sale_start_date",
              "sale_end_date", "sold_count"]
    per_product = pv.groupBy("product_id").agg(
        F.min_by(F.struct(*fields), "variant_id").alias("m"),
        F.array_sort(F.collect_list(F.struct("variant_id", F.col("representative_image_url").alias("image"))))
         .alias("imgs"))
    main_ids = per_product.select(F.col("m.variant_id").alias("variant_id"))
    sizes = (t["product_options"].filter(F.col("stock_quantity") > 0)
             .join(main_ids, "variant_id", "left_semi")
             .groupBy("variant_id").agg(F.array_sort(F.collect_list("size")).alias("sizes")))
    d = F.coalesce(F.col("m.discount"), F.lit(0))
    month_ago = ts_literal(one_month_back(as_of))
    tags = F.array_compact(F.array(
        F.when(F.col("m.registration_date").cast("timestamp") >= month_ago, F.lit(fixed.TAG_NEW)),
        F.when((d > 0) & sale_active("m.sale_start_date", "m.sale_end_date", as_of), F.lit(fixed.TAG_SALE)),
        F.when(F.col("badge").contains(fixed.BADGE_LIFESTYLE), F.lit(fixed.TAG_LIFESTYLE)),
        F.when(F.col("badge").contains(fixed.BADGE_SLIP), F.lit(fixed.TAG_SLIPON))))
    out = (prods.join(per_product, "product_id")
           .join(sizes, F.col("m.variant_id") == sizes["variant_id"], "left")
           .select(F.col("m.variant_id").alias("id"), F.col("product_id"), "name",
                   F.col("m.detail").alias("detail"),
                   price_floored("original_price", "m.discount").alias("price"),
                   "original_price",
                   F.when(d > 0, d).alias("discount"),
                   F.col("m.image").alias("image"),
                   F.transform("imgs", lambda x: x["image"]).alias("images"),
                   F.coalesce("sizes", F.array().cast("array<string>")).alias("sizes"),
                   "material", "gender", "badge", tags.alias("categories"),
                   F.col("m.registration_date").alias("registration_date"),
                   F.col("m.sale_start_date").alias("sale_start"),
                   F.col("m.sale_end_date").alias("sale_end"),
                   F.coalesce(F.col("m.sold_count"), F.lit(0)).alias("sold_count"),
                   F.coalesce(F.col("m.sold_count") > fixed.RECOMMENDED_SOLD_OVER, F.lit(False)).alias("is_recommended")))
    return out.orderBy("product_id")


def admin_catalog(t: dict[str, DataFrame]) -> DataFrame:
    """Every product with its variants, each with options {size as number, stock}.

    Options are ordered by numeric size (then option_id), variants by variant_id.
    A variant without options has ``options`` null; a product without variants has
    ``variants`` null (both as the reference's JSON aggregate gives).
    """
    opts = (t["product_options"]
            .groupBy("variant_id").agg(F.array_sort(F.collect_list(F.struct(
                size_number("size").alias("size"), F.col("option_id"),
                F.col("stock_quantity").alias("stock")))).alias("o")))
    opts = opts.select("variant_id", F.transform("o", lambda x: F.struct(
        x["size"].alias("size"), x["stock"].alias("stock"))).alias("options"))
    vars_ = (t["product_variants"].join(opts, "variant_id", "left")
             .groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(
                 "variant_id", F.col("color_name"), F.col("representative_image_url").alias("image"),
                 F.col("discount_rate"), F.col("registration_date"), F.col("options"))))
                 .alias("variants")))
    return (t["products"].join(vars_, "product_id", "left")
            .select(F.col("product_id").alias("group_id"), F.col("name").alias("group_name"),
                    F.col("base_price"), "variants"))


def table_counts(t: dict[str, DataFrame]) -> DataFrame:
    """Row counts of products, variants, options and reviews (one row per table)."""
    parts = [t[name].groupBy().agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(label).alias("table_name"), "row_count")
             for label, name in (("products", "products"), ("product_variants", "product_variants"),
                                 ("product_options", "product_options"), ("reviews", "reviews"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def color_size_counts(t: dict[str, DataFrame]) -> DataFrame:
    """Per product, number of colours (variants) and of size options.

    Counts are aggregated per variant, then per product, before joining, so the
    product x variant x option fan-out of the reference's query never materialises.
    """
    per_variant = t["product_options"].groupBy("variant_id").agg(F.count("option_id").alias("n_opt"))
    per_product = (t["product_variants"].select("variant_id", "product_id")
                   .join(per_variant, "variant_id", "left")
                   .groupBy("product_id").agg(F.count("variant_id").alias("color_count"),
                                              F.sum(F.coalesce("n_opt", F.lit(0))).alias("size_count")))
    return (t["products"].select("product_id", "name", "base_price")
            .join(per_product, "product_id", "left")
            .select("product_id", "name", "base_price",
                    F.coalesce("color_count", F.lit(0)).cast("bigint").alias("color_count"),
                    F.coalesce("size_count", F.lit(0)).cast("bigint").alias("size_count")))


def variant_images(t: dict[str, DataFrame], sort: bool = True) -> DataFrame:
    """Each variant with its product name, colour and image URL, by product then variant."""
    v = t["product_variants"].select("variant_id", "product_id", "color_name",
                                     "representative_image_url")
    out = v.join(t["products"].select("product_id", F.col("name").alias("product_name")), "product_id")
    out = out.select("variant_id", "product_id", "product_name", "color_name", "representative_image_url")
    return out.orderBy("product_id", "variant_id") if sort else out
