"""Reviews: listing (R1), rating summary (R2) and review intake as a batch job.

Intake applies the reference's checks to a whole feed of review requests at once.
Feed order is ``(ts, request_id)`` when the feed has ``ts``, else ``request_id``.
Duplicate detection per user and product uses only min-aggregates (partial aggregation), so a
hot product or user does not pile its rows into one task. The requests that name one order item meet in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_datetime, blank_to_null, half_up_tenths, ts_literal
from ..functions.fixed import RATING_MAX, RATING_MIN
from ..plans.lookups import count_known, few, keys_named
from ..plans.materialize import materialize

REVIEW_FIELDS = ["review_id", "product_id", "user_id", "rating", "title", "content", "created_at"]


def review_list(t: dict[str, DataFrame], product_ids: DataFrame | None = None,
                sort: bool = True) -> DataFrame:
    """Reviews of the given products (all when None), newest first within a product."""
    r = t["reviews"].select(*REVIEW_FIELDS)
    if product_ids is not None:
        r = r.join(product_ids.select("product_id"), "product_id", "left_semi")
    return r.orderBy("product_id", F.desc("created_at"), F.desc("review_id")) if sort else r


def rating_summary(t: dict[str, DataFrame], product_ids: DataFrame | None = None) -> DataFrame:
    """R2: per product, review count and average rating to one decimal (0 with no reviews).

    A null rating counts 0 in the sum and 1 in the count (N6); rounding is exact half up (H4).
    """
    per = t["reviews"].groupBy("product_id").agg(
        F.sum(F.coalesce("rating", F.lit(0))).alias("rating_sum"), F.count(F.lit(1)).alias("n"))
    p = t["products"].select("product_id")
    if product_ids is not None:
        p = p.join(product_ids.select("product_id"), "product_id", "left_semi")
    out = p.join(per, "product_id", "left")
    return out.select(
        "product_id",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("review_count"),
        F.when(F.col("n") > 0, half_up_tenths(F.col("rating_sum"), F.col("n")))
         .otherwise(F.lit(0.0)).alias("avg_rating"))


def _seq(df: DataFrame) -> F.Column:
    return F.struct("ts", "request_id") if "ts" in df.columns else F.struct("request_id")


def intake_reviews(t: dict[str, DataFrame], requests: DataFrame, as_of, how: str = "table") -> dict[str, DataFrame]:
    """Validate a feed of review requests; returns ``status`` per request and new ``reviews`` rows.

    Statuses, in the reference's order: ``invalid`` (product or rating missing/0),
    ``bad_rating`` (outside 1..5), ``not_found`` (unknown product), ``duplicate``,
    then the insert: ``unknown_reference`` when the user or the order item does not
    exist (the table's foreign keys reject it), ``key_conflict`` when the request's id is a stored
    review's, else ``accepted``. With an order item:
    duplicate if the item has a stored review or an accepted request for it earlier in
    the feed. Without: duplicate if the (user, product) pair has a stored review of any
    kind, or an accepted review of the pair earlier in the feed (an item review earlier
    in the feed blocks a general one, not the reverse). A null user matches nothing and
    passes the user key. A rejected insert stores nothing, so it blocks nobody. New rows
    take ``review_id = request_id`` and ``created_at = as_of``'s date.
    """
    as_of = as_datetime(as_of)
    # checks move keys only; titles and contents join the accepted requests
    has_item = F.col("order_item_id").isNotNull() & (F.col("order_item_id") != 0)
    wrong = (F.when(F.col("product_id").isNull() | (F.col("product_id") == 0)
                    | F.col("rating").isNull() | (F.col("rating") == 0), "invalid")
             .when((F.col("rating") < RATING_MIN) | (F.col("rating") > RATING_MAX), "bad_rating"))
    ts = [c for c in ("ts",) if c in requests.columns]
    req = requests.select("request_id", *ts, "user_id", "product_id", "order_item_id", wrong.alias("_wrong"))
    again = few(req.groupBy("request_id").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
                .select("request_id", F.lit(True).alias("_again")), how)
    req = count_known(req, t["products"], "product_id", "_products", 1, how)
    req = count_known(req, t["users"], "user_id", "_users", 1, how)
    req = count_known(req, t["reviews"].select(F.col("review_id").alias("request_id")), "request_id", "_stored", 0, how)
    req = req.join(again, "request_id", "left")
    item, general = req.filter(has_item), req.filter(~F.coalesce(has_item, F.lit(False)))

    # Item reviews: the requests of an item meet once. Per item, the first insertable request is accepted unless the item has
    # a review; stored reviews that matter are those of the items that the feed names.
    n_items = keys_named(t["order_items"], item, "order_item_id").groupBy("order_item_id").agg(F.count(F.lit(1)).alias("_items"))
    taken = keys_named(t["reviews"], item, "order_item_id").distinct().withColumn("_taken", F.lit(True))
    item = item.join(n_items, "order_item_id", "left").join(taken, "order_item_id", "left")
    # a zero is no item, though a stored item may have it
    zero = few(t["order_items"].filter("order_item_id = 0").groupBy("order_item_id").agg(F.count(F.lit(1)).alias("_items")), how)
    general = general.join(zero, "order_item_id", "left").withColumn("_taken", F.lit(None).cast("boolean"))

    def checked(rows: DataFrame, item_ok: Column) -> DataFrame:
        """``_base`` (the status of what is not valid), ``_fk``, ``_free`` (its insert would succeed), ``_seq`` and how many
        rows the checks make of a request: more than one if a key that it names is stored several times."""
        times = reduce(Column.__mul__, [F.greatest(F.coalesce(n, F.lit(0)), F.lit(1)) for n in ("_products", "_users", "_items", "_stored")])
        base = F.coalesce("_wrong", F.when(F.col("_products") == 0, "not_found"))
        fk = (F.col("user_id").isNull() | (F.col("_users") > 0)) & item_ok
        return (rows.withColumn("_base", base).withColumn("_fk", fk).withColumn("_times", times).withColumn("_seq", _seq(rows))
                .withColumn("_free", F.col("_base").isNull() & F.col("_fk") & (F.col("_stored") == 0)))
    refused = F.when(F.col("_fk"), "key_conflict").otherwise("unknown_reference")
    item = checked(item, F.coalesce(F.col("_items"), F.lit(0)) > 0).withColumn(
        "_acc_seq", F.min(F.when(F.col("_free"), F.col("_seq"))).over(Window.partitionBy("order_item_id")))
    item = item.withColumn("_st", F.when(F.col("_base").isNull(), F.when(F.col("_taken").isNotNull(), "duplicate")
                                         .when(F.col("_acc_seq") < F.col("_seq"), "duplicate")
                                         .when(F.col("_acc_seq") == F.col("_seq"), "accepted")
                                         .otherwise(refused)))
    general = checked(general, F.lit(True)).withColumn("_st", F.lit(None).cast("string"))
    # the checks feed every branch below: made once
    kept = ["request_id", *ts, "user_id", "product_id", "order_item_id", "_again", "_times", "_base", "_fk", "_free", "_st"]
    rows = materialize(item.select(*kept).unionByName(general.select(*kept)), how)
    rows = rows.withColumn("_seq", _seq(rows))
    item, general = rows.filter(has_item), rows.filter(~F.coalesce(has_item, F.lit(False)))
    valid = general.filter(F.col("_base").isNull())

    # General reviews: per (user, product), the first insertable general request is accepted unless
    # the pair has a stored review or an accepted item review of the pair comes before it.
    pair = ["user_id", "product_id"]
    pair_taken = (t["reviews"].select(*pair).join(valid.select(*pair).where(F.col("user_id").isNotNull()).distinct(), pair, "left_semi")
                  .distinct().withColumn("_stored_pair", F.lit(True)))
    item_pairs = (item.filter(F.col("_st") == "accepted").filter(F.col("user_id").isNotNull())
                  .groupBy(*pair).agg(F.min("_seq").alias("_item_seq")))
    gen_first = (valid.filter("_free").filter(F.col("user_id").isNotNull()).groupBy(*pair)
                 .agg(F.min("_seq").alias("_gen_first")))
    gen_acc = (gen_first.join(pair_taken, pair, "left_anti").join(item_pairs, pair, "left")
               .filter(F.col("_item_seq").isNull() | (F.col("_item_seq") > F.col("_gen_first")))
               .select(*pair, F.col("_gen_first").alias("_gen_acc")))
    gen = (valid.drop("_st").join(pair_taken, pair, "left").join(item_pairs, pair, "left")
           .join(gen_acc, pair, "left")
           .withColumn("_first_acc", F.least("_item_seq", "_gen_acc"))
           .withColumn("_st", F.when(F.col("user_id").isNull(), F.when(F.col("_free"), "accepted").otherwise(refused))
                       .when(F.col("_stored_pair").isNotNull(), "duplicate")
                       .when(F.col("_first_acc") < F.col("_seq"), "duplicate")
                       .when(F.col("_gen_acc") == F.col("_seq"), "accepted")
                       .otherwise(refused)))
    cols = ["request_id", "_again", "_times", "_base", "_st"]
    decided = materialize(item.select(*cols).unionByName(general.filter(F.col("_base").isNotNull()).select(*cols))
                          .unionByName(gen.select(*cols)), how)
    # A row of the checks has the outcome of every valid row of its request id; an id that comes once has its own only.
    copies = lambda n: F.explode(F.array_repeat(F.lit(1), n.cast("int"))).alias("_copy")
    own = F.col("_base").isNull() & F.col("request_id").isNotNull()
    once = (decided.filter(F.col("_again").isNull())
            .select("request_id", F.coalesce("_base", F.when(own, F.col("_st"))).alias("status"),
                    copies(F.when(own, F.col("_times") * F.col("_times")).otherwise(F.col("_times")))).drop("_copy"))
    several = decided.filter(F.col("_again").isNotNull()).select("*", copies(F.col("_times")))
    several = (several.select("request_id", "_base").join(several.filter(F.col("_base").isNull()).select("request_id", "_st"), "request_id", "left")
               .select("request_id", F.coalesce("_base", "_st").alias("status")))
    status = materialize(once.unionByName(several), how)
    # The texts of what was accepted; a request comes as often as the checks made it, which depends on its keys only.
    keys = ["user_id", "product_id", "order_item_id"]
    often = (rows.filter("_times > 1").select("request_id", *keys, "_times").distinct()
             .groupBy("request_id").agg(F.collect_list(F.struct(*keys, "_times")).alias("_often")))
    mine = F.filter("_often", lambda m: reduce(Column.__and__, [m[k].eqNullSafe(F.col(k)) for k in keys]))
    new_rows = (requests.join(status.filter(F.col("status") == "accepted").select("request_id").distinct(), "request_id", "left_semi")
                .join(few(often, how), "request_id", "left")
                .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.coalesce(F.try_element_at(mine, F.lit(1))["_times"], F.lit(1)).cast("int"))))
                .select(F.col("request_id").alias("review_id"), "user_id", "product_id",
                        F.when(has_item, F.col("order_item_id")).alias("order_item_id"),
                        "rating", blank_to_null("title").alias("title"),
                        blank_to_null("content").alias("content"),
                        F.to_date(ts_literal(as_of)).alias("created_at")))
    return {"status": status, "reviews": new_rows}
