"""Checkout as a batch job over all users' requests (X1-X5), in feed order.

Requests take effect one after another by ``request_id``, as the reference's handlers would serve
them: a cart row that an earlier paid request bought is gone for a later one, and stock that earlier
paid requests took is gone too, so no option falls below zero. A request is paid whole or not at all.

Which requests are paid is decided by contention. A cart row is bought once at most, so an option can only run short if
the rows that name it ask for more than its stock, all together; and a request that asks one option for more than
there ever was is never paid. What is left after these two rules either meets nobody, and is paid, or contends for a
scarce option or for a cart row. Users who meet at scarce options form components (:mod:`cobbler.plans.components`);
each component is served in order by one task, which reads its lines as a stream. Of a component larger than
``LARGE`` lines, sure decisions are taken first, from running sums dealt over many tasks: a request is

* rejected for sure if a line is short even when only earlier *paid* requests count, and no undecided one can buy its cart row,
* paid for sure if every line fits even when all earlier *undecided* requests are paid as well.

When a scarce option has sold out, everything behind is rejected in one such step, so little is left of the component.

From the paid requests, what every line meets when its request is served (the stock left, or that its row is gone) is a
running sum per option and a join per cart row. Outputs are new table versions that the caller publishes together (see
``cobbler.plans.snapshots``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_datetime, ts_literal
from ..functions.fixed import PAID_STATUS as PAID
from ..functions.pricing import price_at_checkout
from ..plans.components import components
from ..plans.lookups import flag_known, keys_named
from ..plans.materialize import materialize
from ..session import ship_package
from .catalog import with_option_details

#: Requests are cut into this many stretches of the feed, so that a hot option's running sum is dealt over tasks.
STRETCHES = 32
#: Lines of a component above which sure decisions are taken first, and how often at most.
LARGE, SPLITS = 1_000_000, 4


def prepare_requests(requests: DataFrame) -> DataFrame:
    """Flag each request ``_invalid`` (no user, address or payment method). Idempotent: prepared requests pass through."""
    if "_invalid" in requests.columns:
        return requests
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return requests.withColumn("_invalid", F.col("user_id").isNull() | blank("shipping_address") | blank("payment_method"))


def price_checkout_lines(t: dict[str, DataFrame], requests: DataFrame, as_of) -> DataFrame:
    """The cart rows each valid request names, with unit price by rule P4 at ``as_of``.

    A request with ``cart_ids`` names those of the user's rows; without, all of them. Each cart row offers two
    keys, its own id and "the whole cart", so one join serves both kinds of request.
    """
    as_of = as_datetime(as_of)
    whole = F.lit(None).cast("bigint")
    wanted = (prepare_requests(requests).filter(~F.col("_invalid"))
              .select("request_id", "user_id", F.explode(
                  F.when(F.col("cart_ids").isNotNull() & (F.size("cart_ids") > 0), F.array_distinct("cart_ids"))
                  .otherwise(F.array(whole))).alias("_key"), (F.col("cart_ids").isNull() | (F.size("cart_ids") == 0)).alias("_whole"))
              .filter("_whole OR _key IS NOT NULL").select("request_id", "user_id", F.coalesce("_key", F.lit(0)).alias("_key"), "_whole"))
    rows = (t["cart"].join(wanted.select("user_id").distinct(), "user_id", "left_semi")
            .select("cart_id", "user_id", "option_id", "quantity", F.explode(F.array(F.lit(False), F.lit(True))).alias("_whole"))
            .withColumn("_key", F.when(F.col("_whole"), 0).otherwise(F.col("cart_id"))))
    lines = wanted.join(rows, ["user_id", "_whole", "_key"])
    unit = price_at_checkout("base_price", "discount_rate", "sale_start_date", "sale_end_date", as_of)
    return (with_option_details(lines, t)
            .select("request_id", "cart_id", "user_id", "option_id", "variant_id", "product_id",
                    "product_name", "color_name", "size", "quantity", "stock_quantity",
                    unit.alias("unit_price"), (unit * F.col("quantity")).alias("line_total")))


def _stretches(lines: DataFrame) -> Column:
    """The stretch of the feed that a line's request is in."""
    cuts = lines.agg(F.percentile_approx("request_id", [k / STRETCHES for k in range(1, STRETCHES)], 1000)).first()[0] or []
    stretch = F.lit(0)
    for c in sorted(set(cuts)):         # at most STRETCHES literals
        stretch = stretch + (F.col("request_id") > c).cast("int")
    return stretch


def _before(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """``df`` with, per row, the sum of each column over rows of the same ``key`` and earlier requests.

    Sums by stretch of the feed first, then within a stretch, so that one key's rows are in many tasks.
    """
    names = list(sums)
    df = df.withColumns({f"_v{k}": c for k, c in enumerate(sums.values())})
    stretch = df.groupBy(key, "_stretch").agg(*[F.sum(f"_v{k}").alias(f"_s{k}") for k in range(len(names))])
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)   # STRETCHES rows at most
    stretch = stretch.select(key, "_stretch", *[F.coalesce(F.sum(f"_s{k}").over(earlier), F.lit(0)).alias(f"_b{k}") for k in range(len(names))])
    inside = Window.partitionBy(key, "_stretch").orderBy("request_id").rangeBetween(Window.unboundedPreceding, -1)
    df = df.select("*", *[F.coalesce(F.sum(f"_v{k}").over(inside), F.lit(0)).alias(f"_i{k}") for k in range(len(names))])
    return (df.join(stretch, [key, "_stretch"])
            .select(*[c for c in df.columns if c[:2] not in ("_v", "_i")],
                    *[(F.col(f"_b{k}") + F.col(f"_i{k}")).alias(n) for k, n in enumerate(names)]))


def _contention(lines: DataFrame) -> DataFrame:
    """The lines of requests that may be paid, with ``scarce`` (the option) and ``contended`` (the request)."""
    hopeless = F.max(F.col("quantity") > F.col("stock"))
    able = lines.filter("known").groupBy("request_id").agg(hopeless.alias("_hopeless")).filter("NOT _hopeless").select("request_id")
    lines = lines.join(able, "request_id", "left_semi")
    rows = lines.groupBy("cart_id").agg(F.first("option_id").alias("option_id"), F.first("quantity").alias("quantity"),
                                        F.first("stock").alias("stock"), (F.count("*") > 1).alias("_shared"))
    options = rows.groupBy("option_id").agg((F.sum("quantity") > F.max("stock")).alias("scarce"))
    lines = (lines.join(rows.select("cart_id", "_shared"), "cart_id").join(options, "option_id")
             .withColumn("_c", F.col("_shared") | F.col("scarce")))
    meets = lines.groupBy("request_id").agg(F.max("_c").alias("contended"))
    return lines.join(meets, "request_id").select("request_id", "user_id", "cart_id", "option_id", "quantity", "stock", "scarce", "contended")


def _seen(state: DataFrame) -> DataFrame:
    """What undecided lines meet: ``left`` counts earlier paid requests, ``_asked`` earlier undecided ones; ``gone`` and
    ``_claimed`` likewise for the cart row."""
    one = lambda c: F.when(c, 1).otherwise(0)
    paid, open_ = F.col("state") == PAID, F.col("state").isNull()
    state = _before(state, "cart_id", {"_bought": one(paid), "_claimed": one(open_)})
    state = _before(state, "option_id", {"_taken": F.when(paid, F.col("quantity")).otherwise(0), "_asked": F.when(open_, F.col("quantity")).otherwise(0)})
    return (state.filter("state IS NULL").withColumns({"left": F.col("stock") - F.col("_taken"), "gone": F.col("_bought") > 0}))


def _sure(now: DataFrame) -> DataFrame:
    """``request_id, _new`` of the requests that can be decided at once, whatever becomes of the others."""
    here = ~F.col("gone")
    free = here & (F.col("_claimed") == 0)
    # stock only falls along the feed: a row too large for the most that an undecided request finds is bought by none
    most = now.groupBy("cart_id").agg(F.max("left").alias("_most"))
    stays = free | (here & (F.col("_most") < F.col("quantity")))
    return (now.join(most, "cart_id").groupBy("request_id").agg(
        F.max(here).alias("any"), F.max(stays & (F.col("left") < F.col("quantity"))).alias("short"),
        F.min(F.col("gone") | (free & (F.col("left") - F.col("_asked") >= F.col("quantity")))).alias("fits"))
        .select("request_id", F.when(~F.col("any") | F.col("short"), "out").when(F.col("fits"), PAID).alias("_new")).filter("_new IS NOT NULL"))


def _serve_in_order(batches):
    """Serve the requests of one component after another, in order; lines come sorted by component and request.

    ``left`` and ``gone`` count what was decided before; state is kept for the current component only.
    """
    import pandas as pd

    used: dict[int, int] = {}
    bought: set[int] = set()
    now, lines, paid = None, [], []

    def end() -> None:
        here = [x for x in lines if not x[3] and x[0] not in bought]
        if here and all(left - used.get(option, 0) >= quantity for _, option, quantity, _, left in here):
            paid.append(now[1])
            for row, option, quantity, _, _ in here:
                bought.add(row)
                used[option] = used.get(option, 0) + quantity

    for batch in batches:
        for component, request, *line in zip(*(batch[c].tolist() for c in ("component", "request_id", "cart_id", "option_id", "quantity", "gone", "left"))):
            if now != (component, request):
                if now is not None:
                    end()
                    if now[0] != component:
                        used, bought = {}, set()
                now, lines = (component, request), []
            lines.append(line)
        yield pd.DataFrame({"request_id": paid})
        paid = []
    if now is not None:
        end()
    yield pd.DataFrame({"request_id": paid})


def paid_requests(lines: DataFrame, how: str = "table", large: int = LARGE) -> DataFrame:
    """``request_id`` of the requests that are paid, of ``lines`` (request_id, user_id, cart_id, option_id, quantity, stock,
    ``known``: the request may buy)."""
    lines = materialize(_contention(lines), how)
    paid = lines.filter("NOT contended").select("request_id").distinct()
    state = lines.filter("contended").drop("contended").withColumn("state", F.lit(None).cast("string"))
    splits = 0
    while True:
        open_ = state.filter("state IS NULL")
        found = components(open_.filter("scarce").select(F.col("user_id").alias("node"), F.col("option_id").alias("group")), how)
        found = found.withColumnRenamed("node", "user_id")
        sizes = open_.join(found, "user_id").groupBy("component").agg(F.count("*").alias("n"))
        if splits == SPLITS or (sizes.agg(F.max("n")).first()[0] or 0) <= large:
            break
        state = state.withColumn("_stretch", _stretches(state)) if not splits else state
        verdict = _sure(materialize(_seen(state), how))
        state = materialize(state.join(verdict, "request_id", "left").withColumn("state", F.coalesce("state", "_new")).drop("_new"), how)
        splits += 1
    if splits:
        paid = paid.unionByName(state.filter(F.col("state") == PAID).select("request_id").distinct())
        open_ = _seen(state)
    else:
        open_ = open_.withColumns({"left": F.col("stock"), "gone": F.lit(False)})
    # a user who meets others at no scarce option is a component alone
    open_ = (open_.join(found, "user_id", "left").withColumn("component", F.coalesce("component", "user_id"))
             .select("component", "request_id", "cart_id", "option_id", F.col("quantity").cast("long"), "gone", F.col("left").cast("long")))
    served = (open_.repartition("component").sortWithinPartitions("component", "request_id", "cart_id")
              .mapInPandas(_serve_in_order, "request_id long"))
    return paid.unionByName(served)


def decide(lines: DataFrame, how: str = "table", large: int = LARGE) -> DataFrame:
    """Decide all requests of ``lines`` (request_id, user_id, cart_id, option_id, quantity, stock_quantity, ``known``).

    Returns the lines with ``state`` ('paid', 'insufficient_stock', 'empty' or 'unknown_reference'), ``gone``
    (the cart row was bought before) and ``stock_before`` (left when the request is served).
    """
    lines = lines.select("request_id", "user_id", "cart_id", "option_id", "quantity", F.coalesce("stock_quantity", F.lit(0)).alias("stock"), "known")
    paid = materialize(paid_requests(lines, how, large), how)
    lines = lines.join(paid.withColumn("_paid", F.lit(True)), "request_id", "left").withColumn("_stretch", _stretches(lines))
    # a row may be named by several paid requests: the first one bought it, later ones paid for what was left
    buyer = lines.filter("_paid").groupBy("cart_id").agg(F.min("request_id").alias("_buyer"))
    lines = (lines.join(buyer, "cart_id", "left").withColumn("gone", F.coalesce(F.col("_buyer") < F.col("request_id"), F.lit(False))))
    lines = _before(lines, "option_id", {"_taken": F.when(F.col("_buyer") == F.col("request_id"), F.col("quantity")).otherwise(0)})
    here = ~F.col("gone")
    left = F.col("stock") - F.col("_taken")
    of_request = (materialize(lines.withColumn("stock_before", left.cast("int")), how))
    states = of_request.groupBy("request_id").agg(
        F.when(F.first("_paid"), PAID).when(~F.max(here), "empty")
        .when(F.max(here & (F.col("stock_before") < F.col("quantity"))), "insufficient_stock").otherwise("unknown_reference").alias("state"))
    return of_request.join(states, "request_id").select("request_id", "cart_id", "state", "gone", "stock_before")


def serve(t: dict[str, DataFrame], requests: DataFrame, as_of, how: str = "table", large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """(priced lines as each request meets them, status per request).

    Statuses, in the reference's order: ``invalid``, ``empty``, ``insufficient_stock``, ``unknown_reference`` (the
    order's foreign key on the user), ``key_conflict`` (the request id is a stored order's), ``paid``.
    A line has the ``stock_quantity`` left when its request is served and is ``short`` if that is too little.
    """
    ship_package(requests.sparkSession)
    req = prepare_requests(requests)
    req = flag_known(req, t["users"], "user_id", "_user_ok")
    stored = (keys_named(t["orders"], req.select(F.col("request_id").alias("order_id")), "order_id")
              .select(F.col("order_id").alias("request_id"), F.lit(True).alias("_stored")))
    req = materialize(req.join(stored, "request_id", "left"), how)
    able = req.select("request_id", (F.col("_user_ok").isNotNull() & F.col("_stored").isNull()).alias("known"))
    priced = materialize(price_checkout_lines(t, req, as_of).join(able, "request_id"), how)
    decided = decide(priced, how, large)
    lines = (priced.drop("stock_quantity", "known").join(decided.filter("NOT gone"), ["request_id", "cart_id"])
             .withColumn("stock_quantity", F.col("stock_before")).withColumn("short", F.col("stock_before") < F.col("quantity"))
             .drop("gone", "stock_before"))
    lines = materialize(lines, how)
    # a request all of whose rows are gone has no lines left, and is empty
    per = lines.groupBy("request_id").agg(
        F.first("state").alias("state"), F.count(F.lit(1)).alias("line_count"), F.sum(F.col("short").cast("int")).alias("short_lines"),
        F.sum("line_total").alias("total_amount"))
    conflict = (F.col("state") == "unknown_reference") & F.col("_user_ok").isNotNull()
    status = (req.join(per, "request_id", "left")
              .select("request_id", "user_id",
                      F.when(F.col("_invalid"), "invalid").when(conflict, "key_conflict").otherwise(F.coalesce("state", F.lit("empty"))).alias("status"),
                      F.coalesce("line_count", F.lit(0)).cast("bigint").alias("line_count"),
                      F.coalesce("short_lines", F.lit(0)).cast("bigint").alias("short_lines"),
                      F.col("total_amount").cast("bigint").alias("total_amount"), "shipping_address", "payment_method"))
    return lines.drop("state"), materialize(status, how)


def build_orders(lines: DataFrame, status: DataFrame, as_of) -> dict[str, DataFrame]:
    """Order headers and items for paid requests. ``order_id`` = request_id,
    ``order_item_id`` = a hash of (request, cart row): the same row's id may be used again for a later purchase."""
    as_of = as_datetime(as_of)
    paid = status.filter(F.col("status") == PAID)
    now = ts_literal(as_of)
    orders = (paid
              .select(F.col("request_id").alias("order_id"), "user_id",
                      F.col("total_amount").cast("decimal(10,2)").alias("total_amount"),
                      "shipping_address", "payment_method", F.lit(PAID).alias("status"),
                      now.alias("created_at"), F.col("line_count").alias("item_count")))
    items = (paid_lines(lines, status)
             .select(F.xxhash64("request_id", "cart_id").alias("order_item_id"), F.col("request_id").alias("order_id"),
                     "option_id", "quantity", F.col("unit_price").cast("decimal(10,2)").alias("price"),
                     now.alias("created_at")))
    return {"orders": orders, "order_items": items}


def paid_lines(lines: DataFrame, status: DataFrame) -> DataFrame:
    return lines.join(status.filter(F.col("status") == PAID).select("request_id"), "request_id", "left_semi")


def stock_after(options: DataFrame, paid: DataFrame) -> DataFrame:
    """``options`` with stock minus the quantity bought."""
    by_opt = paid.groupBy("option_id").agg(F.sum("quantity").alias("_bought"))
    return (options.join(by_opt, "option_id", "left")
            .withColumn("stock_quantity", (F.col("stock_quantity") - F.coalesce("_bought", F.lit(0))).cast("int"))
            .select(*options.columns))


def sold_after(variants: DataFrame, paid: DataFrame) -> DataFrame:
    """``variants`` with sold_count plus the quantity bought; a null sold_count stays null."""
    by_var = paid.groupBy("variant_id").agg(F.sum("quantity").alias("_sold"))
    return (variants.join(by_var, "variant_id", "left")
            .withColumn("sold_count", F.col("sold_count") + F.coalesce("_sold", F.lit(0)))
            .select(*variants.columns))


def stock_and_sold_deltas(t: dict[str, DataFrame], paid: DataFrame) -> dict[str, DataFrame]:
    """The new options and the new variants."""
    return {"product_options": stock_after(t["product_options"], paid), "product_variants": sold_after(t["product_variants"], paid)}


def purge_cart(t: dict[str, DataFrame], paid: DataFrame) -> DataFrame:
    """The cart without the purchased rows."""
    bought = paid.select(F.col("cart_id").alias("_bought"))
    return t["cart"].join(bought, F.col("cart_id") == F.col("_bought"), "left_anti")


def checkout(t: dict[str, DataFrame], requests: DataFrame, as_of, how: str = "table", large: int = LARGE) -> dict[str, DataFrame]:
    """X1-X5 together: every output table of one checkout batch; every request is decided.

    Lines and decisions feed every output, so they are materialised (tables in the shared checkpoint folder by
    default; see :mod:`cobbler.plans.materialize`). ``large``: see :data:`LARGE`; the outcome does not depend on it.
    """
    lines, status = serve(t, requests, as_of, how, large)
    paid = paid_lines(lines, status)
    out = {"lines": lines, "paid": paid, "status": status.drop("shipping_address", "payment_method")}
    out.update(build_orders(lines, status, as_of))
    out.update(stock_and_sold_deltas(t, paid))
    out["cart"] = purge_cart(t, paid)
    return out
