"""Shop tables and request feeds derived from the driver's generated tables.

The generated data is a star schema of parts, suppliers, orders and line items
plus an ``events`` stream. This module builds the shop's tables from it with
DataFrame expressions (the rules are fixed in FIXTURES.md §3), so every query
reads the given tables and its work grows with them. All of it is lazy: a
query only pays for the views it touches, and Catalyst prunes the rest.
"""

from __future__ import annotations

from collections.abc import MutableMapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .tables import BODY

# Fixed values of the mapping (FIXTURES.md §3).
VARIANT_KEY_SCALE = 1000000      # variant_id = l_partkey * 1000000 + l_suppkey
OPTION_KEY_SCALE = 10            # option_id = variant_id * 10 + l_linenumber
ITEM_KEY_SCALE = 1000            # order_item_id = l_orderkey * 1000 + n
# Request ids of feeds whose ids become keys of new rows: a key space of their own.
REQUEST_KEY_BASE = 1_000_000_000_000
CART_KEY_SCALE = 1000            # cart_id = user_id * 1000 + k
ORDER_STATUS = {"F": "delivered", "O": "paid", "P": "pending"}


class _LazyTables(MutableMapping):
    """name -> DataFrame, built on first access (entries can be replaced, e.g. an empty cart)."""

    _NAMES = ("products", "materials", "product_variants", "product_options", "orders", "order_items",
              "reviews", "cart", "users")

    def __init__(self, shop):
        self._shop, self._over = shop, {}

    def __getitem__(self, name):
        if name in self._over:
            return self._over[name]
        if name not in self._NAMES:
            raise KeyError(name)
        if name == "order_items":
            return self._shop.order_items.drop("_returnflag", "_partkey")
        return getattr(self._shop, name)

    def __setitem__(self, name, df):
        self._over[name] = df

    def __delitem__(self, name):
        self._over.pop(name, None)

    def __iter__(self):
        return iter(self._NAMES)

    def __len__(self):
        return len(self._NAMES)


def _k() -> F.Column:
    return F.get_json_object("props", "$.k").cast("bigint")


class GeneratedShop:
    """Shop views over ``sf_dir``'s Parquet tables.

    The tables derived by aggregation (options, variants, order items, cart) are
    used many times by the larger jobs with different column subsets, which
    defeats exchange reuse; ``materialize='table'`` computes each once, on first
    use, as a Parquet table in the shared checkpoint folder (the way a production
    job reads stored tables). The default ``'none'`` keeps everything lazy: on
    the test scales recomputing is cheaper than writing (measured with bench.py).
    ``stored`` names tables that are materialised as a table whatever the mode, for queries that read them several times.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialize: str = "none", stored: tuple[str, ...] = ()):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.mode = materialize
        self.stored = stored

    def _mode(self, table: str) -> str:
        return "table" if table in self.stored else self.mode

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # ---------------- tables ----------------

    @cached_property
    def products(self) -> DataFrame:
        p = self.raw("part")
        return p.select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_name").alias("name"),
            F.col("p_retailprice").cast("decimal(10,2)").alias("base_price"),
            F.when(F.col("p_size") % 3 == 0, "MEN").when(F.col("p_size") % 3 == 1, "WOMEN")
             .otherwise("UNISEX").alias("gender"),
            F.when(F.col("p_partkey") % 10 == 0, F.lit(None).cast("bigint"))
             .otherwise(F.xxhash64("p_type")).alias("material_id"),
            F.col("p_brand").alias("badge"))

    @cached_property
    def materials(self) -> DataFrame:
        return (self.raw("part").select("p_type").distinct()
                .select(F.xxhash64("p_type").alias("material_id"),
                        F.upper("p_type").alias("code"), F.col("p_type").alias("title")))

    @staticmethod
    def _variant_id(p="l_partkey", s="l_suppkey") -> F.Column:
        return F.col(p) * VARIANT_KEY_SCALE + F.col(s)

    def _by_id(self, key: str, id_: F.Column, plain: F.Column, parts: list[str], *values: str) -> DataFrame:
        """Line items dealt out by an id made of ``parts``, so that grouping them and joining the groups on the id takes one
        shuffle. ``parts`` go along (in ``_odd``) only where the id does not give them back: nulls and numbers out of range."""
        odd = F.when(~F.coalesce(plain, F.lit(False)), F.struct(*parts))
        return self.raw("lineitem").select(id_.alias(key), odd.alias("_odd"), *values).repartition(key)

    @staticmethod
    def _part(name: str, of_id: F.Column) -> F.Column:
        return F.when(F.col("_odd").isNull(), of_id).otherwise(F.col("_odd")[name])

    @cached_property
    def product_options(self) -> DataFrame:
        plain = (F.col("l_partkey") >= 0) & F.col("l_suppkey").between(0, VARIANT_KEY_SCALE - 1) & F.col("l_linenumber").between(0, OPTION_KEY_SCALE - 1)
        lines = self._by_id("option_id", self._variant_id() * OPTION_KEY_SCALE + F.col("l_linenumber"), plain,
                            ["l_partkey", "l_suppkey", "l_linenumber"], "l_quantity")
        number = self._part("l_linenumber", F.pmod("option_id", F.lit(OPTION_KEY_SCALE)).cast("int"))
        variant = F.when(F.col("_odd").isNull(), F.expr(f"option_id div {OPTION_KEY_SCALE}")).otherwise(self._variant_id("_odd.l_partkey", "_odd.l_suppkey"))
        return materialize(lines.groupBy("option_id", "_odd").agg(F.sum("l_quantity").alias("qty")).select(
            "option_id", variant.alias("variant_id"), (220 + 10 * number).cast("string").alias("size"),
            (F.col("qty").cast("bigint") % 7).cast("int").alias("stock_quantity")), self._mode("product_options"))

    @cached_property
    def product_variants(self) -> DataFrame:
        plain = (F.col("l_partkey") >= 0) & F.col("l_suppkey").between(0, VARIANT_KEY_SCALE - 1)
        lines = self._by_id("variant_id", self._variant_id(), plain, ["l_partkey", "l_suppkey"], "l_quantity", "l_discount", "l_shipdate")
        v = lines.groupBy("variant_id", "_odd").agg(
            F.max("l_discount").alias("max_disc"), F.min("l_shipdate").alias("first_ship"),
            F.max("l_shipdate").alias("last_ship"), F.sum("l_quantity").alias("qty"))
        part = self._part("l_partkey", F.expr(f"variant_id div {VARIANT_KEY_SCALE}"))
        supp = self._part("l_suppkey", F.pmod("variant_id", F.lit(VARIANT_KEY_SCALE)).cast("bigint"))
        disc = F.round(F.col("max_disc") * 100).cast("int")
        return materialize(v.select(
            "variant_id",
            part.alias("product_id"),
            F.concat(F.lit("Supplier "), supp.cast("string")).alias("color_name"),
            F.lit(None).cast("string").alias("color_hex"),
            F.when(supp % 7 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("/images/"), part.cast("string"), F.lit("-"),
                                 supp.cast("string"), F.lit(".jpg")))
             .alias("representative_image_url"),
            F.when(disc == 0, F.lit(None).cast("int")).otherwise(disc).alias("discount_rate"),
            F.to_date("first_ship").alias("sale_start_date"),
            F.to_date("last_ship").alias("sale_end_date"),
            F.to_date("first_ship").alias("registration_date"),
            F.col("qty").cast("bigint").alias("sold_count")), self._mode("product_variants"))

    @cached_property
    def orders(self) -> DataFrame:
        o = self.raw("orders")
        status = F.when(F.col("o_orderstatus") == "F", ORDER_STATUS["F"]) \
                  .when(F.col("o_orderstatus") == "O", ORDER_STATUS["O"]) \
                  .when(F.col("o_orderstatus") == "P", ORDER_STATUS["P"])
        return o.select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("total_amount"),
            F.concat(F.lit("Address "), F.col("o_custkey").cast("string")).alias("shipping_address"),
            F.col("o_orderpriority").alias("payment_method"),
            status.alias("status"), F.col("o_orderdate").alias("created_at"))

    @cached_property
    def order_items(self) -> DataFrame:
        # the last two settle ties, and make every reader of the items ask for the same columns, so that one shuffle serves all
        place = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_returnflag"]
        w = Window.partitionBy("l_orderkey").orderBy(*place)
        # numbered first: what is made of the columns is not shuffled, and numbered lines lie by order
        li = self.raw("lineitem").select("l_orderkey", *place).withColumn("_n", F.row_number().over(w))
        return materialize(li.select(
            (F.col("l_orderkey") * ITEM_KEY_SCALE + F.col("_n")).alias("order_item_id"),
            F.col("l_orderkey").alias("order_id"),
            (self._variant_id() * OPTION_KEY_SCALE + F.col("l_linenumber")).alias("option_id"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
            F.col("l_shipdate").alias("created_at"),
            F.col("l_returnflag").alias("_returnflag"), F.col("l_partkey").alias("_partkey")), self._mode("order_items"))

    @cached_property
    def reviews(self) -> DataFrame:
        """General reviews (from view events) plus item reviews (returned line items)."""
        ev = self.raw("events").filter(F.col("event_type") == "view")
        general = ev.select(
            F.col("event_id").alias("review_id"), F.col("user_id"),
            _k().alias("product_id"), F.lit(None).cast("bigint").alias("order_item_id"),
            (1 + F.col("event_id") % 5).cast("int").alias("rating"),
            F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"),
            F.to_date("ts").alias("created_at"))
        it = self.order_items.filter(F.col("_returnflag") == "R")
        items = it.select(
            (-F.col("order_item_id")).alias("review_id"), F.lit(None).cast("bigint").alias("user_id"),
            F.col("_partkey").alias("product_id"), F.col("order_item_id"),
            (1 + F.col("order_item_id") % 5).cast("int").alias("rating"),
            F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("content"),
            F.to_date("created_at").alias("created_at"))
        return general.unionByName(items)

    @cached_property
    def _first_option_of_product(self) -> DataFrame:
        """Lowest option id of every product the events name (a variant's product is its part key)."""
        named = self.raw("events").select(_k().alias("l_partkey")).distinct()
        li = self.raw("lineitem").join(named, "l_partkey", "left_semi")
        return (li.groupBy(F.col("l_partkey").alias("product_id"))
                .agg(F.min(self._variant_id() * OPTION_KEY_SCALE + F.col("l_linenumber")).alias("option_id")))

    @cached_property
    def _cart_plan(self) -> DataFrame:
        ev = self.raw("events").filter(F.col("event_type") == "click").withColumn("k", _k())
        c = ev.groupBy("user_id", "k").agg(
            F.sum(1 + F.col("event_id") % 3).cast("int").alias("quantity"),
            F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
        return (c.join(self._first_option_of_product, c["k"] == F.col("product_id"))
                .select((F.col("user_id") * CART_KEY_SCALE + F.col("k")).alias("cart_id"),
                        "user_id", "option_id", "quantity", "created_at", "updated_at"))

    @cached_property
    def cart(self) -> DataFrame:
        return materialize(self._cart_plan, self._mode("cart"))

    @property
    def cart_schema(self):
        return self._cart_plan.schema

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        return c.select(F.col("c_custkey").alias("user_id"),
                        F.concat(F.lit("customer"), F.col("c_custkey").cast("string"),
                                 F.lit("@shop.test")).alias("email"),
                        F.col("c_name").alias("name"), F.lit("USER").alias("role"))

    def tables(self) -> MutableMapping[str, DataFrame]:
        """The shop's tables; each is built when a job first asks for it."""
        return _LazyTables(self)

    # ---------------- request feeds ----------------

    @cached_property
    def cart_changes(self) -> DataFrame:
        """Clicks add, views set, errors remove; rows are addressed by user_id*1000+k."""
        ev = (self.raw("events").filter(F.col("event_type").isin("click", "view", "error"))
              .withColumn("k", _k()))
        ev = ev.join(self._first_option_of_product, ev["k"] == F.col("product_id"), "left")
        op = F.when(F.col("event_type") == "click", "add").when(F.col("event_type") == "view", "set") \
              .otherwise("remove")
        return ev.select(
            F.col("event_id").alias("request_id"), "ts", "user_id", op.alias("op"),
            F.when(F.col("event_type") == "click", F.col("option_id")).alias("option_id"),
            (F.col("user_id") * CART_KEY_SCALE + F.col("k")).alias("cart_id"),
            F.when(F.col("event_type") != "error", (1 + F.col("event_id") % 3).cast("int"))
             .alias("quantity"))

    @cached_property
    def cart_change_bodies(self) -> DataFrame:
        """The cart changes as JSON bodies, some of them cut off, with a word for a quantity, without an id, or blank."""
        n = F.col("request_id")
        body = F.to_json(F.struct("request_id", "ts", "user_id", "op", "option_id", "cart_id", "quantity"))
        return self.cart_changes.select(
            F.when(n % 97 == 0, F.substr(body, F.lit(1), F.length(body) - 1)).when(n % 89 == 0, F.regexp_replace(body, '}$', ',"quantity":"two"}'))
            .when(n % 83 == 0, F.regexp_replace(body, '"request_id"', '"request"')).when(n % 79 == 0, "  ").otherwise(body).alias(BODY))

    @cached_property
    def checkout_requests(self) -> DataFrame:
        """One request per purchase event, so users come several times: their whole cart, or the rows of
        products k and k + 1 (bought before, or never there, for some); a few have no address."""
        ev = self.raw("events").filter(F.col("event_type") == "purchase").withColumn("k", _k())
        row = F.col("user_id") * CART_KEY_SCALE + F.col("k")
        return ev.select(
            (F.lit(REQUEST_KEY_BASE) + F.col("event_id")).alias("request_id"), "user_id",
            F.when(F.col("event_id") % 40 != 1, F.concat(F.lit("Address "), F.col("user_id").cast("string"))).alias("shipping_address"),
            F.lit("card").alias("payment_method"),
            F.when(F.col("event_id") % 4 != 0, F.array(row, row + 1)).alias("cart_ids"))

    @cached_property
    def option_changes(self) -> DataFrame:
        """Stock changes from 'N' line items; open lines name a new half size."""
        li = self.raw("lineitem").filter(F.col("l_returnflag") == "N")
        size = 220 + 10 * F.col("l_linenumber") + F.when(F.col("l_linestatus") == "O", 5).otherwise(0)
        return li.select(
            self._variant_id().alias("variant_id"), size.cast("string").alias("size"),
            F.col("l_quantity").cast("int").alias("stock"),
            # FIXTURES' order (ship date, order, price); quantity last so full ties cannot differ
            F.struct("l_shipdate", "l_orderkey", "l_extendedprice", "l_quantity").alias("seq"))

    @cached_property
    def variant_changes(self) -> DataFrame:
        """Variant-change requests, one per 'N' line item, in the order of the option changes: a stock, and for open lines
        (a new half size) the discount of the line too."""
        li = self.raw("lineitem").filter(F.col("l_returnflag") == "N")
        open_ = F.col("l_linestatus") == "O"
        size = (220 + 10 * F.col("l_linenumber") + F.when(open_, 5).otherwise(0)).cast("string")
        # request ids rise with ship date, order, quantity and discount
        quantity, discount = F.col("l_quantity").cast("bigint"), F.round(F.col("l_discount") * 100).cast("int")
        seq = ((F.unix_date(F.to_date("l_shipdate")).cast("bigint") * 1_000_000_000 + F.col("l_orderkey")) * 100 + quantity) * 100 + discount
        return li.select(seq.alias("request_id"), self._variant_id().alias("variant_id"), discount.alias("discount_rate"),
                         open_.alias("discount_given"), F.array(F.struct(size.alias("size"), quantity.cast("int").alias("stock"))).alias("options"))

    @cached_property
    def nested_products(self) -> DataFrame:
        """Every part as a nested product feed: its variants (by variant_id), each with its options."""
        opts = (self.product_options.groupBy("variant_id")
                .agg(F.array_sort(F.collect_list(F.struct("size", F.col("stock_quantity").alias("stock"))))
                     .alias("options")))
        per_product = (self.product_variants.join(opts, "variant_id", "left")
                       .groupBy("product_id")
                       .agg(F.array_sort(F.collect_list(F.struct(
                           "variant_id", "color_name", F.col("representative_image_url").alias("image"),
                           "discount_rate", "options"))).alias("v")))
        return (self.products.join(per_product, "product_id", "left")
                .select("product_id", F.col("name").alias("group_name"), "base_price",
                        F.transform("v", lambda x: F.struct(x["color_name"].alias("color_name"),
                                                            x["image"].alias("image"),
                                                            x["discount_rate"].alias("discount_rate"),
                                                            x["options"].alias("options"))).alias("variants")))

    @cached_property
    def new_variants(self) -> DataFrame:
        """New colours requested by purchase events for product k, each with one size."""
        ev = self.raw("events").filter(F.col("event_type") == "purchase")
        return ev.select(
            (F.lit(REQUEST_KEY_BASE) + F.col("event_id")).alias("request_id"), _k().alias("product_id"),
            F.concat(F.lit("Colour "), (F.col("event_id") % 10).cast("string")).alias("color_name"),
            F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("/images/new-"), F.col("event_id").cast("string"), F.lit(".jpg")))
             .alias("image"),
            (F.col("event_id") % 30).cast("int").alias("discount_rate"),
            F.array(F.struct((230 + 10 * (F.col("event_id") % 7)).cast("string").alias("size"),
                             (F.col("event_id") % 5).cast("int").alias("stock"))).alias("options"))

    @cached_property
    def image_changes(self) -> DataFrame:
        """A new image per 'A' line item; the latest (ship date, order) per variant wins."""
        li = self.raw("lineitem").filter(F.col("l_returnflag") == "A")
        return li.select(
            self._variant_id().alias("variant_id"),
            F.concat(F.lit("/images/"), F.col("l_partkey").cast("string"), F.lit("-"),
                     F.col("l_suppkey").cast("string"), F.lit("-"), F.col("l_orderkey").cast("string"),
                     F.lit(".jpg")).alias("image"),
            F.struct("l_shipdate", "l_orderkey").alias("seq"))

    @cached_property
    def discount_changes(self) -> DataFrame:
        """A new discount per returned line item; the latest (ship date, order) wins, 0 is a discount of nothing."""
        li = self.raw("lineitem").filter(F.col("l_returnflag") == "R")
        return li.select(
            self._variant_id().alias("variant_id"), F.round(F.col("l_discount") * 100).cast("int").alias("discount_rate"),
            F.struct("l_shipdate", "l_orderkey", "l_extendedprice", "l_quantity", "l_discount").alias("seq"))

    @cached_property
    def review_requests(self) -> DataFrame:
        """General reviews from signups; an item review of every order item by who ordered it (some twice, some of an
        item that is not there), with titles and contents that may be blank."""
        ev = self.raw("events").filter(F.col("event_type") == "signup")
        general = ev.select(
            F.col("event_id").alias("request_id"), F.col("ts"), "user_id", _k().alias("product_id"),
            F.lit(None).cast("bigint").alias("order_item_id"),
            (1 + F.col("event_id") % 6).cast("int").alias("rating"),
            F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("Review "), F.col("event_id").cast("string"))).alias("title"),
            F.when(F.col("event_id") % 5 == 0, "").otherwise("as said").alias("content"))
        it = self.order_items.join(self.orders.select("order_id", "user_id"), "order_id", "left")
        n = F.col("order_item_id") % ITEM_KEY_SCALE
        again = F.when(n == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))     # a day later
        of_items = it.select("*", F.explode(again).alias("_again")).select(
            (F.lit(2 * REQUEST_KEY_BASE) + F.col("order_item_id") + F.when(F.col("_again"), REQUEST_KEY_BASE).otherwise(0)).alias("request_id"),
            F.when(F.col("_again"), F.col("created_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("created_at")).alias("ts"), "user_id",
            F.col("_partkey").alias("product_id"),
            F.when(n == 5, F.col("order_item_id") + ITEM_KEY_SCALE // 2).otherwise(F.col("order_item_id")).alias("order_item_id"),
            (1 + F.col("order_item_id") % 6).cast("int").alias("rating"),
            F.concat(F.lit("Item "), F.col("order_item_id").cast("string")).alias("title"),
            F.when(F.col("order_item_id") % 5 != 0, "as bought").alias("content"))
        return materialize(general.unionByName(of_items), "table" if "review_requests" in self.stored else "none")

    @cached_property
    def user_requests(self) -> DataFrame:
        c = self.raw("customer")
        local = F.concat(F.lit("user"), (F.col("c_custkey") % 1000).cast("string"))
        return c.select(
            (F.lit(REQUEST_KEY_BASE) + F.col("c_custkey")).alias("request_id"),
            F.when(F.col("c_custkey") >= 1000, F.upper(local)).otherwise(local).alias("email"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"),
            F.lit(True).alias("has_password"))
