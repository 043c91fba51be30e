"""DuckDB SQL for every ``queries()`` key: the same question asked of the raw tables.

Parameters are the ones ``__spark_entry__`` passes to the library.
Nested results are compared as joined strings (see ``cobbler.plans.render``).
"""

from __future__ import annotations

from .mapping import K, build

SALES_START, SALES_END = "1996-01-01", "2000-12-31"
SALES_END_NEXT = "2001-01-01"

_DAILY = f"""
    SELECT o.variant_id, strftime(ord.created_at, '%Y-%m-%d') AS sales_date,
           CAST(sum(i.quantity) AS BIGINT) AS daily_qty, sum(i.quantity * i.price) AS daily_revenue
    FROM s_items i JOIN s_orders ord ON i.order_id = ord.order_id
         JOIN s_options o ON i.option_id = o.option_id
    WHERE ord.created_at >= TIMESTAMP '{SALES_START}' AND ord.created_at < TIMESTAMP '{SALES_END_NEXT}'
      AND upper(ord.status) IN ('PAID', 'SHIPPED', 'DELIVERED')
    GROUP BY o.variant_id, strftime(ord.created_at, '%Y-%m-%d')"""

_NAMES = """
    SELECT v.variant_id, p.name || ' (' || v.color_name || ')' AS name, v.image
    FROM s_variants v JOIN s_products p ON v.product_id = p.product_id"""

SQL: dict[str, str] = {}

SQL["daily_variant_sales"] = build(
    """SELECT d.variant_id, n.name, n.image, d.sales_date, d.daily_qty,
              CAST(d.daily_revenue AS DOUBLE) AS daily_revenue
       FROM daily d JOIN names n ON d.variant_id = n.variant_id""",
    {"daily": _DAILY, "names": _NAMES})

_SUMMARY = """SELECT t.variant_id, n.name, n.image, t.total_qty, t.total_revenue, t.daily_history
       FROM (SELECT variant_id, CAST(sum(daily_qty) AS BIGINT) AS total_qty,
                    CAST(sum(daily_revenue) AS DOUBLE) AS total_revenue,
                    string_agg(sales_date || ':' || CAST(daily_qty AS VARCHAR) || ':'
                               || CAST(daily_revenue AS VARCHAR), ';' ORDER BY sales_date) AS daily_history
             FROM daily GROUP BY variant_id) t
       JOIN names n ON t.variant_id = n.variant_id"""

SQL["sales_summary"] = build(_SUMMARY, {"daily": _DAILY, "names": _NAMES})
SQL["sales_summary_published"] = SQL["sales_summary"]

# ---------------- catalog ----------------

CATALOG_AS_OF = "1999-05-31 00:00:00"
CATALOG_MONTH_AGO = "1999-05-01 00:00:00"   # JS month-back of 31 May overflows to 1 May (N7)
SIZE_NUM = "coalesce(try_cast(regexp_extract(size, '^[0-9]+', 0) AS BIGINT), 0)"

SQL["product_page"] = build(
    "SELECT product_id, name, CAST(base_price AS DOUBLE) AS base_price FROM s_products "
    "ORDER BY product_id LIMIT 5")

SQL["in_stock_sizes"] = build(
    "SELECT variant_id, string_agg(size, ',' ORDER BY size) AS sizes FROM s_options "
    "WHERE stock_quantity > 0 GROUP BY variant_id")

SQL["popular_variants"] = build(
    """SELECT variant_id AS id, name, color_name AS detail, CAST(base_price AS DOUBLE) AS original_price,
              CAST(round(base_price * (100 - coalesce(discount_rate, 0)) * CAST(0.01 AS DECIMAL(3,2)), 0)
                   AS BIGINT) AS price,
              image,
              coalesce((SELECT string_agg(size, ',' ORDER BY size) FROM s_options o
                        WHERE o.variant_id = top.variant_id AND o.stock_quantity > 0), '') AS sizes,
              row_number() OVER (ORDER BY registration_date DESC NULLS LAST, variant_id) AS rank
       FROM top""",
    {"top": """SELECT v.variant_id, p.name, v.color_name, p.base_price, v.discount_rate, v.image,
                      v.registration_date
               FROM s_variants v JOIN s_products p ON v.product_id = p.product_id
               ORDER BY v.registration_date DESC NULLS LAST, v.variant_id LIMIT 10"""})

SQL["gender_catalog"] = build(
    f"""SELECT m.variant_id AS id, p.product_id, p.name, m.color_name AS detail,
              CAST(floor(CAST(p.base_price AS DOUBLE) * (1 - coalesce(m.discount_rate, 0) / 100.0)) AS BIGINT)
                  AS price,
              CAST(p.base_price AS DOUBLE) AS original_price,
              CASE WHEN coalesce(m.discount_rate, 0) > 0 THEN m.discount_rate END AS discount,
              m.image, i.images, coalesce(s.sizes, '') AS sizes, p.material, p.gender, p.badge,
              concat_ws(',',
                CASE WHEN CAST(m.registration_date AS TIMESTAMP) >= TIMESTAMP '{CATALOG_MONTH_AGO}' THEN 'new' END,
                CASE WHEN coalesce(m.discount_rate, 0) > 0 AND m.sale_start_date IS NOT NULL
                          AND m.sale_end_date IS NOT NULL
                          AND TIMESTAMP '{CATALOG_AS_OF}' >= CAST(m.sale_start_date AS TIMESTAMP)
                          AND TIMESTAMP '{CATALOG_AS_OF}' <= CAST(m.sale_end_date AS TIMESTAMP) THEN 'sale' END,
                CASE WHEN contains(p.badge, 'LIFESTYLE') THEN 'lifestyle' END,
                CASE WHEN contains(p.badge, 'SLIP') THEN 'slipon' END) AS categories,
              m.registration_date, m.sale_start_date AS sale_start, m.sale_end_date AS sale_end,
              coalesce(m.sold_count, 0) AS sold_count, coalesce(m.sold_count > 1000, false) AS is_recommended
       FROM prods p JOIN pv m ON p.product_id = m.product_id AND m.rn = 1
            LEFT JOIN imgs i ON i.product_id = p.product_id
            LEFT JOIN sz s ON s.variant_id = m.variant_id""",
    {"prods": "SELECT * FROM s_products WHERE upper(gender) = 'MEN'",
     "pv": """SELECT v.*, row_number() OVER (PARTITION BY v.product_id ORDER BY v.variant_id) AS rn
              FROM s_variants v WHERE v.product_id IN (SELECT product_id FROM prods)""",
     "imgs": "SELECT product_id, string_agg(coalesce(image, ''), ',' ORDER BY variant_id) AS images "
             "FROM pv GROUP BY product_id",
     "sz": "SELECT variant_id, string_agg(size, ',' ORDER BY size) AS sizes FROM s_options "
           "WHERE stock_quantity > 0 GROUP BY variant_id"})

SQL["admin_catalog"] = build(
    """SELECT p.product_id AS group_id, p.name AS group_name, CAST(p.base_price AS DOUBLE) AS base_price,
              pv.variants
       FROM s_products p LEFT JOIN pv ON p.product_id = pv.product_id""",
    {"vo": f"""SELECT variant_id,
                      string_agg(CAST({SIZE_NUM} AS VARCHAR) || ':' || coalesce(CAST(stock_quantity AS VARCHAR), ''),
                                 ',' ORDER BY {SIZE_NUM}, option_id) AS options
               FROM s_options GROUP BY variant_id""",
     "pv": """SELECT v.product_id,
                     string_agg(concat_ws('|', CAST(v.variant_id AS VARCHAR), coalesce(v.color_name, ''),
                                          coalesce(v.image, ''), coalesce(CAST(v.discount_rate AS VARCHAR), ''),
                                          coalesce(CAST(v.registration_date AS VARCHAR), ''),
                                          coalesce(vo.options, '')), ';' ORDER BY v.variant_id) AS variants
              FROM s_variants v LEFT JOIN vo ON v.variant_id = vo.variant_id GROUP BY v.product_id"""})

SQL["table_counts"] = build(
    """SELECT 'products' AS table_name, count(*) AS row_count FROM s_products
       UNION ALL SELECT 'product_variants', count(*) FROM s_variants
       UNION ALL SELECT 'product_options', count(*) FROM s_options
       UNION ALL SELECT 'reviews', count(*) FROM s_reviews""")

SQL["color_size_counts"] = build(
    """SELECT product_id, name, CAST(base_price AS DOUBLE) AS base_price,
              coalesce(colors, 0) AS color_count, CAST(coalesce(sizes, 0) AS BIGINT) AS size_count
       FROM s_products LEFT JOIN per_product USING (product_id)""",
    {"per_variant": "SELECT variant_id, count(*) AS sizes FROM s_options GROUP BY variant_id",
     "per_product": """SELECT product_id, count(*) AS colors, sum(coalesce(sizes, 0)) AS sizes
                       FROM s_variants LEFT JOIN per_variant USING (variant_id) GROUP BY product_id"""})

SQL["variant_images"] = build(
    """SELECT variant_id, product_id, names.name AS product_name, color_name, image AS representative_image_url
       FROM s_variants JOIN (SELECT product_id, name FROM s_products) names USING (product_id)""")

# ---------------- orders ----------------

_FLAG = "SELECT DISTINCT order_item_id FROM s_reviews WHERE order_item_id IS NOT NULL"
_LINES = """
    SELECT o.order_id, o.user_id, o.total_amount, o.shipping_address, o.payment_method, o.status,
           o.created_at, i.order_item_id, i.quantity, i.price, p.product_id, p.name AS product_name,
           p.base_price, v.variant_id, v.color_name, v.image AS color_img, op.option_id, op.size,
           (f.order_item_id IS NOT NULL) AS is_review_written
    FROM s_orders o JOIN s_items i ON o.order_id = i.order_id
         JOIN s_options op ON i.option_id = op.option_id
         JOIN s_variants v ON op.variant_id = v.variant_id
         JOIN s_products p ON v.product_id = p.product_id
         LEFT JOIN flag f ON i.order_item_id = f.order_item_id"""

SQL["reviewed_items"] = build(_FLAG.replace("SELECT DISTINCT order_item_id",
                                            "SELECT DISTINCT order_item_id, true AS is_review_written"))

SQL["order_lines"] = build(
    """SELECT order_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount, shipping_address,
              payment_method, status, created_at, order_item_id, quantity, CAST(price AS DOUBLE) AS price,
              product_id, product_name, CAST(base_price AS DOUBLE) AS base_price, variant_id, color_name,
              color_img, option_id, size, is_review_written
       FROM lines""", {"flag": _FLAG, "lines": _LINES})

SQL["order_history"] = build(
    """SELECT order_id, user_id, CAST(total_amount AS DOUBLE) AS total_amount, shipping_address,
              payment_method, status, created_at,
              string_agg(concat_ws(':', CAST(order_item_id AS VARCHAR), CAST(product_id AS VARCHAR),
                                   coalesce(product_name, ''), CAST(quantity AS VARCHAR), CAST(price AS VARCHAR),
                                   coalesce(color_name, ''), coalesce(color_img, ''), coalesce(size, ''),
                                   CAST(option_id AS VARCHAR), CAST(is_review_written AS VARCHAR)),
                         ';' ORDER BY order_item_id) AS items
       FROM lines
       GROUP BY order_id, user_id, total_amount, shipping_address, payment_method, status, created_at""",
    {"flag": _FLAG, "lines": _LINES})

# ---------------- reviews ----------------

INTAKE_AS_OF = "2024-02-01 00:00:00"

SQL["review_list"] = build(
    "SELECT review_id, product_id, user_id, rating, title, content, created_at FROM s_reviews")

SQL["rating_summary"] = build(
    """SELECT p.product_id, CAST(coalesce(r.n, 0) AS BIGINT) AS review_count,
              CASE WHEN r.n > 0 THEN ((r.s * 20 + r.n) // (2 * r.n)) / 10.0 ELSE 0.0 END AS avg_rating
       FROM s_products p
            LEFT JOIN (SELECT product_id, sum(coalesce(rating, 0)) AS s, count(*) AS n
                       FROM s_reviews GROUP BY product_id) r ON p.product_id = r.product_id""")

_LATER = "(a_ts < s.ts OR (a_ts = s.ts AND a_req < s.request_id))"

_REVIEW_INTAKE = {
     "st": """SELECT r.request_id, r.ts, r.user_id, r.product_id, r.order_item_id,
                     CASE WHEN r.product_id IS NULL OR r.product_id = 0 OR r.rating IS NULL OR r.rating = 0
                               THEN 'invalid'
                          WHEN r.rating < 1 OR r.rating > 5 THEN 'bad_rating'
                          WHEN p.product_id IS NULL THEN 'not_found' END AS base,
                     (r.order_item_id IS NOT NULL AND r.order_item_id <> 0) AS is_item,
                     ((r.user_id IS NULL OR r.user_id IN (SELECT user_id FROM s_users))
                      AND (r.order_item_id IS NULL OR r.order_item_id = 0
                           OR r.order_item_id IN (SELECT order_item_id FROM s_items))) AS fk
              FROM s_review_requests r LEFT JOIN s_products p ON r.product_id = p.product_id""",
     "stored_items": "SELECT DISTINCT order_item_id FROM s_reviews WHERE order_item_id IS NOT NULL",
     "item_acc": """SELECT order_item_id, request_id AS a_req, ts AS a_ts
                    FROM (SELECT *, row_number() OVER (PARTITION BY order_item_id ORDER BY ts, request_id) AS rn
                          FROM st WHERE base IS NULL AND is_item AND fk)
                    WHERE rn = 1 AND order_item_id NOT IN (SELECT order_item_id FROM stored_items)""",
     "items": f"""SELECT s.request_id, s.user_id, s.product_id, s.ts,
                         CASE WHEN s.order_item_id IN (SELECT order_item_id FROM stored_items) THEN 'duplicate'
                              WHEN a.a_req IS NOT NULL AND {_LATER} THEN 'duplicate'
                              WHEN a.a_req = s.request_id THEN 'accepted'
                              ELSE 'unknown_reference' END AS st
                  FROM st s LEFT JOIN item_acc a ON s.order_item_id = a.order_item_id
                  WHERE s.base IS NULL AND s.is_item""",
     "gen_acc": """SELECT g.user_id, g.product_id, g.request_id AS a_req, g.ts AS a_ts
                   FROM (SELECT *, row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts, request_id) AS rn
                         FROM st WHERE base IS NULL AND NOT is_item AND fk AND user_id IS NOT NULL) g
                   WHERE g.rn = 1
                     AND NOT EXISTS (SELECT 1 FROM s_reviews r
                                     WHERE r.user_id = g.user_id AND r.product_id = g.product_id)
                     AND NOT EXISTS (SELECT 1 FROM items i
                                     WHERE i.st = 'accepted' AND i.user_id = g.user_id AND i.product_id = g.product_id
                                       AND (i.ts < g.ts OR (i.ts = g.ts AND i.request_id < g.request_id)))""",
     "gen": f"""SELECT s.request_id,
                       CASE WHEN s.user_id IS NULL THEN CASE WHEN s.fk THEN 'accepted' ELSE 'unknown_reference' END
                            WHEN EXISTS (SELECT 1 FROM s_reviews r
                                         WHERE r.user_id = s.user_id AND r.product_id = s.product_id) THEN 'duplicate'
                            WHEN EXISTS (SELECT 1 FROM items i
                                         WHERE i.st = 'accepted' AND i.user_id = s.user_id
                                           AND i.product_id = s.product_id
                                           AND (i.ts < s.ts OR (i.ts = s.ts AND i.request_id < s.request_id)))
                                 THEN 'duplicate'
                            WHEN a.a_req IS NOT NULL AND {_LATER} THEN 'duplicate'
                            WHEN a.a_req = s.request_id THEN 'accepted'
                            ELSE 'unknown_reference' END AS st
                FROM st s LEFT JOIN gen_acc a ON s.user_id = a.user_id AND s.product_id = a.product_id
                WHERE s.base IS NULL AND NOT s.is_item"""}

_REVIEW_STATUS = """SELECT s.request_id, coalesce(s.base, d.st) AS status
       FROM st s LEFT JOIN (SELECT request_id, st FROM items UNION ALL SELECT request_id, st FROM gen) d
            ON s.request_id = d.request_id"""

SQL["review_intake"] = build(_REVIEW_STATUS, _REVIEW_INTAKE)

SQL["reviews_after_intake"] = build(
    f"""SELECT review_id, user_id, product_id, order_item_id, rating, title, content, created_at FROM s_reviews
        UNION ALL
        SELECT r.request_id, r.user_id, r.product_id, nullif(r.order_item_id, 0), r.rating, nullif(r.title, ''), nullif(r.content, ''),
               DATE '{INTAKE_AS_OF[:10]}'
        FROM s_review_requests r JOIN ({_REVIEW_STATUS}) x USING (request_id) WHERE x.status = 'accepted'""", _REVIEW_INTAKE)

# ---------------- cart ----------------

_CART_LINES = """
    SELECT c.cart_id, c.user_id, c.quantity, c.created_at, p.product_id, p.name AS product_name,
           CAST(p.base_price AS DOUBLE) AS base_price, v.variant_id, v.color_name, v.image, v.discount_rate,
           o.option_id, o.size, o.stock_quantity
    FROM s_cart c JOIN s_options o ON c.option_id = o.option_id
         JOIN s_variants v ON o.variant_id = v.variant_id JOIN s_products p ON v.product_id = p.product_id"""

SQL["cart_lines"] = build(_CART_LINES)

SQL["cart_totals"] = build(
    """SELECT c.user_id, count(*) AS total_items,
              CAST(round(sum(p.base_price * (100 - coalesce(v.discount_rate, 0)) * c.quantity)
                         * CAST(0.01 AS DECIMAL(3,2)), 0) AS BIGINT) AS total_price
       FROM s_cart c JOIN s_options o ON c.option_id = o.option_id
            JOIN s_variants v ON o.variant_id = v.variant_id JOIN s_products p ON v.product_id = p.product_id
       GROUP BY c.user_id""")

_FOLD = {
    "opt": "SELECT option_id, coalesce(stock_quantity, 0) AS stock FROM s_options",
    "st0": """SELECT c.*, CASE
                WHEN op = 'add' AND (option_id IS NULL OR option_id = 0 OR quantity IS NULL OR quantity < 1)
                     THEN 'invalid'
                WHEN op = 'set' AND (cart_id IS NULL OR cart_id = 0 OR quantity IS NULL OR quantity < 1)
                     THEN 'invalid'
                WHEN op NOT IN ('add', 'set', 'remove') THEN 'invalid'
                WHEN op = 'add' AND option_id NOT IN (SELECT option_id FROM opt) THEN 'not_found' END AS pre
              FROM s_cart_changes c""",
    "newrows": """SELECT cart_id, user_id, option_id
                  FROM (SELECT user_id, option_id, cart_id,
                               row_number() OVER (PARTITION BY cart_id ORDER BY ts, request_id) AS rn
                        FROM st0 WHERE op = 'add' AND pre IS NULL) WHERE rn = 1""",
    "rows_": """SELECT cart_id, user_id, option_id FROM s_cart
               UNION ALL SELECT cart_id, user_id, option_id FROM newrows WHERE cart_id NOT IN (SELECT cart_id FROM s_cart)""",
    "keyed": """SELECT request_id, ts, op, quantity AS a, cart_id AS cid, user_id AS ku, option_id AS ko
                FROM st0 WHERE op = 'add' AND pre IS NULL
                UNION ALL
                SELECT s.request_id, s.ts, s.op, s.quantity, s.cart_id, r.user_id, r.option_id
                FROM st0 s JOIN rows_ r ON s.cart_id = r.cart_id AND s.user_id = r.user_id
                WHERE s.op IN ('set', 'remove') AND s.pre IS NULL""",
    "seq": """SELECT k.*, o.stock, row_number() OVER (PARTITION BY ku, ko ORDER BY ts, request_id) AS rn
              FROM keyed k JOIN opt o ON k.ko = o.option_id""",
    "fold(ku, ko, rn, q, id, created, updated, status, request_id)": """
        SELECT ku, ko, 0, coalesce(c.quantity, 0), c.cart_id, c.created_at, c.updated_at,
               CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)
        FROM (SELECT DISTINCT ku, ko FROM seq) k LEFT JOIN s_cart c ON c.user_id = ku AND c.option_id = ko
        UNION ALL
        SELECT s.ku, s.ko, s.rn,
               CASE WHEN s.op = 'add' AND f.q + s.a <= s.stock THEN f.q + s.a
                    WHEN s.op = 'set' AND f.q > 0 AND f.id = s.cid AND s.a <= s.stock THEN s.a
                    WHEN s.op = 'remove' AND f.q > 0 AND f.id = s.cid THEN 0 ELSE f.q END,
               CASE WHEN s.op = 'add' AND f.q = 0 AND s.a <= s.stock THEN s.cid ELSE f.id END,
               CASE WHEN s.op = 'remove' AND f.q > 0 AND f.id = s.cid THEN NULL
                    WHEN s.op = 'add' AND f.q = 0 AND s.a <= s.stock THEN s.ts ELSE f.created END,
               CASE WHEN (s.op = 'add' AND f.q + s.a <= s.stock)
                         OR (s.op = 'set' AND f.q > 0 AND f.id = s.cid AND s.a <= s.stock)
                    THEN s.ts ELSE f.updated END,
               CASE WHEN (s.op = 'add' AND f.q + s.a <= s.stock)
                         OR (s.op = 'set' AND f.q > 0 AND f.id = s.cid AND s.a <= s.stock)
                         OR (s.op = 'remove' AND f.q > 0 AND f.id = s.cid) THEN 'accepted'
                    WHEN s.op = 'add' THEN 'stock'
                    WHEN f.q = 0 OR f.id <> s.cid THEN 'not_found' ELSE 'stock' END,
               s.request_id
        FROM fold f JOIN seq s ON s.ku = f.ku AND s.ko = f.ko AND s.rn = f.rn + 1""",
}

SQL["cart_change_status"] = build(
    """SELECT s.request_id, coalesce(s.pre, f.status, 'not_found') AS status
       FROM st0 s LEFT JOIN fold f ON f.request_id = s.request_id AND f.rn > 0""", _FOLD, recursive=True)

SQL["cart_after_changes"] = build(
    """SELECT f.id AS cart_id, f.ku AS user_id, f.ko AS option_id, f.q AS quantity, f.created AS created_at,
              f.updated AS updated_at
       FROM fold f JOIN (SELECT ku, ko, max(rn) AS rn FROM fold GROUP BY ku, ko) l
            ON f.ku = l.ku AND f.ko = l.ko AND f.rn = l.rn
       WHERE f.q > 0
       UNION ALL
       SELECT cart_id, user_id, option_id, quantity, created_at, updated_at FROM s_cart c
       WHERE NOT EXISTS (SELECT 1 FROM seq WHERE ku = c.user_id AND ko = c.option_id)""", _FOLD, recursive=True)

# what is wrong with a body, and the id that can still be read of it
SQL["cart_change_bodies"] = build(
    """SELECT CASE WHEN request_id % 97 = 0 OR request_id % 89 = 0 THEN 'malformed' WHEN request_id % 83 = 0 THEN 'missing request_id'
                   WHEN request_id % 79 = 0 THEN 'empty' ELSE op END AS kind, count(*) AS n,
              CAST(sum(CASE WHEN request_id % 97 = 0 THEN 0 WHEN request_id % 89 = 0 THEN request_id
                            WHEN request_id % 83 = 0 OR request_id % 79 = 0 THEN 0 ELSE request_id END) AS BIGINT) AS ids
       FROM s_cart_changes GROUP BY 1""")

# ---------------- checkout ----------------

CHECKOUT_AS_OF = "1996-08-30 00:00:00"   # midnight of a one-day sale: P4 discounts apply

# Requests one after another: the recursion carries the rows bought and the stock taken so far.
_TAKEN = "coalesce(list_sum(list_transform(list_filter(f.taken, lambda y: y.option_id = x.option_id), lambda y: y.quantity)), 0)"
_CHECKOUT = {
    "named": f"""
        SELECT r.request_id, c.cart_id, c.user_id, c.option_id, o.variant_id, p.product_id,
               p.name AS product_name, v.color_name, o.size, c.quantity, coalesce(o.stock_quantity, 0) AS stock,
               CAST(floor(CAST(p.base_price AS DOUBLE) * (1 - (CASE
                   WHEN v.sale_start_date IS NOT NULL AND v.sale_end_date IS NOT NULL
                        AND TIMESTAMP '{CHECKOUT_AS_OF}' >= CAST(v.sale_start_date AS TIMESTAMP)
                        AND TIMESTAMP '{CHECKOUT_AS_OF}' <= CAST(v.sale_end_date AS TIMESTAMP)
                   THEN coalesce(v.discount_rate, 0) ELSE 0 END) / 100.0)) AS BIGINT) AS unit_price
        FROM s_checkout_requests r
             JOIN s_cart c ON c.user_id = r.user_id AND (r.cart_ids IS NULL OR list_contains(r.cart_ids, c.cart_id))
             JOIN s_options o ON c.option_id = o.option_id
             JOIN s_variants v ON o.variant_id = v.variant_id
             JOIN s_products p ON v.product_id = p.product_id
        WHERE r.shipping_address IS NOT NULL""",
    "queue": """
        SELECT request_id, row_number() OVER (ORDER BY request_id) AS rn, bool_or(user_id IN (SELECT user_id FROM s_users)) AS known,
               list(struct_pack(cart_id := cart_id, option_id := option_id, quantity := quantity, stock := stock)) AS ls
        FROM named GROUP BY request_id""",
    "served(rn, request_id, ls, paid, bought, taken)": f"""
        SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT),
               CAST([] AS STRUCT(cart_id BIGINT, stock BIGINT, short BOOLEAN)[]), false,
               CAST([] AS BIGINT[]), CAST([] AS STRUCT(option_id BIGINT, quantity BIGINT)[])
        UNION ALL
        SELECT rn, request_id, seen, paid, CASE WHEN paid THEN list_concat(bought, list_transform(seen, lambda x: x.cart_id)) ELSE bought END,
               CASE WHEN paid THEN list_concat(taken, list_transform(list_filter(ls, lambda x: NOT list_contains(bought, x.cart_id)),
                    lambda x: struct_pack(option_id := x.option_id, quantity := CAST(x.quantity AS BIGINT)))) ELSE taken END
        FROM (SELECT *, known AND len(seen) > 0 AND len(list_filter(seen, lambda x: x.short)) = 0 AS paid
              FROM (SELECT q.rn, q.request_id, q.known, q.ls, f.bought, f.taken,
                           list_transform(list_filter(q.ls, lambda x: NOT list_contains(f.bought, x.cart_id)),
                               lambda x: struct_pack(cart_id := x.cart_id, stock := CAST(x.stock - {_TAKEN} AS BIGINT),
                                                     short := x.stock - {_TAKEN} < x.quantity)) AS seen
                    FROM served f JOIN queue q ON q.rn = f.rn + 1))""",
    "lines": """SELECT n.request_id, n.cart_id, n.user_id, n.option_id, n.variant_id, n.product_id, n.product_name, n.color_name,
                       n.size, n.quantity, CAST(s.l.stock AS INTEGER) AS stock_quantity, n.unit_price,
                       n.unit_price * n.quantity AS line_total, s.l.short AS short
                FROM named n JOIN (SELECT request_id, unnest(ls) AS l FROM served WHERE rn > 0) s
                     ON n.request_id = s.request_id AND n.cart_id = s.l.cart_id""",
    "status": """
        SELECT r.request_id, r.user_id,
               CASE WHEN r.shipping_address IS NULL THEN 'invalid' WHEN l.n IS NULL THEN 'empty'
                    WHEN l.short_lines > 0 THEN 'insufficient_stock'
                    WHEN r.user_id NOT IN (SELECT user_id FROM s_users) THEN 'unknown_reference'
                    ELSE 'paid' END AS status,
               CAST(coalesce(l.n, 0) AS BIGINT) AS line_count,
               CAST(coalesce(l.short_lines, 0) AS BIGINT) AS short_lines,
               CAST(l.total AS BIGINT) AS total_amount
        FROM s_checkout_requests r
             LEFT JOIN (SELECT request_id, count(*) AS n, sum(CAST(short AS INTEGER)) AS short_lines,
                               sum(line_total) AS total
                        FROM lines GROUP BY request_id) l ON r.request_id = l.request_id""",
    "paid": """SELECT l.* FROM lines l JOIN status s ON l.request_id = s.request_id WHERE s.status = 'paid'""",
}

SQL["checkout_lines"] = build("SELECT * FROM lines", _CHECKOUT, recursive=True)
SQL["checkout_status"] = build("SELECT * FROM status", _CHECKOUT, recursive=True)
SQL["checkout_orders"] = build(
    """SELECT s.request_id AS order_id, s.user_id, CAST(s.total_amount AS DOUBLE) AS total_amount,
              r.shipping_address, r.payment_method, 'paid' AS status, s.line_count AS item_count
       FROM status s JOIN s_checkout_requests r ON s.request_id = r.request_id
       WHERE s.status = 'paid'""", _CHECKOUT, recursive=True)
SQL["stock_after"] = build(
    """SELECT o.option_id, o.variant_id, o.size,
              CAST(o.stock_quantity - coalesce(b.n, 0) AS INTEGER) AS stock_quantity
       FROM s_options o LEFT JOIN (SELECT option_id, sum(quantity) AS n FROM paid GROUP BY option_id) b
            ON o.option_id = b.option_id""", _CHECKOUT, recursive=True)
SQL["sold_after"] = build(
    """SELECT v.variant_id, CAST(v.sold_count + coalesce(b.n, 0) AS BIGINT) AS sold_count
       FROM s_variants v LEFT JOIN (SELECT variant_id, sum(quantity) AS n FROM paid GROUP BY variant_id) b
            ON v.variant_id = b.variant_id""", _CHECKOUT, recursive=True)
SQL["cart_after_checkout"] = build(
    """SELECT cart_id, user_id, option_id, quantity FROM s_cart
       WHERE cart_id NOT IN (SELECT cart_id FROM paid)""", _CHECKOUT, recursive=True)

SQL["checkout_items"] = build(
    """SELECT request_id AS order_id, option_id, quantity, CAST(unit_price AS DOUBLE) AS price FROM paid""", _CHECKOUT, recursive=True)

SQL["sales_summary_after_checkout"] = build(_SUMMARY, _CHECKOUT | {"names": _NAMES, "sold_items": f"""
        SELECT i.option_id, i.quantity, i.price, o.created_at FROM s_items i JOIN s_orders o USING (order_id)
        WHERE upper(o.status) IN ('PAID', 'SHIPPED', 'DELIVERED')
        UNION ALL SELECT option_id, quantity, CAST(unit_price AS DECIMAL(12,2)), TIMESTAMP '{CHECKOUT_AS_OF}' FROM paid""", "daily": f"""
        SELECT o.variant_id, strftime(i.created_at, '%Y-%m-%d') AS sales_date, sum(i.quantity) AS daily_qty, sum(i.quantity * i.price) AS daily_revenue
        FROM sold_items i JOIN s_options o USING (option_id)
        WHERE i.created_at >= TIMESTAMP '{SALES_START}' AND i.created_at < TIMESTAMP '{SALES_END_NEXT}'
        GROUP BY o.variant_id, strftime(i.created_at, '%Y-%m-%d')"""}, recursive=True)

# ---------------- loads ----------------

_LAST_CHANGE = {
    "last": """SELECT variant_id, size, stock
               FROM (SELECT *, row_number() OVER (PARTITION BY variant_id, lower(size)
                                                  ORDER BY l_shipdate DESC, l_orderkey DESC, l_extendedprice DESC,
                                                           l_quantity DESC) AS rn
                     FROM s_option_changes WHERE variant_id IN (SELECT variant_id FROM s_variants))
               WHERE rn = 1"""}

SQL["options_after_update"] = build(
    """SELECT o.option_id, o.variant_id, o.size,
              CASE WHEN l.variant_id IS NOT NULL THEN l.stock ELSE o.stock_quantity END AS stock_quantity,
              false AS is_new
       FROM s_options o LEFT JOIN last l ON o.variant_id = l.variant_id AND lower(o.size) = lower(l.size)
       UNION ALL
       SELECT NULL, l.variant_id, l.size, l.stock, true
       FROM last l
       WHERE NOT EXISTS (SELECT 1 FROM s_options o
                         WHERE o.variant_id = l.variant_id AND lower(o.size) = lower(l.size))""", _LAST_CHANGE)

SQL["variants_after_update"] = build(
    """SELECT v.variant_id, CASE WHEN d.variant_id IS NOT NULL THEN d.discount_rate ELSE v.discount_rate END AS discount_rate
       FROM s_variants v LEFT JOIN (
            SELECT variant_id, discount_rate FROM (
                SELECT *, row_number() OVER (PARTITION BY variant_id ORDER BY l_shipdate DESC, l_orderkey DESC, l_extendedprice DESC,
                                             l_quantity DESC, l_discount DESC) AS rn FROM s_discount_changes) WHERE rn = 1) d USING (variant_id)""")

_USER_INTAKE = {
    "ui": """SELECT r.*,
                    (r.email IS NULL OR r.email = '' OR r.name IS NULL OR r.name = '') AS invalid,
                    lower(r.email) IN (SELECT lower(email) FROM s_users) AS taken
             FROM s_user_requests r""",
    "ui_first": """SELECT lower(email) AS k, min(request_id) AS first FROM ui WHERE NOT invalid GROUP BY lower(email)""",
    "ui_status": """SELECT u.request_id, u.email, u.name, u.role,
                           CASE WHEN u.invalid THEN 'invalid' WHEN u.taken THEN 'duplicate'
                                WHEN u.request_id <> f.first THEN 'duplicate' ELSE 'accepted' END AS status
                    FROM ui u LEFT JOIN ui_first f ON lower(u.email) = f.k""",
}

SQL["user_intake"] = build("SELECT request_id, status FROM ui_status", _USER_INTAKE)
SQL["users_after_intake"] = build(
    """SELECT user_id, email, name, role FROM s_users
       UNION ALL
       SELECT request_id AS user_id, email, name, CASE WHEN role = 'admin' THEN 'ADMIN' ELSE 'USER' END AS role
       FROM ui_status WHERE status = 'accepted'""", _USER_INTAKE)

LOAD_AS_OF = "2024-03-01 12:00:00"
LOAD_DATE = "2024-03-01"

_FIRST_VARIANT = {
    "fv": """SELECT v.*, row_number() OVER (PARTITION BY v.product_id ORDER BY v.variant_id) AS rn
             FROM s_variants v"""}

SQL["load_status"] = build(
    """SELECT p.product_id,
              CASE WHEN EXISTS (SELECT 1 FROM s_variants v WHERE v.product_id = p.product_id)
                   THEN 'accepted' ELSE 'invalid' END AS status
       FROM s_products p""")

SQL["loaded_variants"] = build(
    f"""SELECT f.product_id, f.color_name, f.image AS representative_image_url, f.discount_rate,
               DATE '{LOAD_DATE}' AS registration_date
        FROM fv f WHERE f.rn = 1""", _FIRST_VARIANT)

SQL["loaded_options"] = build(
    """SELECT f.product_id, o.size, o.stock_quantity
       FROM fv f JOIN s_options o ON o.variant_id = f.variant_id WHERE f.rn = 1""", _FIRST_VARIANT)

_NEW_VARIANTS = f"""
    SELECT 1000000000000 + event_id AS request_id, {K} AS product_id,
           'Colour ' || CAST(event_id % 10 AS VARCHAR) AS color_name,
           CASE WHEN event_id % 4 = 0 THEN NULL ELSE '/images/new-' || CAST(event_id AS VARCHAR) || '.jpg' END
               AS image,
           CAST(event_id % 30 AS INTEGER) AS discount_rate,
           CAST(230 + 10 * (event_id % 7) AS VARCHAR) AS size, CAST(event_id % 5 AS INTEGER) AS stock
    FROM events WHERE event_type = 'purchase'"""

SQL["variants_added"] = build(
    f"""SELECT n.request_id AS variant_id, n.product_id, n.color_name, n.image AS representative_image_url,
               n.discount_rate, DATE '{LOAD_DATE}' AS registration_date
        FROM nv n WHERE n.product_id IN (SELECT product_id FROM s_products)""", {"nv": _NEW_VARIANTS})

SQL["variant_add_status"] = build(
    """SELECT request_id, CASE WHEN product_id IN (SELECT product_id FROM s_products) THEN 'accepted'
                              ELSE 'not_found' END AS status
       FROM nv""", {"nv": _NEW_VARIANTS})

SQL["options_added"] = build(
    """SELECT request_id AS variant_id, size, stock AS stock_quantity
       FROM nv WHERE product_id IN (SELECT product_id FROM s_products)""", {"nv": _NEW_VARIANTS})

SQL["variants_after_images"] = build(
    """SELECT v.variant_id, CASE WHEN l.variant_id IS NOT NULL THEN l.image ELSE v.image END
                                 AS representative_image_url
       FROM s_variants v LEFT JOIN (
            SELECT variant_id, image FROM (
                SELECT l_partkey * 1000000 + l_suppkey AS variant_id,
                       '/images/' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-'
                           || CAST(l_orderkey AS VARCHAR) || '.jpg' AS image,
                       row_number() OVER (PARTITION BY l_partkey, l_suppkey
                                          ORDER BY l_shipdate DESC, l_orderkey DESC) AS rn
                FROM lineitem WHERE l_returnflag = 'A') WHERE rn = 1) l
            ON v.variant_id = l.variant_id""")

SQL["cart_lines_after_batches"] = build(
    """SELECT c.cart_id, c.user_id, c.quantity, c.created_at, p.product_id, p.name AS product_name,
              CAST(p.base_price AS DOUBLE) AS base_price, v.variant_id, v.color_name,
              CASE WHEN i.variant_id IS NOT NULL THEN i.image ELSE v.image END AS image,
              coalesce(d.discount_rate, v.discount_rate) AS discount_rate, o.option_id, o.size, coalesce(k.stock, o.stock_quantity) AS stock_quantity
       FROM s_cart c JOIN s_options o ON c.option_id = o.option_id
            JOIN s_variants v ON o.variant_id = v.variant_id JOIN s_products p ON v.product_id = p.product_id
            LEFT JOIN discounts d ON d.variant_id = v.variant_id LEFT JOIN images i ON i.variant_id = v.variant_id
            LEFT JOIN stocks k ON k.variant_id = v.variant_id AND k.size = o.size""",
    {"requests": """
        SELECT ((CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) * 1000000000 + l_orderkey) * 100
                + CAST(l_quantity AS BIGINT)) * 100 + CAST(round(l_discount * 100) AS INTEGER) AS request_id,
               l_partkey * 1000000 + l_suppkey AS variant_id, CAST(round(l_discount * 100) AS INTEGER) AS discount_rate, l_linestatus = 'O' AS given,
               CAST(220 + 10 * l_linenumber + CASE WHEN l_linestatus = 'O' THEN 5 ELSE 0 END AS VARCHAR) AS size, CAST(l_quantity AS INTEGER) AS stock
        FROM lineitem WHERE l_returnflag = 'N'""",
     "stocks": "SELECT variant_id, size, arg_max(stock, request_id) AS stock FROM requests GROUP BY variant_id, size",
     "discounts": "SELECT variant_id, arg_max(discount_rate, request_id) AS discount_rate FROM requests WHERE given GROUP BY variant_id",
     "images": """
            SELECT variant_id, image FROM (
                SELECT l_partkey * 1000000 + l_suppkey AS variant_id,
                       '/images/' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '-'
                           || CAST(l_orderkey AS VARCHAR) || '.jpg' AS image,
                       row_number() OVER (PARTITION BY l_partkey, l_suppkey
                                          ORDER BY l_shipdate DESC, l_orderkey DESC) AS rn
                FROM lineitem WHERE l_returnflag = 'A') WHERE rn = 1"""})
