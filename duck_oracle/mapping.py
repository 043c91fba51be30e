"""The FIXTURES.md §3 mapping as DuckDB CTEs over the driver's raw views.

Shop views carry an ``s_`` prefix so they never shadow the raw tables
(``orders`` is both a raw table and a shop table).
"""

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

CTES = {
    "s_products": """
        SELECT p_partkey AS product_id, p_name AS name,
               CAST(p_retailprice AS DECIMAL(10,2)) AS base_price,
               CASE p_size % 3 WHEN 0 THEN 'MEN' WHEN 1 THEN 'WOMEN' ELSE 'UNISEX' END AS gender,
               CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_type END AS material,
               p_brand AS badge
        FROM part""",
    "s_optstats": """
        SELECT l_partkey, l_suppkey, l_linenumber, sum(l_quantity) AS qty,
               max(l_discount) AS max_disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
        FROM lineitem GROUP BY l_partkey, l_suppkey, l_linenumber""",
    "s_options": """
        SELECT (l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber AS option_id,
               l_partkey * 1000000 + l_suppkey AS variant_id,
               CAST(220 + 10 * l_linenumber AS VARCHAR) AS size,
               CAST(CAST(qty AS BIGINT) % 7 AS INTEGER) AS stock_quantity
        FROM s_optstats""",
    "s_variants": """
        SELECT l_partkey * 1000000 + l_suppkey AS variant_id, l_partkey AS product_id,
               'Supplier ' || CAST(l_suppkey AS VARCHAR) AS color_name,
               CASE WHEN l_suppkey % 7 = 0 THEN NULL
                    ELSE '/images/' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) || '.jpg'
               END AS image,
               NULLIF(CAST(round(max(max_disc) * 100) AS INTEGER), 0) AS discount_rate,
               CAST(min(first_ship) AS DATE) AS sale_start_date,
               CAST(max(last_ship) AS DATE) AS sale_end_date,
               CAST(min(first_ship) AS DATE) AS registration_date,
               CAST(sum(qty) AS BIGINT) AS sold_count
        FROM s_optstats GROUP BY l_partkey, l_suppkey""",
    "s_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS user_id,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
               'Address ' || CAST(o_custkey AS VARCHAR) AS shipping_address,
               o_orderpriority AS payment_method,
               CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'paid' WHEN 'P' THEN 'pending' END AS status,
               o_orderdate AS created_at
        FROM orders""",
    "s_items": """
        SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS order_item_id,
               l_orderkey AS order_id,
               (l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber AS option_id,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
               l_shipdate AS created_at, l_returnflag, l_partkey
        FROM lineitem""",
    "s_reviews": f"""
        SELECT event_id AS review_id, user_id, {K} AS product_id,
               CAST(NULL AS BIGINT) AS order_item_id, CAST(1 + event_id % 5 AS INTEGER) AS rating,
               CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS content,
               CAST(ts AS DATE) AS created_at
        FROM events WHERE event_type = 'view'
        UNION ALL
        SELECT -order_item_id, CAST(NULL AS BIGINT), l_partkey, order_item_id,
               CAST(1 + order_item_id % 5 AS INTEGER), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR),
               CAST(created_at AS DATE)
        FROM s_items WHERE l_returnflag = 'R'""",
    "s_first_option": """
        SELECT v.product_id, min(o.option_id) AS option_id
        FROM s_options o JOIN s_variants v ON o.variant_id = v.variant_id GROUP BY v.product_id""",
    "s_cart": f"""
        SELECT c.user_id * 1000 + c.k AS cart_id, c.user_id, f.option_id, c.quantity,
               c.created_at, c.updated_at
        FROM (SELECT user_id, {K} AS k, CAST(sum(1 + event_id % 3) AS INTEGER) AS quantity,
                     min(ts) AS created_at, max(ts) AS updated_at
              FROM events WHERE event_type = 'click' GROUP BY ALL) c
        JOIN s_first_option f ON c.k = f.product_id""",
    "s_cart_changes": f"""
        SELECT e.event_id AS request_id, e.ts, e.user_id,
               CASE e.event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'set' ELSE 'remove' END AS op,
               CASE WHEN e.event_type = 'click' THEN f.option_id END AS option_id,
               e.user_id * 1000 + e.k AS cart_id,
               CASE WHEN e.event_type <> 'error' THEN CAST(1 + e.event_id % 3 AS INTEGER) END AS quantity
        FROM (SELECT *, {K} AS k FROM events WHERE event_type IN ('click', 'view', 'error')) e
        LEFT JOIN s_first_option f ON e.k = f.product_id""",
    "s_checkout_requests": f"""
        SELECT 1000000000000 + event_id AS request_id, user_id,
               CASE WHEN event_id % 40 <> 1 THEN 'Address ' || CAST(user_id AS VARCHAR) END AS shipping_address,
               'card' AS payment_method,
               CASE WHEN event_id % 4 <> 0 THEN [user_id * 1000 + {K}, user_id * 1000 + {K} + 1] END AS cart_ids
        FROM events WHERE event_type = 'purchase'""",
    "s_option_changes": """
        SELECT l_partkey * 1000000 + l_suppkey AS variant_id,
               CAST(220 + 10 * l_linenumber + CASE WHEN l_linestatus = 'O' THEN 5 ELSE 0 END AS VARCHAR) AS size,
               CAST(l_quantity AS INTEGER) AS stock, l_shipdate, l_orderkey, l_extendedprice, l_quantity
        FROM lineitem WHERE l_returnflag = 'N'""",
    "s_item_requests": """
        SELECT 2000000000000 + i.order_item_id AS request_id, i.created_at AS ts, o.user_id, i.l_partkey AS product_id,
               i.order_item_id + CASE WHEN i.order_item_id % 1000 = 5 THEN 500 ELSE 0 END AS order_item_id,
               CAST(1 + i.order_item_id % 6 AS INTEGER) AS rating, 'Item ' || CAST(i.order_item_id AS VARCHAR) AS title,
               CASE WHEN i.order_item_id % 5 <> 0 THEN 'as bought' END AS content
        FROM s_items i LEFT JOIN s_orders o USING (order_id)""",
    "s_review_requests": f"""
        SELECT event_id AS request_id, ts, user_id, {K} AS product_id,
               CAST(NULL AS BIGINT) AS order_item_id, CAST(1 + event_id % 6 AS INTEGER) AS rating,
               CASE WHEN event_id % 7 <> 0 THEN 'Review ' || CAST(event_id AS VARCHAR) END AS title,
               CASE WHEN event_id % 5 = 0 THEN '' ELSE 'as said' END AS content
        FROM events WHERE event_type = 'signup'
        UNION ALL SELECT * FROM s_item_requests
        UNION ALL
        SELECT request_id + 1000000000000, ts + INTERVAL 1 DAY, user_id, product_id, order_item_id, rating, title, content
        FROM s_item_requests WHERE order_item_id % 1000 = 1""",
    "s_discount_changes": """
        SELECT l_partkey * 1000000 + l_suppkey AS variant_id, CAST(round(l_discount * 100) AS INTEGER) AS discount_rate,
               l_shipdate, l_orderkey, l_extendedprice, l_quantity, l_discount
        FROM lineitem WHERE l_returnflag = 'R'""",
    "s_users": """
        SELECT c_custkey AS user_id, 'customer' || CAST(c_custkey AS VARCHAR) || '@shop.test' AS email,
               c_name AS name, 'USER' AS role
        FROM customer""",
    "s_user_requests": """
        SELECT 1000000000000 + c_custkey AS request_id,
               CASE WHEN c_custkey >= 1000 THEN upper('user' || CAST(c_custkey % 1000 AS VARCHAR))
                    ELSE 'user' || CAST(c_custkey % 1000 AS VARCHAR) END AS email,
               c_name AS name,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role
        FROM customer""",
}


def build(select: str, extra: dict[str, str] | None = None, recursive: bool = False) -> str:
    """``WITH <mapping>, <extra CTEs> <select>``; DuckDB skips CTEs the select never reads."""
    ctes = {**CTES, **(extra or {})}
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + "\n" + select
