import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cobbler.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from cobbler.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


D = Decimal
ts = dt.datetime
day = dt.date


def make_shop(spark, **over):
    """A small shop shaped like the reference dump (made-up names), overridable per table."""
    products = [
        (1, "wool runner", D("159000.00"), "MEN", 1, None),
        (2, "wool runner mizzle", D("179000.00"), "MEN", 1, "BEST"),
        (3, "tree lounger", D("139000.00"), "MEN", 2, "LIFESTYLE SLIP"),
        (4, "tree dasher", D("1000.00"), "WOMEN", None, "slip"),
        (5, "no variants", D("99000.00"), "MEN", 3, None),
        (6, "unisex skipper", D("129000.00"), "UNISEX", 2, "NEW"),
    ]
    variants = [
        (101, 1, "black", "#212121", "img/101.jpg", 0, None, None, day(2024, 1, 15), 1520),
        (102, 1, "grey", None, None, None, None, None, day(2024, 1, 15), None),
        (103, 1, "white", None, "img/103.jpg", 10, day(2024, 12, 1), day(2025, 2, 28), day(2024, 1, 15), 1200),
        (201, 2, "navy", None, "img/201.jpg", 15, day(2024, 12, 1), day(2025, 1, 31), day(2025, 1, 10), 950),
        (301, 3, "sand", None, "img/301.jpg", 20, day(2025, 1, 1), day(2025, 3, 31), day(2025, 3, 5), 1001),
        (401, 4, "red", None, "img/401.jpg", 7, day(2025, 1, 1), day(2025, 3, 31), day(2025, 2, 1), 10),
        (601, 6, "teal", None, None, None, None, None, day(2025, 3, 1), 0),
    ]
    options = [
        (1, 101, "250", 10), (2, 101, "255", 0), (3, 101, "260", 3),
        (4, 102, "270", 5), (5, 102, "L", 2), (6, 102, "265", 1),
        (7, 103, "250", 4),
        (8, 201, "280", 9), (9, 201, "280", 1),
        (10, 301, "250", 5), (11, 401, "240", 2),
    ]
    materials = [(1, "WOOL", "merino wool"), (2, "TREE", "eucalyptus"), (3, "SUGAR", "sugarcane")]
    cart = [
        (11, 1, 1, 2, ts(2025, 3, 1, 10), ts(2025, 3, 1, 10)),
        (12, 1, 7, 1, ts(2025, 3, 2, 10), ts(2025, 3, 2, 10)),
        (13, 2, 3, 5, ts(2025, 3, 3, 10), ts(2025, 3, 3, 10)),
        (14, 2, 10, 1, ts(2025, 3, 4, 10), ts(2025, 3, 4, 10)),
        (15, 3, 11, 1, ts(2025, 3, 5, 10), ts(2025, 3, 5, 10)),
    ]
    orders = [
        (1000, 1, D("159000.00"), "addr 1", "card", "PAID", ts(2025, 3, 1, 9)),
        (1001, 1, D("270000.00"), "addr 1", "card", "delivered", ts(2025, 3, 2, 23, 59, 59)),
        (1002, 2, D("5000.00"), "addr 2", "card", "pending", ts(2025, 3, 2, 12)),
        (1003, 2, D("1000.00"), "addr 2", "card", "Shipped", ts(2025, 3, 3, 0, 0, 0)),
        (1004, 3, D("1000.00"), "addr 3", "card", "paid", ts(2025, 3, 4, 0, 0, 0)),
    ]
    items = [
        (5000, 1000, 1, 1, D("159000.00"), None),
        (5001, 1001, 7, 2, D("135000.00"), None),
        (5002, 1002, 3, 1, D("5000.00"), None),
        (5003, 1003, 3, 1, D("1000.00"), None),
        (5004, 1004, 10, 1, D("1000.00"), None),
        (5005, 1001, 1, 1, D("0.50"), None),
    ]
    reviews = [
        (1, 1, 1, None, 5, "great", "comfy", day(2024, 11, 20)),
        (2, 2, 1, None, 4, "light", None, day(2024, 11, 15)),
        (3, 1, 2, 5001, None, "rain", "ok", day(2024, 11, 18)),
        (4, 3, 2, 5001, 5, "again", "two reviews of one item", day(2024, 11, 19)),
        (5, 2, 3, None, 4, None, None, day(2024, 12, 1)),
        (6, 3, 3, None, 5, None, None, day(2024, 12, 1)),
        (7, None, 3, None, 4, None, None, day(2024, 12, 2)),
    ]
    users = [(1, "Ann@Shop.test", "ann", "USER"), (2, "bob@shop.test", "bob", "ADMIN"),
             (3, "cy@shop.test", "cy", "USER")]
    data = dict(products=products, product_variants=variants, product_options=options, materials=materials,
                cart=cart, orders=orders, order_items=items, reviews=reviews, users=users)
    data.update(over)
    return {k: spark.createDataFrame(v, schemas.TABLES[k]) for k, v in data.items()}
