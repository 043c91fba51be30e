"""C1-C8 on the small shop."""

import datetime as dt

from cobbler.operators import catalog
from conftest import make_shop


def test_product_page_first_n_by_id(spark):
    rows = catalog.product_page(make_shop(spark), n=3).collect()
    assert [r.product_id for r in rows] == [1, 2, 3]


def test_in_stock_sizes_string_order_and_positive_stock(spark):
    got = {r.variant_id: r.sizes for r in catalog.in_stock_sizes(make_shop(spark)).collect()}
    assert got[101] == ["250", "260"]                    # 255 has stock 0
    assert got[102] == ["265", "270", "L"]               # string order
    assert 601 not in got


def test_popular_variants_newest_first_with_rank_and_empty_sizes(spark):
    rows = catalog.popular_variants(make_shop(spark), n=3).collect()
    assert [r.id for r in rows] == [301, 601, 401]
    assert [r.rank for r in rows] == [1, 2, 3]
    r = {x.id: x for x in rows}
    assert r[601].sizes == []                            # no options -> [] not null
    assert r[301].price == 111200                        # P1: round(139000 * 0.8)
    assert r[401].price == 930                           # P1 exact, P2 would give 929


def test_gender_catalog_main_variant_tags_and_images(spark):
    t = make_shop(spark)
    rows = {r.product_id: r for r in catalog.gender_catalog(t, dt.datetime(2025, 3, 31, 10), "MEN").collect()}
    assert set(rows) == {1, 2, 3}                        # product 5 has no variants; 4 and 6 not MEN
    p1 = rows[1]
    assert p1.id == 101 and p1.images == ["img/101.jpg", None, "img/103.jpg"]   # nulls kept
    assert p1.discount is None and p1.price == 159000 and p1.sold_count == 1520 and p1.is_recommended
    assert p1.sizes == ["250", "260"] and p1.material == "merino wool"
    # 2025-03-31 minus one month overflows to 2025-03-03 10:00: registered 2025-03-05 is new
    assert rows[3].categories == ["new", "lifestyle", "slipon"]   # sale ended 00:00 of its last day (T10)
    assert rows[2].categories == []                      # sale ended 2025-01-31
    assert rows[3].price == 111200 and rows[3].is_recommended   # sold 1001 > 1000
    women = catalog.gender_catalog(t, dt.datetime(2025, 3, 31, 0, 0), "WOMEN").collect()
    assert women[0].categories == ["sale"]               # 'slip' badge is lower case: tags are case-sensitive
    assert women[0].price == 929                         # P2 float floor


def test_gender_catalog_sale_last_day_is_midnight(spark):
    t = make_shop(spark)
    on = {r.product_id: r for r in catalog.gender_catalog(t, dt.datetime(2025, 3, 31, 0, 0)).collect()}
    late = {r.product_id: r for r in catalog.gender_catalog(t, dt.datetime(2025, 3, 31, 0, 0, 1)).collect()}
    assert "sale" in on[3].categories and "sale" not in late[3].categories


def test_admin_catalog_nesting_and_nulls(spark):
    rows = {r.group_id: r for r in catalog.admin_catalog(make_shop(spark)).collect()}
    assert rows[5].variants is None                      # product without variants kept, null
    v = {x.variant_id: x for x in rows[1].variants}
    assert [x.variant_id for x in rows[1].variants] == [101, 102, 103]
    assert [(o.size, o.stock) for o in v[102].options] == [(0, 2), (265, 1), (270, 5)]  # numeric size
    six = {x.variant_id: x for x in rows[6].variants}
    assert six[601].options is None


def test_table_and_color_size_counts(spark):
    t = make_shop(spark)
    counts = {r.table_name: r.row_count for r in catalog.table_counts(t).collect()}
    assert counts == {"products": 6, "product_variants": 7, "product_options": 11, "reviews": 7}
    c = {r.product_id: (r.color_count, r.size_count) for r in catalog.color_size_counts(t).collect()}
    assert c[1] == (3, 7) and c[5] == (0, 0) and c[6] == (1, 0)


def test_variant_images_sorted(spark):
    rows = catalog.variant_images(make_shop(spark)).collect()
    assert [r.variant_id for r in rows] == [101, 102, 103, 201, 301, 401, 601]
