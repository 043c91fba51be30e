"""The shop's four discounted-price rules. They differ on purpose; do not merge.

``d`` is the variant's ``discount_rate`` in percent, null read as 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_timestamp, col, ts_literal

def _cent() -> Column:
    return F.lit(0.01).cast("decimal(3,2)")


def _d(discount) -> Column:
    return F.coalesce(col(discount), F.lit(0))


def price_rounded(base, discount) -> Column:
    """P1 (popular list): round(base * (1 - d/100)) in exact decimals, as bigint."""
    exact = col(base) * (100 - _d(discount)) * _cent()
    return F.round(exact, 0).cast("bigint")


def price_floored(base, discount) -> Column:
    """P2 (gender catalog): floor of the float base * (1 - d/100), as bigint."""
    return F.floor(col(base).cast("double") * (1 - _d(discount) / 100.0)).cast("bigint")


def cart_line_cents(base, discount, quantity) -> Column:
    """P3 summand (cart total): base * (100 - d) * qty, exact; sum first, then :func:`cart_total`."""
    return col(base) * (100 - _d(discount)) * col(quantity)


def cart_total(summed_line_cents: Column) -> Column:
    """P3 (cart total): the exact sum of line values rounded once, half up, as bigint."""
    return F.round(summed_line_cents * _cent(), 0).cast("bigint")


def sale_active(start, end, as_of, like=None) -> Column:
    """Both sale dates set and ``start 00:00 <= as_of <= end 00:00`` (T10: the end is an instant)."""
    now = ts_literal(as_of, like)
    return (col(start).isNotNull() & col(end).isNotNull()
            & (now >= as_timestamp(start, like)) & (now <= as_timestamp(end, like)))


def price_at_checkout(base, discount, start, end, as_of, like=None) -> Column:
    """P4 (checkout): floor(base * (1 - d'/100)) as a float, d' = d only while the sale runs."""
    d_eff = F.when(sale_active(start, end, as_of, like), _d(discount)).otherwise(F.lit(0))
    return F.floor(col(base).cast("double") * (1 - d_eff / 100.0)).cast("bigint")
