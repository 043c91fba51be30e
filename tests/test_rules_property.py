"""Property tests of the numeric and date rules against plain-Python models."""

import calendar
import datetime as dt
import math
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cobbler.functions import columns as C
from cobbler.functions import pricing as P


def js_month_back(d: dt.datetime) -> dt.datetime:
    """Date.setMonth(getMonth() - 1): keep the day number, let it overflow into the next month."""
    y, m = (d.year, d.month - 1) if d.month > 1 else (d.year - 1, 12)
    last = calendar.monthrange(y, m)[1]
    base = dt.datetime(y, m, min(d.day, last), d.hour, d.minute, d.second)
    return base + dt.timedelta(days=max(0, d.day - last))


@given(st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2100, 12, 31)))
def test_month_back_matches_js_model(d):
    d = d.replace(microsecond=0)
    assert C.one_month_back(d) == js_month_back(d)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 500), st.integers(1, 400)), min_size=200, max_size=200))
def test_half_up_tenths_matches_decimal(spark, pairs):
    df = spark.createDataFrame(pairs, "s long, n long")
    got = [r.v for r in df.select(C.half_up_tenths(F.col("s"), F.col("n")).alias("v")).collect()]
    want = [float((Decimal(s) / Decimal(n)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP)) for s, n in pairs]
    assert got == want


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 200_000_00), st.integers(0, 99)), min_size=300, max_size=300))
def test_float_floor_price_matches_js_arithmetic(spark, pairs):
    rows = [(Decimal(c) / 100, d) for c, d in pairs]
    df = spark.createDataFrame(rows, "base decimal(10,2), d int")
    got = [r.p for r in df.select(P.price_floored("base", "d").alias("p")).collect()]
    want = [math.floor(float(b) * (1 - d / 100)) for b, d in rows]       # what the reference computes
    assert got == want
    exact = [r.p for r in df.select(P.price_rounded("base", "d").alias("p")).collect()]
    assert exact == [int((b * (100 - d) / 100).quantize(Decimal(1), rounding=ROUND_HALF_UP)) for b, d in rows]
