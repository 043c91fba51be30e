"""Helpers that fix the shop's comparison, date and rounding rules.

Column helpers are built-in Spark expressions (JVM side, inside whole-stage
codegen); the date helpers on plain values turn a job's ``as_of`` parameter
into constants before any plan is built.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_literal(value, like: T.DataType | None = None) -> Column:
    """A timestamp constant of the same flavour (LTZ or NTZ) as a column type.

    The cast folds to a literal, so a comparison with it is still pushed to the scan.
    """
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.isoformat()
    target = like if isinstance(like, (T.TimestampType, T.TimestampNTZType)) else T.TimestampType()
    return F.lit(str(value)).cast(target)


def column_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def as_timestamp(c, like: T.DataType | None = None) -> Column:
    """A date column as the instant 00:00 of that day (how the shop compares dates, T10)."""
    target = like if isinstance(like, (T.TimestampType, T.TimestampNTZType)) else T.TimestampType()
    return col(c).cast(target)


def day_range(c, start, end, like: T.DataType | None = None) -> Column:
    """``start 00:00:00 <= c <= end 23:59:59`` written as ``[start, end + 1 day)`` (S3).

    Same rows on second-precision data; keeps a plain range the scan can push down.
    """
    lo = _dt.date.fromisoformat(str(start)[:10])
    hi = _dt.date.fromisoformat(str(end)[:10]) + _dt.timedelta(days=1)
    return (col(c) >= ts_literal(lo, like)) & (col(c) < ts_literal(hi, like))


def size_number(c) -> Column:
    """Leading digits of a size as a number, 0 when there are none (MySQL ``CAST AS UNSIGNED``, N5)."""
    return F.coalesce(F.regexp_extract(col(c), r"^[0-9]+", 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def one_month_back(as_of: _dt.datetime) -> _dt.datetime:
    """``as_of`` with the month set one back, overflowing like a JS Date (31 Mar -> 3 Mar, N7).

    ``as_of`` is a job parameter, so this is a constant; the time of day is kept.
    """
    y, m = (as_of.year, as_of.month - 1) if as_of.month > 1 else (as_of.year - 1, 12)
    return _dt.datetime(y, m, 1, as_of.hour, as_of.minute, as_of.second, as_of.microsecond) \
        + _dt.timedelta(days=as_of.day - 1)


def as_datetime(value) -> _dt.datetime:
    """Parse an ``as_of`` given as a datetime, a date or an ISO string."""
    if isinstance(value, _dt.datetime):
        return value
    if isinstance(value, _dt.date):
        return _dt.datetime(value.year, value.month, value.day)
    return _dt.datetime.fromisoformat(str(value))


def half_up_tenths(total: Column, n: Column) -> Column:
    """``total / n`` rounded half up to one decimal, in exact arithmetic (H4).

    floor((20 * total + n) / (2 * n)) / 10, with a decimal division so no float
    rounding can move a .x5 tie.
    """
    num = (total.cast("bigint") * 20 + n.cast("bigint")).cast("decimal(38,0)")
    den = (n.cast("bigint") * 2).cast("decimal(38,0)")
    return (F.floor(num / den) / F.lit(10.0)).cast("double")


def ci_key(c) -> Column:
    """Comparison key that ignores case, accents and trailing spaces (MySQL ``utf8mb4_general_ci``, N1)."""
    return F.collate(col(c), "UNICODE_CI_AI_RTRIM")


def blank_to_null(c) -> Column:
    """JavaScript ``x || null`` for strings: empty becomes null."""
    return F.when(col(c) == "", F.lit(None).cast("string")).otherwise(col(c))
