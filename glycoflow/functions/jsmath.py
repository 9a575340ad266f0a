"""Number rules of the data model: half-up rounding, falsy defaults, lenient parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half toward +infinity; Spark's round() goes away from zero and via decimals."""
    scale = float(10**digits)
    return F.floor(x * scale + F.lit(0.5)).cast("double") / F.lit(scale)


def falsy(x: Column) -> Column:
    """NULL, zero and NaN all count as missing."""
    return x.isNull() | (x == 0) | F.isnan(x)


def or_default(x: Column, default) -> Column:
    """`default` where a number is NULL, zero or NaN."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(falsy(x), other).otherwise(x)


def text_or_default(x: Column, default) -> Column:
    """`default` where a text is NULL or empty."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(x.isNull() | (x == ""), other).otherwise(x)


def parse_number(text: Column) -> Column:
    """The leading number of a text ("5.6abc" is 5.6), NULL if there is none."""
    return F.regexp_extract(text, _LEADING_NUMBER, 1).try_cast("double")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def once(x: Column, then) -> Column:
    """`then(x)` with x evaluated a single time, however often `then` mentions it."""
    return F.get(F.transform(F.array(x), then), 0)
