"""Lenient date parsing for glucose-monitor exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glycoflow.functions.jsmath import once

US_DATE = r"^(\d{2})-(\d{2})-(\d{4})\s+(\d{2}):(\d{2})$"
ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
SPACED = r"^(\d{4})-(\d{2})-(\d{2})\s+(\d{2}):(\d{2}):(\d{2})$"

# Samples of these mark a column as holding timestamps.
TIMESTAMP_HINTS = r"^\d{4}-\d{2}-\d{2}|^\d{2}-\d{2}-\d{4}|T\d{2}:\d{2}|\d{2}:\d{2}:\d{2}"


def _sane(ts: Column) -> Column:
    return once(ts, lambda t: F.when((F.year(t) >= 2000) & (F.year(t) <= 2100), t))


def date_format(text: Column) -> Column:
    return (
        F.when(F.rlike(text, F.lit(ISO_PREFIX)), F.lit("ISO"))
        .when(F.rlike(text, F.lit(SPACED)), F.lit("DEXCOM"))
        .when(F.rlike(text, F.lit(US_DATE)), F.lit("LIBRE_US"))
    )


def parse_iso(text: Column) -> Column:
    """ISO instants, with or without a zone, between 2000 and 2100."""
    return _sane(F.try_to_timestamp(text))


def parse_spaced(text: Column) -> Column:
    """`YYYY-MM-DD HH:mm:ss`; only the first blank becomes the T."""
    return parse_iso(F.regexp_replace(text, r"^([^ ]*) ", "$1T"))


def parse_libre(text: Column, us_format: bool = True) -> Column:
    """`MM-DD-YYYY HH:mm` (or day first); parts that overflow roll over, as in month 15."""

    month_at, day_at = (0, 1) if us_format else (1, 0)

    def build(parts: Column) -> Column:
        def number(at: int) -> Column:
            return parts.getItem(at).cast("int")

        first = F.make_date(number(2), F.lit(1), F.lit(1))
        month = F.add_months(first, number(month_at) - 1).cast("timestamp")
        seconds = F.lit(0).cast("decimal(18,6)")
        return month + F.make_dt_interval(number(day_at) - 1, number(3), number(4), seconds)

    parts = F.split(text, r"[-:]|\s+")
    rolled = once(parts, build)
    return F.when(F.rlike(text, F.lit(US_DATE)), _sane(rolled))


def parse_any(text: Column, us_format: bool = True) -> Column:
    """ISO, then spaced, then month-first, then whatever else Spark reads as a timestamp."""
    trimmed = F.trim(text)
    return (
        F.when(F.rlike(trimmed, F.lit(ISO_PREFIX)), parse_iso(trimmed))
        .when(F.rlike(trimmed, F.lit(SPACED)), parse_spaced(trimmed))
        .when(F.rlike(trimmed, F.lit(US_DATE)), parse_libre(trimmed, us_format))
        .otherwise(F.try_to_timestamp(trimmed))
    )


def display(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def iso_millis(ts: Column) -> Column:
    """`YYYY-MM-DDTHH:mm:ss.SSSZ`; needs the session zone to be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
