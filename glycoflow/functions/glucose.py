"""Glucose units, checks and display bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions.jsmath import half_up


def mgdl_to_mmol(x: Column, digits: int | None = None, factor: float = values.MGDL_PER_MMOL):
    out = x / F.lit(factor)
    return out if digits is None else half_up(out, digits)


def mmol_to_mgdl(x: Column, digits: int | None = 0, factor: float = values.MGDL_PER_MMOL):
    out = x * F.lit(factor)
    return out if digits is None else half_up(out, digits)


def normalised(value: Column, unit: Column) -> Column:
    """mmol/L, converting only mg/dL readings that cannot be mmol/L already."""
    return F.when((unit == "mg/dL") & (value > 35), mgdl_to_mmol(value)).otherwise(value)


def unit_suspect(value: Column, unit: Column) -> Column:
    """A reading labelled mg/dL whose size says mmol/L."""
    return F.coalesce((unit == "mg/dL") & (value <= 35), F.lit(False))


def band(x: Column, high: float, middle: float) -> Column:
    """`high`, `medium` or `low` confidence."""
    return (
        F.when(x >= high, F.lit("high")).when(x >= middle, F.lit("medium")).otherwise(F.lit("low"))
    )


def item_confidence_band(x: Column) -> Column:
    return band(x, 0.8, 0.5)


def reading_confidence_band(x: Column) -> Column:
    return band(x, 0.9, 0.7)


def point_confidence_band(x: Column) -> Column:
    return band(x, 0.8, 0.6)


def error_band(mape: Column) -> Column:
    return (
        F.when(mape <= 5, F.lit("good")).when(mape <= 15, F.lit("fair")).otherwise(F.lit("poor"))
    )


def in_target(value: Column, unit: Column) -> Column:
    return F.when(unit == "mg/dL", value.between(72.0, 180.0)).otherwise(value.between(4.0, 10.0))


def premeal_minutes(bsl: Column) -> Column:
    """Minutes to inject before eating; negative is after."""
    return (
        F.when(bsl.isNull(), F.lit(0))
        .when(bsl < 4, F.lit(-15))
        .when(bsl < 5, F.lit(0))
        .when(bsl < 7, F.lit(10))
        .when(bsl < 10, F.lit(15))
        .otherwise(F.lit(20))
    )


def premeal_reason(bsl: Column) -> Column:
    return (
        F.when(bsl.isNull(), F.lit("BSL_UNKNOWN"))
        .when(bsl < 4, F.lit("BSL_LOW_EAT_FIRST"))
        .when(bsl < 5, F.lit("BSL_LOW_SIDE"))
        .when(bsl < 7, F.lit("BSL_NORMAL"))
        .when(bsl < 10, F.lit("BSL_ELEVATED"))
        .otherwise(F.lit("BSL_HIGH"))
    )
