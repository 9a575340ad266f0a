"""Carbohydrate absorption, as column expressions.

`shape` is the one costly term; rate and remainder are simple arithmetic on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glycoflow.functions.jsmath import clamp


#: Share absorbed when the curve starts to fall.
AT_PEAK = 0.4


def peak_minutes(gi: Column) -> Column:
    return F.lit(120.0) - clamp(gi, 0.0, 100.0) / 100.0 * 90.0


def duration_minutes(gi: Column) -> Column:
    return F.lit(120.0) + (F.lit(100.0) - clamp(gi, 0.0, 100.0)) / 100.0 * 180.0


def half_life_minutes(gi: Column) -> Column:
    return duration_minutes(gi) / 3.0


def half_life_of(gi: float) -> float:
    """`half_life_minutes` of a known index."""
    return (120.0 + (100.0 - min(max(gi, 0.0), 100.0)) / 100.0 * 180.0) / 3.0


def shape(minutes: Column, peak: Column, half_life: Column) -> Column:
    """Rising power, then falling exponential. The curve jumps at its peak; that is intended."""
    return F.when(minutes < peak, F.pow(minutes / peak, peak / half_life)).otherwise(
        F.exp((peak - minutes) / half_life)
    )


def rate_of(shape_: Column, grams: Column, duration: Column) -> Column:
    """Grams per hour entering the blood, while inside the curve."""
    return F.greatest(F.lit(0.0), shape_ * (grams * 2.0 / (duration / 60.0)))


def absorbed_of(
    shape_: Column, minutes: Column, grams: Column, peak: Column, half_life: Column, duration: Column
) -> Column:
    """Grams absorbed so far, while inside the curve."""
    rising = grams * shape_ * minutes / ((peak / half_life + 1.0) * duration)
    falling = grams * AT_PEAK + (grams - grams * AT_PEAK) * (F.lit(1.0) - shape_)
    taken = F.when(minutes < peak, rising).otherwise(falling)
    return F.greatest(F.lit(0.0), F.least(grams, taken))


def absorption_rate(minutes: Column, grams: Column, gi: Column) -> Column:
    peak, duration, half = peak_minutes(gi), duration_minutes(gi), half_life_minutes(gi)
    outside = (minutes < 0) | (minutes >= duration)
    return F.when(outside, F.lit(0.0)).otherwise(
        rate_of(shape(minutes, peak, half), grams, duration)
    )


def absorbed(minutes: Column, grams: Column, gi: Column) -> Column:
    peak, duration, half = peak_minutes(gi), duration_minutes(gi), half_life_minutes(gi)
    inside = absorbed_of(shape(minutes, peak, half), minutes, grams, peak, half, duration)
    return (
        F.when(minutes < 0, F.lit(0.0)).when(minutes >= duration, grams).otherwise(inside)
    )


def on_board(minutes: Column, grams: Column, gi: Column) -> Column:
    """Grams still to be absorbed."""
    return F.greatest(F.lit(0.0), grams - absorbed(minutes, grams, gi))


def glucose_rise(cob: Column, insulin_to_carb_ratio: Column, correction_factor: Column) -> Column:
    return cob / insulin_to_carb_ratio * correction_factor
