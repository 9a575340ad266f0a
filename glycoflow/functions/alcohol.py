"""Alcohol uptake, elimination and its effect on insulin sensitivity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions.jsmath import text_or_default

RAMP_MINUTES = 60.0


def _per_drink(kind: Column, field: str, scale: float = 1.0) -> Column:
    rule = None
    for name in ("beer", "wine", "spirit"):
        test, out = kind == name, F.lit(values.DRINKS[name][field] * scale)
        rule = F.when(test, out) if rule is None else rule.when(test, out)
    return rule.otherwise(F.lit(values.DRINKS["mixed"][field] * scale))


def drink_kind(kind: Column) -> Column:
    return text_or_default(kind, "mixed")


def grams(units: Column) -> Column:
    return units * values.GRAMS_PER_UNIT


def elimination_rate(weight_kg: Column) -> Column:
    """Grams per hour."""
    return F.lit(values.ELIMINATION_GRAMS_PER_HOUR) * F.pow(
        weight_kg / values.REFERENCE_WEIGHT_KG, F.lit(0.25)
    )


def minutes_to_sober(alcohol_grams: Column, weight_kg: Column) -> Column:
    return alcohol_grams / elimination_rate(weight_kg) * 60.0


def effect_minutes(kind: Column) -> Column:
    return _per_drink(kind, "effect_hours", 60.0)


def total_minutes(units: Column, kind: Column, weight_kg: Column) -> Column:
    """How long a drink counts: until sober or until the sensitivity effect ends."""
    return F.greatest(minutes_to_sober(grams(units), weight_kg), effect_minutes(kind))


def half_life_minutes(kind: Column) -> Column:
    return _per_drink(kind, "half_life")


def lowest_modifier(kind: Column) -> Column:
    return _per_drink(kind, "modifier")


def absorbed_of(minutes: Column, alcohol_grams: Column, half_life: Column) -> Column:
    return alcohol_grams * (F.lit(1.0) - F.exp(-minutes / half_life))


def in_system_of(minutes: Column, absorbed_grams: Column, grams_per_hour: Column) -> Column:
    """Absorbed less what a constant rate has eliminated since."""
    gone = F.least(absorbed_grams, grams_per_hour * (minutes / 60.0))
    return F.greatest(F.lit(0.0), absorbed_grams - gone)


def absorbed(minutes: Column, units: Column, kind: Column) -> Column:
    return absorbed_of(minutes, grams(units), half_life_minutes(kind))


def absorbing(minutes: Column, units: Column, kind: Column) -> Column:
    return F.greatest(F.lit(0.0), grams(units) - absorbed(minutes, units, kind))


def in_system(minutes: Column, units: Column, kind: Column, weight_kg: Column) -> Column:
    return in_system_of(minutes, absorbed(minutes, units, kind), elimination_rate(weight_kg))


def blood_level(system_grams: Column, weight_kg: Column) -> Column:
    """Grams per litre."""
    return F.greatest(
        F.lit(0.0), system_grams / (weight_kg * values.BODY_WATER_FACTOR) * 10.0
    )


def sensitivity_of(minutes: Column, lowest: Column, span: Column) -> Column:
    """Modifier falling from 1 in the first hour, then back to 1 when the effect ends."""
    loss = F.lit(1.0) - lowest
    ramp = F.lit(1.0) - loss * (minutes / RAMP_MINUTES)
    decay = lowest + loss * ((minutes - RAMP_MINUTES) / (span - RAMP_MINUTES))
    return (
        F.when(minutes >= span, F.lit(1.0)).when(minutes < RAMP_MINUTES, ramp).otherwise(decay)
    )


def sensitivity(minutes: Column, kind: Column) -> Column:
    return sensitivity_of(minutes, lowest_modifier(kind), effect_minutes(kind))


def hypo_risk_severity(units: Column) -> Column:
    return (
        F.when(units <= 2, F.lit("low")).when(units <= 4, F.lit("medium")).otherwise(F.lit("high"))
    )


def hypo_risk_start(drink_ts: Column) -> Column:
    return drink_ts + F.expr("INTERVAL 6 HOURS")


def hypo_risk_end(drink_ts: Column) -> Column:
    return drink_ts + F.expr("INTERVAL 12 HOURS")


def linear_percent_left(units: Column, event_ms: Column, as_of_ms: Column) -> Column:
    """Display share of a drink left at one unit per hour; 100 when there was none."""
    hours = (as_of_ms - event_ms).cast("double") / 3600000.0
    left = F.greatest(F.lit(0.0), units - hours) / units * 100.0
    return F.when(F.coalesce(units, F.lit(0.0)) > 0, F.floor(left + 0.5)).otherwise(F.lit(100))
