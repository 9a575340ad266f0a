"""Insulin decay: biexponential activity and remaining share, as column expressions.

The curves come in two parts, the two exponentials and what is made of them, so that a
plan working on many rows can compute the exponentials once per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions.jsmath import clamp


def constants(kind: str) -> dict[str, float]:
    """Numbers of an insulin type, see `constant`."""
    kinetics = values.INSULIN[kind]
    slow = kinetics["half_life"] * 1.4
    fast = kinetics["onset"] * 0.7
    at_peak = slow * fast * math.log(slow / fast) / (slow - fast)
    return {
        "slow": slow,
        "fast": fast,
        "peak": math.exp(-at_peak / slow) - math.exp(-at_peak / fast),
        "duration": kinetics["duration"],
    }


def constant(kind: Column, name: str) -> Column:
    """`slow`, `fast` (decay minutes), `peak` (height) or `duration` (minutes) of a type."""
    return F.when(kind == "basal", F.lit(constants("basal")[name])).otherwise(
        F.lit(constants("bolus")[name])
    )


def duration_minutes(kind: Column) -> Column:
    return constant(kind, "duration")


def level_of(slow_term: Column, fast_term: Column, peak: Column) -> Column:
    """Activity scaled to a peak of 1, from exp(-t/slow) and exp(-t/fast)."""
    return clamp((slow_term - fast_term) / peak, 0.0, 1.0)


def share_of(slow_term: Column, fast_term: Column, slow: Column, fast: Column) -> Column:
    """Share still to act, from the same two terms."""
    return clamp((slow * slow_term - fast * fast_term) / (slow - fast), 0.0, 1.0)


def _terms(minutes: Column, kind: Column) -> tuple[Column, Column]:
    return (
        F.exp(-minutes / constant(kind, "slow")),
        F.exp(-minutes / constant(kind, "fast")),
    )


def activity(minutes: Column, kind: Column) -> Column:
    slow_term, fast_term = _terms(minutes, kind)
    outside = (minutes < 0) | (minutes >= duration_minutes(kind))
    return F.when(outside, F.lit(0.0)).otherwise(
        level_of(slow_term, fast_term, constant(kind, "peak"))
    )


def on_board(minutes: Column, kind: Column) -> Column:
    slow_term, fast_term = _terms(minutes, kind)
    return (
        F.when(minutes < 0, F.lit(1.0))
        .when(minutes >= duration_minutes(kind), F.lit(0.0))
        .otherwise(
            share_of(slow_term, fast_term, constant(kind, "slow"), constant(kind, "fast"))
        )
    )


def rate_at_full_activity(kind: Column, units: Column) -> Column:
    """Units per hour while activity is 1."""
    return units / (duration_minutes(kind) / 60.0) * 2.0


def activity_rate(minutes: Column, kind: Column, units: Column) -> Column:
    """Units per hour currently acting."""
    return activity(minutes, kind) * rate_at_full_activity(kind, units)


def glucose_drop(iob: Column, correction_factor: Column) -> Column:
    return iob * correction_factor


def stacking_risk(iob: Column, dose: Column, correction_factor: Column) -> Column:
    drop = (iob + dose) * correction_factor
    return F.when(drop > 8, F.lit("high")).when(drop > 5, F.lit("medium")).otherwise(F.lit("low"))
