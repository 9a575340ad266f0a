"""Time-of-day insulin sensitivity and dawn effect."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from glycoflow import values


def _table(numbers: list[float]) -> Column:
    """An hourly table as one array literal, so that plans stay small."""
    return F.lit(np.array(numbers, dtype="float64"))


_STEPS = 12
_DRIFT_PER_HOUR = 1.5


def local_time(ts: Column, tz: str | Column | None) -> Column:
    """Wall clock of the subject; the grid itself stays in UTC."""
    return ts if tz is None else F.from_utc_timestamp(ts, tz)


def base_sensitivity(hour: Column, adjustments: Column | None = None) -> Column:
    base = F.get(_table(values.CIRCADIAN_BASE), hour)
    if adjustments is None:
        return base
    return base * F.coalesce(F.try_element_at(adjustments, hour), F.lit(1.0))


def dawn_effect(hour: Column) -> Column:
    return F.get(_table(values.DAWN_EFFECT), hour)


def combined(hour: Column, adjustments: Column | None = None) -> Column:
    return base_sensitivity(hour, adjustments) + dawn_effect(hour) * 0.1


def _between_hours(rule, hour: Column, minute: Column) -> Column:
    here, ahead = rule(hour), rule((hour + 1) % 24)
    return here + (ahead - here) * (minute / F.lit(60.0))


def interpolated(local_ts: Column, adjustments: Column | None = None) -> dict[str, Column]:
    """Factors at a wall-clock instant, linear between full hours; seconds are ignored."""
    hour, minute = F.hour(local_ts), F.minute(local_ts)
    return {
        "hour": hour,
        "insulin_sensitivity": _between_hours(
            lambda h: base_sensitivity(h, adjustments), hour, minute
        ),
        "dawn_effect": _between_hours(dawn_effect, hour, minute),
        "combined_factor": _between_hours(lambda h: combined(h, adjustments), hour, minute),
    }


def drift(start: str, end: str, tz: str | None = None) -> Column:
    """Glucose drift over [start, end): mean of 12 left-edge dawn samples x 1.5 per hour.

    Takes column names and is written as one SQL text: the twelve unrolled samples would
    otherwise be hundreds of calls from Python. `tz` is a SQL expression, as 'UTC' in quotes
    or the name of a column.
    """
    table = "array(" + ",".join(f"{n!r}D" for n in values.DAWN_EFFECT) + ")"
    first, span = f"unix_millis({start})", f"(unix_millis({end}) - unix_millis({start}))"

    def sample(step: int) -> str:
        at = f"CAST({first} + {step / _STEPS!r}D * {span} AS BIGINT)"
        if tz is None:
            minute = f"({at} div 60000) % 1440"
            hour, rest = f"CAST(({minute}) div 60 AS INT)", f"(({minute}) % 60)"
        else:
            wall = f"from_utc_timestamp(timestamp_millis({at}), {tz})"
            hour, rest = f"hour({wall})", f"minute({wall})"
        here, ahead = f"get({table}, {hour})", f"get({table}, ({hour} + 1) % 24)"
        return f"({here} + ({ahead} - {here}) * ({rest} / 60.0D)) / {float(_STEPS)}D"

    total = " + ".join(sample(step) for step in range(_STEPS))
    return F.expr(f"({total}) * {_DRIFT_PER_HOUR}D * ({span} / 3600000.0D)")


def dose_reason(dawn: Column, sensitivity: Column) -> Column:
    """Code for why a dose is shifted at this time of day."""
    return (
        F.when(dawn > 0.5, F.lit("DAWN"))
        .when(sensitivity < 0.95, F.lit("MORE_SENSITIVE"))
        .when(sensitivity > 1.05, F.lit("LESS_SENSITIVE"))
        .otherwise(F.lit("BASELINE"))
    )
