"""Per-subject model parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycoflow import values


def with_params(rows: DataFrame, params: DataFrame | None, names: list[str]) -> DataFrame:
    """Add parameter columns, the defaults where a subject has none.

    `params` has one row per subject: `subject_id`, any of the parameters, and
    optionally `circadian_adjustments` and `tz`.
    """
    if params is None:
        return rows.select(
            "*",
            *[F.lit(values.USER_DEFAULTS[n]).alias(n) for n in names if n in values.USER_DEFAULTS],
        )
    held = [n for n in names if n in params.columns]
    joined = rows.join(params.select("subject_id", *held), "subject_id", "left")
    for name in names:
        if name in values.USER_DEFAULTS:
            default = F.lit(values.USER_DEFAULTS[name])
            joined = joined.withColumn(
                name, F.coalesce(F.col(name), default) if name in held else default
            )
    return joined
