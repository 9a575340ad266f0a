"""The model's parameters as tables, for joins and for looking them up; all have a fixed number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions import alcohol
from glycoflow.functions.jsmath import text_or_default


def insulin_kinetics(spark: SparkSession) -> DataFrame:
    """insulin_type, onset_minutes, peak_minutes, duration_minutes and half_life_minutes."""
    rows = [(k, v["onset"], v["peak"], v["duration"], v["half_life"]) for k, v in values.INSULIN.items()]
    return spark.createDataFrame(
        rows,
        "insulin_type string, onset_minutes double, peak_minutes double, duration_minutes double, half_life_minutes double",
    )


def drink_kinetics(spark: SparkSession) -> DataFrame:
    """drink_type, absorption_half_life, lowest_modifier and effect_hours."""
    rows = [(k, v["half_life"], v["modifier"], v["effect_hours"]) for k, v in values.DRINKS.items()]
    return spark.createDataFrame(
        rows, "drink_type string, absorption_half_life double, lowest_modifier double, effect_hours double"
    )


def circadian_hours(spark: SparkSession) -> DataFrame:
    """hour, base_factor, dawn_effect and overnight_weight (0 outside the night)."""
    rows = [
        (h, base, dawn, float(values.OVERNIGHT_WEIGHTS.get(h, 0.0)))
        for h, (base, dawn) in enumerate(zip(values.CIRCADIAN_BASE, values.DAWN_EFFECT, strict=True))
    ]
    return spark.createDataFrame(rows, "hour int, base_factor double, dawn_effect double, overnight_weight double")


def user_defaults(spark: SparkSession) -> DataFrame:
    """One row with the parameters of a subject that has none of its own."""
    return spark.createDataFrame([tuple(values.USER_DEFAULTS.values())], ", ".join(f"{n} double" for n in values.USER_DEFAULTS))


def with_dimensions(log: DataFrame) -> DataFrame:
    """Events with the parameters that apply to them.

    Insulin has its kinetics (an unknown type those of bolus), drinks have theirs (an unknown type those of mixed), and
    all events have the factors of their hour. The tables have a few fixed rows, so each join is a lookup.
    """
    spark = log.sparkSession
    meta = F.col("meta")
    kind = text_or_default(meta.getField("type"), "bolus")
    drink = alcohol.drink_kind(meta.getField("alcohol_type"))
    keyed = log.select(
        "*",
        F.when(F.col("event_type") == "insulin", F.when(kind.isin(*values.INSULIN), kind).otherwise("bolus")).alias("insulin_type"),
        F.when(
            (F.col("event_type") == "meal") & (meta.getField("alcohol_units") > 0),
            F.when(drink.isin(*values.DRINKS), drink).otherwise("mixed"),
        ).alias("drink_type"),
        F.hour("ts").alias("hour"),
    )
    return (
        keyed.join(F.broadcast(insulin_kinetics(spark)), "insulin_type", "left")
        .join(F.broadcast(drink_kinetics(spark)), "drink_type", "left")
        .join(F.broadcast(circadian_hours(spark)), "hour", "left")
    )
