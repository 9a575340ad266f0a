"""Learning from history: carb-ratio tuning and overnight patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions.circadian import local_time
from glycoflow.functions.jsmath import half_up, or_default
from glycoflow.plans.params import with_params


#: Nothing a meal looks for is as far away as a block is long.
BLOCK_MS = 4 * 3_600_000
DOSE_NEAR_MS, MEASURED_FROM_MS, MEASURED_TO_MS = 30 * 60_000, 2 * 3_600_000, 4 * 3_600_000


def meal_outcomes(log: DataFrame) -> DataFrame:
    """Meals with the dose given around them and the glucose two to four hours later.

    Each "first match" is a search forward from one end of its interval, so no pairs of meals and doses are formed: the
    first dose after (meal - 30 min) either lies before (meal + 30 min) or there is none in between. Doses, readings
    and what meals ask for lie in one order, which one pass from late to early goes through; as intervals are
    shorter than a block, a block needs to know the first dose and the first reading of the next one only.
    """
    kind, ms = F.col("event_type"), F.unix_millis("ts")
    carbs = or_default(F.col("meta.carbs"), F.col("value"))
    hit = F.struct(ms.alias("ms"), "ts", "value")
    none = F.lit(None)
    asks = (kind == "meal") & (carbs >= 10)

    def row(pos: Column, rank: int, dose: Column, reading: Column) -> Column:
        return F.struct(
            pos.alias("pos"), F.lit(rank).alias("rank"), dose.alias("dose"), reading.alias("reading")
        )

    # Looking back from later rows, a dose at the very instant comes after its ask, a reading before.
    event = row(ms, 1, F.when(kind == "insulin", hit), F.when(kind == "bsl", hit))
    for_dose = row(ms - DOSE_NEAR_MS, 2, none, none)
    for_reading = row(ms + MEASURED_FROM_MS, 0, none, none)
    placed = (
        log.filter(kind.isin("meal", "insulin", "bsl") & F.col("ts").isNotNull())
        .select(
            "subject_id", "id", "ts", carbs.alias("carbs"),
            F.explode(
                F.when(kind != "meal", F.array(event)).when(asks, F.array(for_dose, for_reading))
            ).alias("r"),
        )
        .select("subject_id", "id", "ts", "carbs", "r.*")
        .withColumn("block", F.floor(F.col("pos") / F.lit(BLOCK_MS)))
    )
    place = F.struct("pos", "id")
    following = placed.filter("rank = 1").groupBy("subject_id", (F.col("block") - 1).alias("block")).agg(
        F.min_by("dose", F.when(F.col("dose").isNotNull(), place)).alias("next_dose"),
        F.min_by("reading", F.when(F.col("reading").isNotNull(), place)).alias("next_reading"),
    )
    later = (
        Window.partitionBy("subject_id", "block")
        .orderBy(F.desc("pos"), F.desc("rank"), F.desc("id"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        placed.select(
            "subject_id", "id", "ts", "carbs", "rank", "block",
            F.last("dose", ignorenulls=True).over(later).alias("dose"),
            F.last("reading", ignorenulls=True).over(later).alias("reading"),
        )
        .filter("rank <> 1")
        .join(following, ["subject_id", "block"], "left")
    )
    asked_dose, asked_reading = F.col("rank") == 2, F.col("rank") == 0
    meals = (
        found.groupBy("subject_id", "id", "ts", "carbs")
        .agg(
            F.max(F.when(asked_dose, F.coalesce("dose", "next_dose"))).alias("dose"),
            F.max(F.when(asked_reading, F.coalesce("reading", "next_reading"))).alias("reading"),
            F.count_if(asked_dose).cast("int").alias("n"),
        )
        .withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("n"))))
    )
    at = F.unix_millis("ts")
    bsl = F.col("after_bsl")
    return (
        meals.filter(
            (F.col("dose.ms") < at + DOSE_NEAR_MS)
            & (F.col("dose.value") >= 1)
            & (F.col("reading.ms") <= at + MEASURED_TO_MS)
        )
        .select(
            "subject_id", "id", "ts", "carbs",
            F.col("dose.ts").alias("dose_ts"), F.col("dose.value").alias("units"),
            F.col("reading.ts").alias("after_ts"), F.col("reading.value").alias("after_bsl"),
        )
        .withColumn(
            "outcome",
            F.when(bsl < 4.5, F.lit("low")).when(bsl > 9, F.lit("high")).otherwise(F.lit("good")),
        )
    )


def ratio_suggestions(
    log: DataFrame, subjects: DataFrame, params: DataFrame | None = None
) -> DataFrame:
    """A new carb ratio per subject from how its meals turned out."""
    counts = meal_outcomes(log).groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("data_points"),
        F.count_if(F.col("outcome") == "high").alias("n_high"),
        F.count_if(F.col("outcome") == "low").alias("n_low"),
        F.count_if(F.col("outcome") == "good").alias("n_good"),
    )
    known = with_params(
        subjects.join(counts, "subject_id", "left").fillna(0), params, ["insulin_to_carb_ratio"]
    )
    n, current = F.col("data_points"), F.col("insulin_to_carb_ratio")
    few = n < 5
    high, low = F.col("n_high") > n * 0.4, F.col("n_low") > n * 0.2
    suggested = (
        F.when(few, current)
        .when(high, half_up(current * 0.9, 1))
        .when(low, half_up(current * 1.15, 1))
        .otherwise(half_up(current, 1))
    )
    finding = (
        F.when(few, F.lit("INSUFFICIENT"))
        .when(high, F.lit("MOSTLY_HIGH"))
        .when(low, F.lit("MOSTLY_LOW"))
        .when(F.col("n_good") > n * 0.6, F.lit("WORKING"))
        .otherwise(F.lit("MIXED"))
    )
    confidence = F.when(few, F.lit(0.0)).otherwise(F.least(F.lit(0.9), n / 20))
    return known.select(
        "subject_id",
        "data_points",
        suggested.alias("suggested_ratio"),
        confidence.alias("confidence"),
        finding.alias("finding"),
    )


def overnight_patterns(readings: DataFrame, tz: str | None = None) -> DataFrame:
    """Dawn phenomenon per subject from overnight readings (subject_id, ts, value).

    Hour 3 belongs to both the early and the late part.
    """
    hour = F.hour(local_time(F.col("ts"), tz))

    def mean(low: int, high: int) -> Column:
        return F.avg(F.when(hour.between(low, high), F.col("value")))

    parts = readings.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n"), mean(0, 3).alias("before"), mean(3, 7).alias("dawn")
    )
    rise = F.col("dawn") - F.col("before")
    usable = (F.col("n") >= 3) & rise.isNotNull()
    detected = F.coalesce(usable & (rise > 1.5), F.lit(False))
    intensity = F.least(rise / 3.0, F.lit(1.0))
    table = F.map_from_arrays(
        F.array(*[F.lit(h) for h in values.OVERNIGHT_WEIGHTS]),
        F.array(*[intensity * w + 1.0 for w in values.OVERNIGHT_WEIGHTS.values()]),
    )
    return parts.select(
        "subject_id",
        "n",
        F.when(usable, rise).alias("rise"),
        detected.alias("dawn_detected"),
        F.when(detected, table).alias("suggested_adjustments"),
        F.when(F.col("n") < 3, F.lit("INSUFFICIENT"))
        .when(rise.isNull(), F.lit("NO_DATA_IN_WINDOW"))
        .when(detected, F.lit("DAWN"))
        .otherwise(F.lit("NONE"))
        .alias("finding"),
    )
