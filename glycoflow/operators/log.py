"""Queries over the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions import glucose, macros
from glycoflow.functions.circadian import local_time
from glycoflow.functions.jsmath import half_up


def between(log: DataFrame, start, end) -> DataFrame:
    """Events in [start, end], both ends included, oldest first.

    The bounds stay plain comparisons on `ts` (and on `event_date` where the table is
    partitioned by it), so files and partitions outside are skipped.
    """
    inside = log.filter(F.col("ts").between(F.lit(start), F.lit(end)))
    if "event_date" in log.columns:
        inside = inside.filter(
            F.col("event_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
        )
    return inside.orderBy("ts", "id")


def of_type(log: DataFrame, event_type: str, limit: int | None = None) -> DataFrame:
    """Events of one type; with a limit, the latest ones."""
    rows = log.filter(F.col("event_type") == event_type)
    if limit is None:
        return rows.orderBy("ts", "id")
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def recent(log: DataFrame, limit: int = 20) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def recent_per_subject(log: DataFrame, limit: int = 20) -> DataFrame:
    """Latest `limit` events of every subject; tasks drop the rest before the shuffle."""
    newest = Window.partitionBy("subject_id").orderBy(F.desc("ts"), F.desc("id"))
    return log.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)


def by_id(log: DataFrame, event_id: str) -> DataFrame:
    return log.filter(F.col("id") == event_id)


def by_ids(log: DataFrame, ids: DataFrame) -> DataFrame:
    return log.join(ids.select("id"), "id", "left_semi")


def sorted_log(log: DataFrame) -> DataFrame:
    return log.orderBy("ts", "id")


# -- typed views ---------------------------------------------------------------


def is_insulin(meta: Column) -> Column:
    return F.coalesce(meta.getField("type").isin(values.INSULIN_TYPES), F.lit(False))


def is_bsl(meta: Column) -> Column:
    return F.coalesce(meta.getField("unit").isin(values.BSL_UNITS), F.lit(False))


def is_exercise(meta: Column) -> Column:
    return F.coalesce(meta.getField("intensity").isin(values.INTENSITIES), F.lit(False))


def is_meal(meta: Column) -> Column:
    present = None
    for name in ("carbs", "calories", "description", "photo_url", "alcohol_units"):
        test = meta.getField(name).isNotNull()
        present = test if present is None else present | test
    return F.coalesce(present, F.lit(False))


def with_guards(log: DataFrame) -> DataFrame:
    meta = F.col("meta")
    return log.select(
        "*",
        is_meal(meta).alias("is_meal_meta"),
        is_insulin(meta).alias("is_insulin_meta"),
        is_bsl(meta).alias("is_bsl_meta"),
        is_exercise(meta).alias("is_exercise_meta"),
    )


def event_window(
    log: DataFrame, start, end, meal_lookback_hours: int = values.LOOKBACK_HOURS["meal"]
) -> DataFrame:
    """Events a model run over [start, end] may see: each type has its own lookback.

    The six hours for meals cut off alcohol effects that last 12 to 16; raise
    `meal_lookback_hours` to see them all.
    """
    hours = {**values.LOOKBACK_HOURS, "meal": meal_lookback_hours}
    keep = F.lit(False)
    for event_type, back in hours.items():
        opened = F.lit(start).cast("timestamp") - F.expr(f"INTERVAL {back} HOURS")
        keep = keep | ((F.col("event_type") == event_type) & (F.col("ts") >= opened))
    widest = F.lit(start).cast("timestamp") - F.expr(f"INTERVAL {max(hours.values())} HOURS")
    return log.filter((F.col("ts") >= widest) & (F.col("ts") <= F.lit(end)) & keep)


# -- summaries -----------------------------------------------------------------


def day_summary(log: DataFrame, tz: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Insulin, carbohydrate and glucose of every subject and local day; `by` names further columns to group by."""

    def only(event_type: str) -> Column:
        return F.when(F.col("event_type") == event_type, F.col("value"))

    day = F.to_date(local_time(F.col("ts"), tz)).alias("day")
    return log.groupBy("subject_id", day, *(by or [])).agg(
        F.coalesce(F.sum(only("insulin")), F.lit(0.0)).alias("total_insulin"),
        F.coalesce(F.sum(only("meal")), F.lit(0.0)).alias("total_carbs"),
        F.avg(only("bsl")).alias("avg_bsl"),
        F.count(F.lit(1)).alias("event_count"),
    )


def type_counts(log: DataFrame) -> DataFrame:
    """Events per type, and over all types under `all`."""
    return (
        log.rollup("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("event_type").alias("_all"))
        .select(
            F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("event_type")).alias(
                "event_type"
            ),
            "n",
        )
    )


def glucose_summary(readings: DataFrame, by: list[str]) -> DataFrame:
    """Extremes, mean and time in range; expects `value` and `unit`."""
    hit = F.count_if(glucose.in_target(F.col("value"), F.col("unit")))
    total = F.count(F.lit(1))
    return readings.groupBy(*by).agg(
        F.min("value").alias("min_bsl"),
        F.max("value").alias("max_bsl"),
        F.avg("value").alias("avg_bsl"),
        total.alias("n"),
        F.floor(hit / total * 100.0 + 0.5).alias("time_in_range_pct"),
    )


def mean_confidence(points: DataFrame, by: list[str]) -> DataFrame:
    return points.groupBy(*by).agg(
        F.coalesce(F.floor(F.avg("confidence") * 100.0 + 0.5), F.lit(0)).alias(
            "avg_confidence_pct"
        )
    )


def history_by_day(
    log: DataFrame, event_type: str | None = None, limit: int = 50, tz: str | None = None
) -> DataFrame:
    """The latest `limit` events of each subject, grouped by day, newest first.

    The arrays hold at most `limit` entries, which is what makes collecting them safe.
    """
    rows = recent_per_subject(log, limit)
    if event_type is not None:
        rows = rows.filter(F.col("event_type") == event_type)
    return rows.groupBy("subject_id", F.to_date(local_time(F.col("ts"), tz)).alias("day")).agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(
            F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda e: e.getField("id")
        ).alias("event_ids"),
    )


def recent_distinct_values(
    log: DataFrame, event_type: str, value: Column, keep: Column, limit: int, probe: int = 50
) -> DataFrame:
    """Most recently used distinct values among the latest `probe` events of a type."""
    latest = recent_per_subject(log.filter(F.col("event_type") == event_type), probe)
    used = (
        latest.filter(keep)
        .groupBy("subject_id", value.alias("recent_value"))
        .agg(F.min("rank").alias("_first_seen"))
    )
    order = Window.partitionBy("subject_id").orderBy("_first_seen")
    return (
        used.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= limit)
        .select("subject_id", "position", "recent_value")
    )


def recent_insulin_doses(log: DataFrame, insulin_type: str, limit: int = 6) -> DataFrame:
    kind = F.col("meta").getField("type")
    return recent_distinct_values(log, "insulin", F.col("value"), kind == insulin_type, limit)


def recent_bsl_values(log: DataFrame, limit: int = 5) -> DataFrame:
    return recent_distinct_values(log, "bsl", F.col("value"), F.lit(True), limit)


def recent_carb_values(log: DataFrame, limit: int = 6) -> DataFrame:
    carbs = F.col("meta").getField("carbs")
    return recent_distinct_values(log, "meal", carbs, carbs.isNotNull(), limit)


def last_insulin_dose(log: DataFrame) -> DataFrame:
    dose = F.struct("ts", "id", "value", F.col("meta").getField("type").alias("type"))
    return (
        log.filter(F.col("event_type") == "insulin")
        .groupBy("subject_id")
        .agg(F.max(dose).alias("d"))
        .select(
            "subject_id",
            F.col("d.id").alias("id"),
            F.col("d.ts").alias("ts"),
            F.col("d.value").alias("units"),
            F.col("d.type").alias("type"),
        )
    )


# -- entry rules ---------------------------------------------------------------


def entry_violations(log: DataFrame) -> Column:
    """Codes of the entry limits an event breaks."""
    meta, value, kind = F.col("meta"), F.col("value"), F.col("event_type")
    drinks = F.coalesce(meta.getField("alcohol_units"), F.lit(0.0))
    rules = [
        (~kind.isin(values.EVENT_TYPES), "TYPE_UNKNOWN"),
        (value.isNull() | F.isnan(value), "VALUE_MISSING"),
        ((kind == "insulin") & ((value <= 0) | (value > 300)), "UNITS_RANGE"),
        ((kind == "insulin") & (value != F.floor(value)), "UNITS_NOT_WHOLE"),
        ((kind == "insulin") & ~is_insulin(meta), "INSULIN_TYPE"),
        ((kind == "meal") & ((value < 0) | (value > 500)), "CARBS_RANGE"),
        ((kind == "meal") & (value <= 0) & (drinks <= 0), "MEAL_EMPTY"),
        ((kind == "meal") & ((drinks < 0) | (drinks > 50)), "ALCOHOL_RANGE"),
        ((kind == "meal") & (half_up(drinks, 1) != drinks), "ALCOHOL_PRECISION"),
        ((kind == "meal") & ~is_meal(meta), "MEAL_META"),
        ((kind == "bsl") & ((value < 2) | (value > 30)), "BSL_RANGE"),
        ((kind == "bsl") & ~is_bsl(meta), "BSL_UNIT"),
        ((kind == "exercise") & ((value < 5) | (value > 300)), "MINUTES_RANGE"),
        ((kind == "exercise") & ~is_exercise(meta), "INTENSITY"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in rules]))


def enforce_schema(log: DataFrame) -> DataFrame:
    """Every event with its violation codes; an empty list means it may enter the table."""
    return log.withColumn("violations", entry_violations(log))


def violation_counts(log: DataFrame) -> DataFrame:
    return (
        enforce_schema(log)
        .select("event_type", F.explode("violations").alias("rule"))
        .groupBy("event_type", "rule")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# -- building events -----------------------------------------------------------


def insulin_events(raw: DataFrame) -> DataFrame:
    """From `units`, `type`."""
    return _event(raw, "insulin", F.col("units"), type=F.col("type"))


def bsl_events(raw: DataFrame) -> DataFrame:
    """From `reading` and, if there, `unit`, `source`, `device`, `is_finger_prick`."""
    unit = F.coalesce(F.col("unit"), F.lit("mmol/L")) if "unit" in raw.columns else F.lit("mmol/L")
    source = (
        F.coalesce(F.col("source"), F.lit("manual")) if "source" in raw.columns else F.lit("manual")
    )
    extra = {c: F.col(c) for c in ("device", "is_finger_prick") if c in raw.columns}
    return _event(raw, "bsl", F.col("reading"), unit=unit, source=source, **extra)


def meal_events(raw: DataFrame) -> DataFrame:
    """From `carbs` and any of the meal metadata columns."""
    names = ("calories", "protein", "fat", "description", "alcohol_units", "alcohol_type")
    extra = {c: F.col(c) for c in names if c in raw.columns}
    return _event(raw, "meal", F.col("carbs"), carbs=F.col("carbs"), **extra)


def exercise_events(raw: DataFrame) -> DataFrame:
    """From `minutes`, `intensity`."""
    return _event(
        raw,
        "exercise",
        F.col("minutes"),
        intensity=F.col("intensity"),
        duration_minutes=F.col("minutes"),
    )


def _event(raw: DataFrame, event_type: str, value: Column, **meta: Column) -> DataFrame:
    from glycoflow.schemas import META

    fields = [
        meta.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in META.fields
    ]
    return raw.select(
        "id",
        "subject_id",
        "ts",
        F.lit(event_type).alias("event_type"),
        value.cast("double").alias("value"),
        F.struct(*fields).alias("meta"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.lit(False).alias("synced"),
    )


def merge_streams(*streams: DataFrame) -> DataFrame:
    """One log out of typed event tables."""
    first, *rest = streams
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def items_total(meals: DataFrame, items: str) -> DataFrame:
    return meals.select(
        "*", *[macros.item_total(F.col(items), n).alias(f"total_{n}") for n in macros.FIELDS]
    )
