"""The given `events` table seen as a physiological event log, in Spark and in SQL.

click -> glucose reading, view -> meal, purchase -> insulin, error -> meal with a drink,
signup -> exercise. `k` is the number inside `props`.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.operators.grid import Grid
from glycoflow.schemas import META
from glycoflow.session import configure

DESCRIPTIONS = [
    "Whole grain bread", "Pineapple bowl", "White plate", "High fiber bar", "Lentils curry",
    "Pizza slice", "Juice, \"fresh\"", "Mixed grill", "Default plate", "Oatmeal",
    "Steak", "Wholegrain wrap", "",
]
DRINK_TYPES = ["beer", "wine", "spirit", "mixed"]
INTENSITIES = ["low", "moderate", "high"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(choices: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), F.pmod(number, F.lit(len(choices))))


RAW_KINDS = {
    "bsl": ["click"], "meal": ["view", "error"], "insulin": ["purchase"], "exercise": ["signup"],
}


def event_rows(
    spark: SparkSession, sf_dir: str, kinds: list[str] | None = None,
    start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """Events with subject, millisecond timestamp and the number in `props`.

    Kinds and bounds are compared with the raw columns, so that the scan skips what is
    outside; the end is taken a millisecond later, as instants are cut to milliseconds.
    """
    raw = table(spark, sf_dir, "events")
    if kinds is not None:
        raw = raw.filter(F.col("event_type").isin([r for k in kinds for r in RAW_KINDS[k]]))
    stamp = raw.schema["ts"].dataType
    if start is not None:
        raw = raw.filter(F.col("ts") >= F.lit(start).cast(stamp))
    if end is not None:
        raw = raw.filter(F.col("ts") < F.lit(end + timedelta(milliseconds=1)).cast(stamp))
    return raw.select(
        "event_id",
        F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp")).alias("ts"),
        F.col("user_id").alias("subject_id"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def event_log(
    spark: SparkSession, sf_dir: str, kinds: list[str] | None = None,
    start: datetime | None = None, end: datetime | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """The log, of some kinds and a span alone if asked for; `keep` names raw columns to stay."""
    rows = event_rows(spark, sf_dir, kinds, start, end)
    kind, k, value = F.col("event_type"), F.col("k"), F.col("value")
    is_bsl, is_food = kind == "click", kind == "view"
    is_dose, is_drink, is_move = kind == "purchase", kind == "error", kind == "signup"
    reading = F.lit(2.0) + F.pmod(F.floor(value * 100.0), F.lit(1800)) / 100.0
    carbs = F.when(is_food, k + 10).when(is_drink, F.pmod(k, F.lit(20))).cast("double")
    meta = {
        "type": F.when(
            is_dose, F.when(F.pmod(k, F.lit(5)) == 0, F.lit("basal")).otherwise(F.lit("bolus"))
        ),
        "unit": F.when(is_bsl, F.lit("mmol/L")),
        "source": F.when(
            is_bsl, F.when(F.pmod(k, F.lit(4)) == 0, F.lit("cgm")).otherwise(F.lit("manual"))
        ),
        "is_finger_prick": F.when(is_bsl, F.pmod(k, F.lit(2)) == 0),
        "carbs": carbs,
        "description": F.when(is_food, _pick(DESCRIPTIONS, F.col("event_id"))),
        "alcohol_units": F.when(is_drink, (F.pmod(k, F.lit(8)) + 1) * 0.5),
        "alcohol_type": F.when(is_drink, _pick(DRINK_TYPES, k)),
        "intensity": F.when(is_move, _pick(INTENSITIES, k)),
        "duration_minutes": F.when(is_move, (k + 5).cast("double")),
    }
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        "subject_id",
        "ts",
        F.when(is_bsl, F.lit("bsl"))
        .when(is_food | is_drink, F.lit("meal"))
        .when(is_dose, F.lit("insulin"))
        .otherwise(F.lit("exercise"))
        .alias("event_type"),
        F.when(is_bsl, reading)
        .when(is_food | is_drink, carbs)
        .when(is_dose, F.pmod(k, F.lit(12)) + 1)
        .otherwise(k + 5)
        .cast("double")
        .alias("value"),
        F.struct(
            *[
                meta.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                for f in META.fields
            ]
        ).alias("meta"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
        F.lit(False).alias("synced"),
        *keep,
    )


def _sql_list(choices: list[str]) -> str:
    return "[" + ",".join("'" + c.replace("'", "''") + "'" for c in choices) + "]"


# The same log in SQL: flat metadata columns, `ms` for the instant.
LOG = f"""
ev AS (
  SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id AS subject_id, event_type AS src,
         value AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
log AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id, subject_id, ms, src, k,
    CASE src WHEN 'click' THEN 'bsl' WHEN 'view' THEN 'meal' WHEN 'error' THEN 'meal'
             WHEN 'purchase' THEN 'insulin' ELSE 'exercise' END AS event_type,
    CAST(CASE src WHEN 'click' THEN 2.0::DOUBLE + (CAST(floor(v*100.0::DOUBLE) AS BIGINT) % 1800) / 100.0::DOUBLE
             WHEN 'view' THEN k + 10 WHEN 'error' THEN k % 20
             WHEN 'purchase' THEN k % 12 + 1 ELSE k + 5 END AS DOUBLE) AS value,
    CASE WHEN src = 'purchase' THEN CASE WHEN k % 5 = 0 THEN 'basal' ELSE 'bolus' END END AS itype,
    CASE WHEN src = 'click' THEN 'mmol/L' END AS unit,
    CASE WHEN src = 'click' THEN CASE WHEN k % 4 = 0 THEN 'cgm' ELSE 'manual' END END AS source,
    CASE WHEN src = 'click' THEN k % 2 = 0 END AS prick,
    CAST(CASE src WHEN 'view' THEN k + 10 WHEN 'error' THEN k % 20 END AS DOUBLE) AS carbs,
    CASE WHEN src = 'view' THEN {_sql_list(DESCRIPTIONS)}[event_id % {len(DESCRIPTIONS)} + 1] END AS descr,
    CASE WHEN src = 'error' THEN (k % 8 + 1) * 0.5::DOUBLE END AS aunits,
    CASE WHEN src = 'error' THEN {_sql_list(DRINK_TYPES)}[k % 4 + 1] END AS atype,
    CASE WHEN src = 'signup' THEN {_sql_list(INTENSITIES)}[k % 3 + 1] END AS intensity
  FROM ev)
"""

# Whole days from the first to the last event.
SPAN = """
span AS (
  SELECT epoch_ms(date_trunc('day', min(ts))) AS lo,
         epoch_ms(date_trunc('day', max(ts)) + INTERVAL 1 DAY) AS hi
  FROM events)
"""


def log_span(spark: SparkSession, sf_dir: str) -> tuple[datetime, datetime]:
    """First day start and last day end of the events: two values, one small job."""
    low, high = (
        table(spark, sf_dir, "events")
        .agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
        .select(
            F.date_format(F.date_trunc("DAY", "low"), "yyyy-MM-dd"),
            F.date_format(F.date_trunc("DAY", "high"), "yyyy-MM-dd"),
        )
        .first()
    )
    return datetime.fromisoformat(low), datetime.fromisoformat(high) + timedelta(days=1)


def log_grid(spark: SparkSession, sf_dir: str, step_minutes: int = 5) -> Grid:
    start, end = log_span(spark, sf_dir)
    return Grid(start, end, step_minutes)


def subjects(log: DataFrame) -> DataFrame:
    return log.select("subject_id").distinct()
