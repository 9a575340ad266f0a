"""Scans, views, summaries and top-k queries over the log."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from glycoflow.catalog.adapter import (
    LOG, SPAN, event_log, log_span, table,
)
from glycoflow.catalog.registry import query, r6
from glycoflow.functions import glucose, text
from glycoflow.functions.alcohol import linear_percent_left
from glycoflow.functions.text import event_label
from glycoflow.operators import log as ops
from glycoflow.values import LOOKBACK_HOURS

FLAT = ["id", "subject_id", "ts", "event_type", "value"]
FLAT_SQL = "id, subject_id, ms AS ts, event_type, " + r6("value") + " AS value"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip() for c in ctes) + "\n"


@query("s1_event_scan", _with(LOG) + f"""
SELECT {FLAT_SQL}, itype AS type, unit, {r6('carbs')} AS carbs, descr AS description,
       {r6('aunits')} AS alcohol_units, atype AS alcohol_type, intensity FROM log""")
def event_scan(spark, sf):
    return event_log(spark, sf).select(
        *FLAT, "meta.type", "meta.unit", "meta.carbs", "meta.description",
        "meta.alcohol_units", "meta.alcohol_type", "meta.intensity",
    )


@query("s2_time_range", _with(LOG, SPAN) + f"""
SELECT {FLAT_SQL} FROM log, span
WHERE ms BETWEEN lo + 7*86400000 AND lo + 14*86400000""")
def time_range(spark, sf):
    start, _ = log_span(spark, sf)
    since, until = start + timedelta(days=7), start + timedelta(days=14)
    rows = ops.between(event_log(spark, sf, start=since, end=until), since, until)
    return rows.select(*FLAT)


@query("s3_by_type", _with(LOG) + f"""
SELECT {FLAT_SQL} FROM log WHERE event_type = 'insulin' ORDER BY ms DESC, id DESC LIMIT 30""")
def by_type(spark, sf):
    return ops.of_type(event_log(spark, sf, ["insulin"]), "insulin", 30).select(*FLAT)


@query("s4_recent_events", _with(LOG) + f"""
SELECT {FLAT_SQL} FROM log ORDER BY ms DESC, id DESC LIMIT 20""")
def recent_events(spark, sf):
    return ops.recent(event_log(spark, sf)).select(*FLAT)


@query("s4_recent_events_per_subject", _with(LOG) + f"""
SELECT {FLAT_SQL}, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ms DESC, id DESC) AS rank FROM log)
WHERE rank <= 20""")
def recent_events_per_subject(spark, sf):
    return ops.recent_per_subject(event_log(spark, sf)).select(*FLAT, "rank")


@query("s5_lookup_by_ids", _with(LOG) + f"""
SELECT {FLAT_SQL} FROM log
WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents)""")
def lookup_by_ids(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return ops.by_ids(event_log(spark, sf), ids).select(*FLAT)


@query("t5_sorted_log", _with(LOG) + f"SELECT {FLAT_SQL} FROM log ORDER BY ms, id")
def sorted_log(spark, sf):
    return ops.sorted_log(event_log(spark, sf)).select(*FLAT)


@query("p1_typed_views", _with(LOG) + """
SELECT event_type, CAST(count(*) AS BIGINT) AS n,
  CAST(count_if(carbs IS NOT NULL OR descr IS NOT NULL OR aunits IS NOT NULL) AS BIGINT) AS meals,
  CAST(count_if(coalesce(itype IN ('bolus','basal'), false)) AS BIGINT) AS insulins,
  CAST(count_if(coalesce(unit IN ('mmol/L','mg/dL'), false)) AS BIGINT) AS readings,
  CAST(count_if(coalesce(intensity IN ('low','moderate','high'), false)) AS BIGINT) AS moves
FROM log GROUP BY event_type""")
def typed_views(spark, sf):
    return ops.with_guards(event_log(spark, sf)).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_meal_meta").alias("meals"),
        F.count_if("is_insulin_meta").alias("insulins"),
        F.count_if("is_bsl_meta").alias("readings"),
        F.count_if("is_exercise_meta").alias("moves"),
    )


@query("p2_event_constructors", f"""
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || kind AS id,
       l_suppkey AS subject_id, epoch_ms(l_shipdate) AS ts, kind AS event_type,
       {r6("CASE kind WHEN 'insulin' THEN l_quantity WHEN 'bsl' THEN l_discount*100 WHEN 'meal' THEN l_quantity*2 ELSE l_tax*1000 END")} AS value,
       CASE WHEN kind = 'insulin' THEN 'bolus' END AS type,
       CASE WHEN kind = 'bsl' THEN 'mmol/L' END AS unit,
       CASE WHEN kind = 'bsl' THEN 'manual' END AS source,
       {r6("CASE WHEN kind = 'meal' THEN l_quantity*2 END")} AS carbs,
       CASE WHEN kind = 'exercise' THEN 'high' END AS intensity,
       {r6("CASE WHEN kind = 'exercise' THEN l_tax*1000 END")} AS duration_minutes
FROM lineitem, (SELECT unnest(['insulin','bsl','meal','exercise']) AS kind)""")
def event_constructors(spark, sf):
    lines = table(spark, sf, "lineitem")

    def raw(kind, **columns):
        return lines.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", F.lit(kind)).alias("id"),
            F.col("l_suppkey").alias("subject_id"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            *[c.alias(n) for n, c in columns.items()],
        )

    q = F.col("l_quantity")
    merged = ops.merge_streams(
        ops.insulin_events(raw("insulin", units=q, type=F.lit("bolus"))),
        ops.bsl_events(raw("bsl", reading=F.col("l_discount") * 100)),
        ops.meal_events(raw("meal", carbs=q * 2)),
        ops.exercise_events(
            raw("exercise", minutes=F.col("l_tax") * 1000, intensity=F.lit("high"))
        ),
    )
    return merged.select(
        *FLAT, "meta.type", "meta.unit", "meta.source", "meta.carbs", "meta.intensity",
        "meta.duration_minutes",
    )


@query("p3_unit_conversion", f"""
SELECT l_orderkey, l_linenumber,
  {r6('mg/18.0182')} AS import_mmol, {r6('floor((mg/18.0182)*10+0.5)/10')} AS api_mmol,
  {r6('floor(mmol*18.0182+0.5)')} AS display_mgdl, {r6('floor(mmol*18.0+0.5)')} AS axis_mgdl,
  {r6("CASE WHEN mg > 35 THEN mg/18.0182 ELSE mg END")} AS stored_mmol,
  CAST(mg <= 35 AS BIGINT) AS unit_suspect
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice/200 AS mg, l_quantity/2 AS mmol FROM lineitem)""")
def unit_conversion(spark, sf):
    mg, mmol, unit = F.col("l_extendedprice") / 200, F.col("l_quantity") / 2, F.lit("mg/dL")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        glucose.mgdl_to_mmol(mg).alias("import_mmol"),
        glucose.mgdl_to_mmol(mg, 1).alias("api_mmol"),
        glucose.mmol_to_mgdl(mmol).alias("display_mgdl"),
        glucose.mmol_to_mgdl(mmol, 0, 18.0).alias("axis_mgdl"),
        glucose.normalised(mg, unit).alias("stored_mmol"),
        glucose.unit_suspect(mg, unit).alias("unit_suspect"),
    )


@query("p7_alcohol_left", _with(LOG) + """
SELECT id, CAST(CASE WHEN coalesce(aunits,0) > 0 THEN
  floor(greatest(0, aunits - (ms - ms // 86400000 * 86400000 > 0)::INT * ((ms // 86400000 + 1) * 86400000 - ms) / 3600000.0::DOUBLE) / aunits * 100 + 0.5)
  ELSE 100 END AS BIGINT) AS percent_left
FROM log WHERE event_type = 'meal'""")
def alcohol_left(spark, sf):
    """Share left at the end of the day of each meal."""
    ms = F.unix_millis("ts")
    midnight = (F.floor(ms / F.lit(86_400_000)) + 1) * 86_400_000
    return (
        event_log(spark, sf)
        .filter(F.col("event_type") == "meal")
        .select(
            "id",
            linear_percent_left(F.col("meta.alcohol_units"), ms, midnight).alias("percent_left"),
        )
    )


_NUM = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@query("p8_event_label", _with(LOG) + f"""
SELECT id, CASE
  WHEN event_type = 'insulin' THEN {_NUM.format('value')} || ' units ' || coalesce(itype,'')
  WHEN event_type = 'meal' AND coalesce(aunits,0) > 0 AND value = 0 THEN {_NUM.format('aunits')} || ' units alcohol'
  WHEN event_type = 'meal' AND coalesce(aunits,0) > 0 THEN {_NUM.format('value')} || 'g carbs + ' || {_NUM.format('aunits')} || 'u'
  WHEN event_type = 'meal' THEN {_NUM.format('value')} || 'g carbs'
  WHEN event_type = 'bsl' THEN {_NUM.format('value')} || ' ' || coalesce(unit,'mmol/L')
  ELSE {_NUM.format('value')} || ' min' END AS label
FROM log""")
def event_labels(spark, sf):
    return event_log(spark, sf).select(
        "id", event_label(F.col("event_type"), F.col("value"), F.col("meta")).alias("label")
    )


@query("p10_confidence_bands", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.5 THEN 'medium' ELSE 'low' END AS item_band,
  CASE WHEN c >= 0.9 THEN 'high' WHEN c >= 0.7 THEN 'medium' ELSE 'low' END AS reading_band,
  CASE WHEN c >= 0.8 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS point_band,
  CASE WHEN e <= 5 THEN 'good' WHEN e <= 15 THEN 'fair' ELSE 'poor' END AS error_band
FROM (SELECT l_orderkey, l_linenumber, l_quantity/50 AS c, l_discount*200 AS e FROM lineitem)""")
def confidence_bands(spark, sf):
    c, e = F.col("l_quantity") / 50, F.col("l_discount") * 200
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        glucose.item_confidence_band(c).alias("item_band"),
        glucose.reading_confidence_band(c).alias("reading_band"),
        glucose.point_confidence_band(c).alias("point_band"),
        glucose.error_band(e).alias("error_band"),
    )


@query("p11_type_filter", _with(LOG) + f"SELECT {FLAT_SQL} FROM log WHERE event_type = 'exercise'")
def type_filter(spark, sf):
    return event_log(spark, sf, ["exercise"]).select(*FLAT)


@query("p12_event_window", _with(LOG, SPAN) + f"""
SELECT {FLAT_SQL} FROM log, span
WHERE ms <= lo + 20*86400000 AND (
  (event_type = 'insulin' AND ms >= lo + 10*86400000 - 24*3600000) OR
  (event_type = 'meal' AND ms >= lo + 10*86400000 - 6*3600000) OR
  (event_type = 'bsl' AND ms >= lo + 10*86400000 - 12*3600000))""")
def event_window(spark, sf):
    start, _ = log_span(spark, sf)
    since, until = start + timedelta(days=10), start + timedelta(days=20)
    widest = since - timedelta(hours=max(LOOKBACK_HOURS.values()))
    log = event_log(spark, sf, ["insulin", "meal", "bsl"], widest, until)
    return ops.event_window(log, since, until).select(*FLAT)


_RULES = """
rules AS (
  SELECT event_type, unnest(list_filter([
    CASE WHEN event_type = 'insulin' AND (value <= 0 OR value > 300) THEN 'UNITS_RANGE' END,
    CASE WHEN event_type = 'insulin' AND value <> floor(value) THEN 'UNITS_NOT_WHOLE' END,
    CASE WHEN event_type = 'meal' AND (value < 0 OR value > 500) THEN 'CARBS_RANGE' END,
    CASE WHEN event_type = 'meal' AND value <= 0 AND coalesce(aunits,0) <= 0 THEN 'MEAL_EMPTY' END,
    CASE WHEN event_type = 'bsl' AND (value < 2 OR value > 30) THEN 'BSL_RANGE' END,
    CASE WHEN event_type = 'exercise' AND (value < 5 OR value > 300) THEN 'MINUTES_RANGE' END
  ], lambda x: x IS NOT NULL)) AS rule
  FROM (SELECT event_type, value * 3.3 - 5.0 AS value, aunits FROM log))
"""


@query("p16_entry_limits", _with(LOG, _RULES) + """
SELECT event_type, rule, CAST(count(*) AS BIGINT) AS n FROM rules GROUP BY ALL""")
def entry_limits(spark, sf):
    """Entry rules on a log whose values were stretched so that some break them."""
    stretched = event_log(spark, sf).withColumn("value", F.col("value") * 3.3 - 5.0)
    return ops.violation_counts(stretched)


@query("st6_schema_enforcer", _with(LOG) + f"""
SELECT id, subject_id, ms AS ts, {r6('value')} AS value,
  CASE event_type WHEN 'exercise' THEN 'steps' ELSE event_type END AS event_type,
  CASE WHEN event_type = 'exercise' THEN 'TYPE_UNKNOWN'
  WHEN itype = 'basal' THEN 'INSULIN_TYPE' ELSE '' END AS violations FROM log""")
def schema_enforcer(spark, sf):
    """Exercise arrives under an unknown type and basal doses under an unknown kind."""
    kind, meta = F.col("event_type"), F.col("meta")
    renamed = F.when(F.col("meta.type") == "basal", F.lit("pump")).otherwise(F.col("meta.type"))
    foreign = event_log(spark, sf).select(
        "id", "subject_id", "ts", "value",
        F.when(kind == "exercise", F.lit("steps")).otherwise(kind).alias("event_type"),
        meta.withField("type", renamed).alias("meta"),
    )
    return ops.enforce_schema(foreign).select(*FLAT, "violations")


@query("a1_day_summary", _with(LOG) + f"""
SELECT subject_id, strftime(make_timestamp(ms*1000), '%Y-%m-%d') AS day,
  {r6("coalesce(sum(value) FILTER (event_type='insulin'),0)")} AS total_insulin,
  {r6("coalesce(sum(value) FILTER (event_type='meal'),0)")} AS total_carbs,
  {r6("avg(value) FILTER (event_type='bsl')")} AS avg_bsl,
  CAST(count(*) AS BIGINT) AS event_count
FROM log GROUP BY ALL""")
def day_summary(spark, sf):
    return ops.day_summary(event_log(spark, sf))


@query("a2_type_counts", _with(LOG) + """
SELECT CASE WHEN grouping(event_type) = 1 THEN 'all' ELSE event_type END AS event_type,
       CAST(count(*) AS BIGINT) AS n FROM log GROUP BY ROLLUP (event_type)""")
def type_counts(spark, sf):
    return ops.type_counts(event_log(spark, sf))


@query("a3_glucose_summary", _with(LOG) + f"""
SELECT subject_id, {r6('min(value)')} AS min_bsl, {r6('max(value)')} AS max_bsl,
  {r6('avg(value)')} AS avg_bsl, CAST(count(*) AS BIGINT) AS n,
  CAST(floor(count_if(value BETWEEN 4 AND 10)/count(*)*100.0::DOUBLE+0.5) AS BIGINT) AS time_in_range_pct
FROM log WHERE event_type = 'bsl' GROUP BY subject_id""")
def glucose_summary(spark, sf):
    readings = (
        event_log(spark, sf)
        .filter(F.col("event_type") == "bsl")
        .select("subject_id", "value", F.col("meta.unit").alias("unit"))
    )
    return ops.glucose_summary(readings, ["subject_id"])


@query("a17_history_by_day", _with(LOG) + """
SELECT subject_id, strftime(make_timestamp(ms*1000), '%Y-%m-%d') AS day,
  CAST(count(*) AS BIGINT) AS n, string_agg(id, '|' ORDER BY rank) AS event_ids
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ms DESC, id DESC) AS rank FROM log)
WHERE rank <= 50 GROUP BY ALL""")
def history_by_day(spark, sf):
    return ops.history_by_day(event_log(spark, sf))


def _recent_sql(event_type: str, value: str, keep: str, limit: int) -> str:
    return _with(LOG) + f"""
SELECT subject_id, position, {r6('recent_value')} AS recent_value FROM (
  SELECT subject_id, recent_value, row_number() OVER (PARTITION BY subject_id ORDER BY first_seen) AS position
  FROM (SELECT subject_id, {value} AS recent_value, min(rank) AS first_seen FROM (
      SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ms DESC, id DESC) AS rank
      FROM log WHERE event_type = '{event_type}') WHERE rank <= 50 AND {keep} GROUP BY ALL))
WHERE position <= {limit}"""


@query("t1_recent_bolus_doses", _recent_sql("insulin", "value", "itype = 'bolus'", 6))
def recent_bolus(spark, sf):
    return ops.recent_insulin_doses(event_log(spark, sf), "bolus")


@query("t1_recent_bsl_values", _recent_sql("bsl", "value", "true", 5))
def recent_bsl(spark, sf):
    return ops.recent_bsl_values(event_log(spark, sf))


@query("t1_recent_carb_values", _recent_sql("meal", "carbs", "carbs IS NOT NULL", 6))
def recent_carbs(spark, sf):
    return ops.recent_carb_values(event_log(spark, sf))


@query("w7_last_insulin_dose", _with(LOG) + f"""
SELECT subject_id, id, ms AS ts, {r6('value')} AS units, itype AS type FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ms DESC, id DESC) AS rank
  FROM log WHERE event_type = 'insulin') WHERE rank = 1""")
def last_dose(spark, sf):
    return ops.last_insulin_dose(event_log(spark, sf))


@query("u1_union_streams", _with(LOG) + f"""
SELECT {FLAT_SQL} FROM log UNION ALL BY NAME
SELECT 'o' || o_orderkey AS id, o_custkey AS subject_id, epoch_ms(o_orderdate) AS ts,
  'meal' AS event_type, {r6('o_totalprice/1000')} AS value FROM orders""")
def union_streams(spark, sf):
    meals = ops.meal_events(
        table(spark, sf, "orders").select(
            F.concat(F.lit("o"), "o_orderkey").alias("id"),
            F.col("o_custkey").alias("subject_id"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            (F.col("o_totalprice") / 1000).alias("carbs"),
        )
    )
    return ops.merge_streams(event_log(spark, sf), meals).select(*FLAT)


@query("f15_trend_direction", """
SELECT l_orderkey, l_linenumber, CASE CAST(l_quantity AS BIGINT) % 9
  WHEN 1 THEN 'rising-fast' WHEN 2 THEN 'rising' WHEN 3 THEN 'rising-slow' WHEN 4 THEN 'stable'
  WHEN 5 THEN 'falling-slow' WHEN 6 THEN 'falling' WHEN 7 THEN 'falling-fast'
  ELSE 'unknown' END AS trend FROM lineitem""")
def trend_direction(spark, sf):
    code = F.pmod(F.col("l_quantity").cast("bigint"), F.lit(9))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", text.trend_direction(code).alias("trend")
    )
