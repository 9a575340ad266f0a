"""Batch twins of the streaming views; tests run the same functions on real streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from glycoflow.catalog.adapter import LOG, SPAN, event_log, event_rows, log_grid, table
from glycoflow.catalog.kernels import CIRC, _with
from glycoflow.catalog.models import CARB, DRINK, GRID, INS
from glycoflow.catalog.registry import query, r6
from glycoflow.operators.ordered import sessions
from glycoflow.streaming import late, windows


@query("st2_glucose_windows", _with(LOG) + f"""
SELECT subject_id, ms // 300000 * 300000 AS window_start, CAST(count(*) AS BIGINT) AS n, {r6('avg(value)')} AS avg_bsl,
  {r6('min(value)')} AS min_bsl, {r6('max(value)')} AS max_bsl, CAST(count_if(value BETWEEN 4 AND 10) AS BIGINT) AS n_in_range
FROM log WHERE event_type = 'bsl' GROUP BY ALL""")
def glucose_windows(spark, sf):
    return windows.glucose_windows(event_log(spark, sf))


@query("st3_decay_totals", _with(LOG, SPAN, GRID, "seen AS (SELECT * FROM log)", INS, CARB, DRINK) + f"""
SELECT subject_id, t AS at_ts, {r6('coalesce(sum(iob), 0)')} AS iob, {r6('coalesce(sum(cob), 0)')} AS cob,
  {r6('coalesce(sum(sys), 0)')} AS alcohol_in_system, {r6('coalesce(product(md2), 1)')} AS sensitivity_modifier FROM (
    SELECT subject_id, t, iob, NULL AS cob, NULL AS sys, NULL AS md2 FROM ins
    UNION ALL SELECT subject_id, t, NULL, cob, NULL, NULL FROM carb UNION ALL SELECT subject_id, t, NULL, NULL, in_system, md2 FROM alc)
GROUP BY subject_id, t""")
def decay_totals(spark, sf):
    return windows.decay_totals(event_log(spark, sf), log_grid(spark, sf))


_LATE = """
lt AS (SELECT *, k*30000 AS lateness_ms, k*30000 > 1200000 AS is_late FROM log)
"""


def ingested(spark, sf):
    """Events that were taken in half a minute times `k` after they happened."""
    return event_log(spark, sf, keep=("k",)).withColumn(
        "ingest_ts", F.timestamp_millis(F.unix_millis("ts") + F.col("k") * 30_000)
    )


@query("st4_late_events", _with(LOG, _LATE) + """
SELECT id, subject_id, lateness_ms, CAST(is_late AS BIGINT) AS is_late FROM lt""")
def late_events(spark, sf):
    return late.flag_late(ingested(spark, sf), 20).select("id", "subject_id", "lateness_ms", "is_late")


@query("st4_stale_ranges", _with(LOG, _LATE) + """
SELECT subject_id, strftime(make_timestamp(ms*1000), '%Y-%m-%d') AS day, min(ms) AS stale_from, max(ms) + 86400000 AS stale_until,
  CAST(count(*) AS BIGINT) AS n_late FROM lt WHERE is_late GROUP BY 1, 2""")
def stale_ranges(spark, sf):
    return late.stale_ranges(late.flag_late(ingested(spark, sf), 20).filter("is_late"))


@query("st7_live_day_totals", _with(LOG) + f"""
SELECT subject_id, strftime(make_timestamp(ms*1000), '%Y-%m-%d') AS day,
  {r6("coalesce(sum(value) FILTER (event_type='insulin'),0)")} AS total_insulin, {r6("coalesce(sum(value) FILTER (event_type='meal'),0)")} AS total_carbs,
  {r6("avg(value) FILTER (event_type='bsl')")} AS avg_bsl, CAST(count(*) AS BIGINT) AS event_count FROM log GROUP BY 1, 2""")
def live_day_totals(spark, sf):
    return windows.day_totals(event_log(spark, sf))


@query("st8_sessions", f"""
WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value FROM events),
f AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < 7200000 THEN 0 ELSE 1 END AS o FROM e),
g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS s FROM f)
SELECT user_id, CAST(s AS BIGINT) AS session_no, min(ms) AS session_start, max(ms) AS session_last, CAST(count(*) AS BIGINT) AS n_events,
  {r6('sum(value)')} AS total_value FROM g GROUP BY user_id, s""")
def session_runs(spark, sf):
    """Runs of events per user with less than two hours in between."""
    rows = table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return sessions(rows, ["user_id"], "ts", 120, {"total_value": F.col("value")})
