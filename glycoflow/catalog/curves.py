"""Traced curves over data derived from the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from glycoflow.catalog.adapter import LOG, SPAN, event_log, event_rows, log_span
from glycoflow.catalog.logs import _with
from glycoflow.catalog.registry import query, r6
from glycoflow.operators import curves
from glycoflow.operators.log import mean_confidence

def series():
    """One series per subject and day."""
    return (F.col("subject_id") * 1_000_000 + F.expr("unix_millis(ts) div 86400000")).alias("series_id")


# Pixels: x is the quarter of an hour times four plus a little, y a scaled value.
PIXELS = """
px AS (SELECT user_id * 1000000 + epoch_us(ts) // 86400000000 AS series_id, (epoch_us(ts) // 60000000 % 1440) // 4 AS x,
    CAST(floor(value) AS BIGINT) % 200 + 60 AS y, event_id AS pos FROM events),
med AS (SELECT series_id, x, CAST(list_sort(list(y))[CAST(count(*) // 2 AS BIGINT) + 1] AS DOUBLE) AS y FROM px GROUP BY ALL)
"""


def pixels(spark, sf):
    ms = F.unix_millis("ts")
    return event_rows(spark, sf).select(
        series(),
        F.floor((ms / 60000.0) % 1440 / 4).alias("x"),
        (F.pmod(F.floor("value"), F.lit(200)) + 60).alias("y"),
        F.col("event_id").alias("pos"),
    )


@query("a19_column_medians", _with(PIXELS) + f"SELECT series_id, x, {r6('y')} AS y FROM med")
def column_medians(spark, sf):
    return curves.column_medians(pixels(spark, sf))


@query("w1_moving_average", _with(PIXELS) + f"""
SELECT series_id, x, {r6('avg(y) OVER (PARTITION BY series_id ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS y FROM med""")
def moving_average(spark, sf):
    return curves.smooth_mean(curves.column_medians(pixels(spark, sf)))


_W = {k: 1.0 / (1.0 + abs(k) * 0.5) for k in range(-3, 4)}
_SUM = " + ".join(f"coalesce(lag(y, {-k}) OVER w * {w!r}::DOUBLE, 0)" for k, w in _W.items())
_WSUM = " + ".join(f"CASE WHEN lag(y, {-k}) OVER w IS NULL THEN 0 ELSE {w!r}::DOUBLE END" for k, w in _W.items())


@query("w2_weighted_average", _with(PIXELS) + f"""
SELECT series_id, x, {r6(f'({_SUM}) / ({_WSUM})')} AS y FROM med WINDOW w AS (PARTITION BY series_id ORDER BY x)""")
def weighted_average(spark, sf):
    return curves.smooth_weighted(curves.column_medians(pixels(spark, sf)))


@query("a21_average_by_x", _with(PIXELS) + f"SELECT series_id, x, {r6('avg(y)')} AS y FROM px GROUP BY ALL")
def average_by_x(spark, sf):
    return curves.average_by_x(pixels(spark, sf))


@query("w5_smooth_to_24", _with(PIXELS) + f"""
SELECT series_id, CAST(i AS BIGINT) AS position, {r6('avg(x)')} AS x, {r6('avg(y)')} AS y FROM (
  SELECT a.series_id, i, x, y FROM
    (SELECT series_id, i, greatest(0, floor(i/24.0::DOUBLE*n) - floor(wd/2)) AS f, least(n, floor(i/24.0::DOUBLE*n) + ceil(wd/2)) AS t
     FROM (SELECT series_id, n, greatest(3, n // 24) AS wd FROM (SELECT series_id, count(*) AS n, sum(c) AS raw FROM (SELECT series_id, x, count(*) AS c FROM px GROUP BY ALL) GROUP BY series_id) WHERE n >= 4 AND raw >= 4),
       (SELECT unnest(range(24)) AS i)) s
    JOIN (SELECT series_id, x, avg(y) AS y, row_number() OVER (PARTITION BY series_id ORDER BY x) - 1 AS j FROM px GROUP BY series_id, x) a
      ON a.series_id = s.series_id AND a.j >= s.f AND a.j < s.t) GROUP BY series_id, i
UNION ALL SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY x, y) - 1, {r6('x')}, {r6('y')} FROM (
  SELECT p.series_id, x, y::DOUBLE AS y FROM px p JOIN (SELECT series_id FROM px GROUP BY series_id HAVING count(*) < 4) f ON f.series_id = p.series_id
  UNION ALL SELECT p.series_id, x, avg(y) FROM px p JOIN (SELECT series_id FROM px GROUP BY series_id HAVING count(*) >= 4 AND count(DISTINCT x) < 4) f
    ON f.series_id = p.series_id GROUP BY p.series_id, x)""")
def smooth_to_24(spark, sf):
    return curves.smooth_to(pixels(spark, sf), 24)


@query("r4_uniform_resample", _with(PIXELS) + f"""
, kn AS (SELECT series_id, x, arg_min(y, pos) AS yf, arg_max(y, pos) AS yl, count(*) AS c FROM px GROUP BY ALL),
en AS (SELECT series_id, min(x) AS x0, max(x) AS x1, arg_min(yf, x) AS ys, arg_max(yl, x) AS ye FROM kn GROUP BY series_id HAVING sum(c) >= 2),
tg AS (SELECT *, x0 + i*((x1 - x0)/49.0::DOUBLE) AS tx FROM en, (SELECT unnest(range(50)) AS i)),
br AS (SELECT t.series_id, t.i, t.tx, t.x0, t.x1, t.ys, t.ye, max(k.x) FILTER (k.x < t.tx) AS lx, arg_max(k.yl, k.x) FILTER (k.x < t.tx) AS ly,
    min(k.x) FILTER (k.x >= t.tx) AS rx, arg_min(k.yf, k.x) FILTER (k.x >= t.tx) AS ry FROM tg t JOIN kn k ON k.series_id = t.series_id GROUP BY ALL)
SELECT series_id, CAST(i AS BIGINT) AS position, {r6('tx')} AS x,
  {r6('CASE WHEN lx IS NULL THEN ys WHEN rx IS NULL THEN ys + (tx - x0)/(x1 - x0)*(ye - ys) ELSE ly + (tx - lx)/(rx - lx)*(ry - ly) END::DOUBLE')} AS y FROM br
UNION ALL SELECT series_id, 0, {r6('any_value(x)')}, {r6('any_value(y)')} FROM px GROUP BY series_id HAVING count(*) = 1""")
def uniform_resample(spark, sf):
    return curves.resample_uniform(pixels(spark, sf), 50)


# -- scaling -------------------------------------------------------------------------------

AXIS = """
ax AS (SELECT DISTINCT series_id, lo AS start_ms, lo + 86400000 AS end_ms FROM (
  SELECT user_id * 1000000 + epoch_us(ts) // 86400000000 AS series_id, epoch_us(ts) // 86400000000 * 86400000 AS lo FROM events))
"""


def day_axis(spark, sf):
    day = F.date_trunc("DAY", F.col("ts"))
    return (
        event_rows(spark, sf)
        .select(
            series(),
            day.alias("start_ts"),
        )
        .distinct()
        .select(
            "series_id",
            "start_ts",
            (F.col("start_ts") + F.expr("INTERVAL 1 DAY")).alias("end_ts"),
            F.lit(2.2).alias("bsl_min"), F.lit(13.3).alias("bsl_max"),
            F.lit(10.0).alias("region_x"), F.lit(20.0).alias("region_y"),
            F.lit(80.0).alias("region_width"), F.lit(70.0).alias("region_height"),
            F.lit(400).alias("image_w"), F.lit(300).alias("image_h"),
        )
    )


def _scaled_sql(digits: int, confidence: float) -> str:
    k = 10**digits
    return f"""
SELECT series_id, CAST(trunc(start_ms + (x - 40)/320.0::DOUBLE*86400000) AS BIGINT) AS ts, {r6(f'floor(v*{k}.0+0.5)/{k}.0')} AS value, {r6(str(confidence))} AS confidence
FROM (SELECT m.series_id, x, start_ms, 2.2::DOUBLE + (1.0::DOUBLE - (y - 60)/210.0::DOUBLE)*(13.3::DOUBLE - 2.2::DOUBLE) AS v FROM
  (SELECT series_id, x, avg(y) OVER (PARTITION BY series_id ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS y FROM med WHERE x >= 40 AND x < 360) m
  JOIN ax ON ax.series_id = m.series_id) WHERE v BETWEEN 2.2::DOUBLE AND 13.3::DOUBLE"""


def traced_values(spark, sf, device):
    traced = curves.smooth_mean(curves.column_medians(pixels(spark, sf), 40, 360))
    return curves.to_values(traced, day_axis(spark, sf), device)


@query("p13_curve_to_values_libre", _with(PIXELS, AXIS) + _scaled_sql(1, 0.85))
def curve_to_values_libre(spark, sf):
    return traced_values(spark, sf, "freestyle-libre")


@query("p13_curve_to_values_dexcom", _with(PIXELS, AXIS) + _scaled_sql(0, 0.82))
def curve_to_values_dexcom(spark, sf):
    return traced_values(spark, sf, "dexcom")


@query("p14_points_from_minutes", _with(PIXELS, AXIS) + f"""
SELECT p.series_id, start_ms + x*60000 + 30000 AS ts, {r6('y/20.0')} AS value, {r6('CASE WHEN y/20.0 BETWEEN 2.2 AND 13.3 THEN 0.9 ELSE 0.5 END::DOUBLE')} AS confidence,
  end_ms AS axis_end FROM px p JOIN ax ON ax.series_id = p.series_id""")
def points_from_minutes(spark, sf):
    points = pixels(spark, sf).select(
        "series_id", (F.col("x") + 0.5).alias("minutes_from_start"), (F.col("y") / 20.0).alias("value")
    )
    axis = day_axis(spark, sf)
    late = axis.select("series_id", curves.overnight_end(F.col("start_ts"), F.col("start_ts")).alias("axis_end"))
    return curves.from_minutes(points, axis).join(late, "series_id")


@query("p15_default_axis", _with(PIXELS, SPAN) + f"""
SELECT series_id, n_points, hi - h*3600000::BIGINT AS start_ts, hi AS end_ts, {r6("CASE device WHEN 'freestyle-libre' THEN 2.2 WHEN 'dexcom' THEN 40.0 ELSE 2.0 END::DOUBLE")} AS bsl_min,
  {r6("CASE device WHEN 'freestyle-libre' THEN 13.3 WHEN 'dexcom' THEN 400.0 ELSE 15.0 END::DOUBLE")} AS bsl_max, CASE device WHEN 'dexcom' THEN 'mg/dL' ELSE 'mmol/L' END AS unit
FROM (SELECT *, CASE device WHEN 'dexcom' THEN CASE WHEN n_points < 50 THEN 3 WHEN n_points < 100 THEN 6 WHEN n_points < 200 THEN 12 ELSE 24 END
    WHEN 'freestyle-libre' THEN CASE WHEN n_points < 100 THEN 8 WHEN n_points < 200 THEN 12 ELSE 24 END ELSE 8 END AS h
  FROM (SELECT series_id, CASE series_id % 3 WHEN 0 THEN 'freestyle-libre' WHEN 1 THEN 'dexcom' ELSE 'generic' END AS device,
      CAST(count(*) AS BIGINT) AS n_points FROM px GROUP BY series_id)), span""")
def default_axis(spark, sf):
    _, end = log_span(spark, sf)
    style = F.col("series_id") % 3
    device = (
        F.when(style == 0, F.lit("freestyle-libre")).when(style == 1, F.lit("dexcom")).otherwise(F.lit("generic"))
    )
    return curves.default_axis(pixels(spark, sf).withColumn("device", device), end)


@query("p15_given_axis", _with(PIXELS, SPAN) + f"""
SELECT series_id, CASE WHEN series_id % 2 = 0 THEN lo ELSE hi - h*3600000::BIGINT END AS start_ts, hi AS end_ts,
  {r6("CASE WHEN series_id % 5 = 0 THEN 1.5 WHEN dexcom THEN 40.0 ELSE 2.2 END::DOUBLE")} AS bsl_min,
  {r6("CASE WHEN dexcom THEN 400.0 ELSE 13.3 END::DOUBLE")} AS bsl_max, CASE WHEN dexcom THEN 'mg/dL' ELSE 'mmol/L' END AS unit
FROM (SELECT *, CASE WHEN dexcom THEN CASE WHEN n < 50 THEN 3 WHEN n < 100 THEN 6 WHEN n < 200 THEN 12 ELSE 24 END
    ELSE CASE WHEN n < 100 THEN 8 WHEN n < 200 THEN 12 ELSE 24 END END AS h
  FROM (SELECT series_id, series_id % 3 = 1 AS dexcom, count(*) AS n FROM px GROUP BY series_id)), span""")
def given_axis(spark, sf):
    """Even series have their start given and every fifth its lower bound; the rest is guessed."""
    start, end = log_span(spark, sf)
    named = F.when(F.col("series_id") % 3 == 1, F.lit("dexcom")).otherwise(F.lit("freestyle-libre"))
    traced = pixels(spark, sf).withColumn("device", named)
    given = traced.select("series_id").distinct().select(
        "series_id",
        F.when(F.col("series_id") % 2 == 0, F.lit(start).cast("timestamp")).alias("start_ts"),
        F.when(F.col("series_id") % 5 == 0, F.lit(1.5)).alias("bsl_min"),
    )
    return curves.given_or_default(given, curves.default_axis(traced, end))


# -- resampling ----------------------------------------------------------------------------

POINTS = """
pt0 AS (SELECT subject_id*1000000 + ms // 86400000 AS series_id, event_id AS pos, ms, value, 0.5::DOUBLE + (k % 50)/100.0::DOUBLE AS conf FROM log WHERE event_type = 'bsl'),
cnt AS (SELECT series_id, count(*) AS n FROM pt0 GROUP BY series_id),
pt AS (SELECT series_id, ms, arg_min(value, pos) AS value, arg_min(conf, pos) AS conf FROM pt0 GROUP BY ALL),
gr AS (SELECT ax.series_id, n, start_ms + i*300000 AS t FROM ax JOIN cnt ON cnt.series_id = ax.series_id, (SELECT unnest(range(289)) AS i)),
br0 AS (SELECT g.series_id, g.n, g.t, b.ms AS bm, b.value AS bv, b.conf AS bc FROM gr g ASOF LEFT JOIN pt b ON b.series_id = g.series_id AND b.ms <= g.t),
br AS (SELECT g.*, a.ms AS am, a.value AS av, a.conf AS ac FROM br0 g ASOF LEFT JOIN pt a ON a.series_id = g.series_id AND a.ms >= g.t)
"""
SINGLE = f"UNION ALL SELECT pt0.series_id, ms, {r6('value')}, {r6('conf')} FROM pt0 JOIN cnt ON cnt.series_id = pt0.series_id WHERE n < 2"
_LINE = "CASE WHEN bm = am THEN bv ELSE bv + ((t - bm)/(am - bm))*(av - bv) END"


def curve_points(spark, sf):
    return (
        event_log(spark, sf, ["bsl"], keep=("event_id", "k"))
        .select(
            series(),
            F.col("event_id").alias("pos"),
            "ts",
            "value",
            (F.lit(0.5) + (F.col("k") % 50) / 100.0).alias("confidence"),
        )
    )


def _linear_sql(digits: int) -> str:
    k = 10**digits
    return f"""
SELECT series_id, t AS ts, {r6(f'floor(({_LINE})*{k}.0+0.5)/{k}.0')} AS value, {r6('CASE WHEN bm = am THEN bc ELSE least(bc, ac) END')} AS confidence
FROM br WHERE n >= 2 AND bm IS NOT NULL AND am IS NOT NULL {SINGLE}"""


@query("j10_bracket_join", _with(LOG, AXIS, POINTS) + "SELECT series_id, t AS at_ms, bm AS before_ms, am AS after_ms FROM br")
def bracket_join(spark, sf):
    out = curves.bracket(curve_points(spark, sf), day_axis(spark, sf))
    return out.select(
        "series_id", "at_ms", F.col("before.ms").alias("before_ms"), F.col("after.ms").alias("after_ms")
    )


@query("r1_resample_model", _with(LOG, AXIS, POINTS) + f"""
SELECT series_id, t AS ts, {r6(f'CASE WHEN am IS NULL THEN bv ELSE floor(({_LINE})*10.0+0.5)/10.0 END')} AS value,
  {r6('CASE WHEN am IS NULL THEN bc*0.8::DOUBLE WHEN bm = am THEN bc ELSE least(bc, ac)*(1 - 0.1::DOUBLE*((t - bm)/(am - bm))) END')} AS confidence
FROM br WHERE n >= 2 AND bm IS NOT NULL {SINGLE}""")
def resample_model(spark, sf):
    return curves.resample(curve_points(spark, sf), day_axis(spark, sf), 5, "model")


@query("r2_resample_libre", _with(LOG, AXIS, POINTS) + _linear_sql(1))
def resample_libre(spark, sf):
    return curves.resample(curve_points(spark, sf), day_axis(spark, sf), 5, "freestyle-libre")


@query("r2_resample_dexcom", _with(LOG, AXIS, POINTS) + _linear_sql(0))
def resample_dexcom(spark, sf):
    return curves.resample(curve_points(spark, sf), day_axis(spark, sf), 5, "dexcom")


@query("r3_resample_nearest", _with(LOG, AXIS, POINTS) + f"""
SELECT series_id, t AS ts, {r6('v')} AS value, {r6('c*(1 - dist/600000.0::DOUBLE)')} AS confidence FROM (
  SELECT *, CASE WHEN bm IS NULL OR am - t < t - bm THEN av ELSE bv END AS v, CASE WHEN bm IS NULL OR am - t < t - bm THEN ac ELSE bc END AS c,
    CASE WHEN bm IS NULL OR am - t < t - bm THEN am - t ELSE t - bm END AS dist FROM br WHERE n >= 2) WHERE dist < 600000 {SINGLE}""")
def resample_nearest(spark, sf):
    return curves.resample(curve_points(spark, sf), day_axis(spark, sf), 5, "nearest")


@query("a4_mean_confidence", _with(LOG, AXIS, POINTS) + """
SELECT series_id, CAST(floor(avg(conf)*100.0::DOUBLE+0.5) AS BIGINT) AS avg_confidence_pct FROM pt0 GROUP BY series_id""")
def mean_confidence_of_series(spark, sf):
    return mean_confidence(curve_points(spark, sf), ["series_id"])
