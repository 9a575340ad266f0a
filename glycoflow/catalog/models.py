"""Time series and scoring over the log."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.catalog.adapter import (
    LOG, SPAN, event_log, log_grid, log_span, subjects, table,
)
from glycoflow.catalog.kernels import (
    A_ABSORBING, A_SENS, A_SYSTEM, BASAL_ACT, BASAL_IOB, BOLUS_ACT, BOLUS_IOB, CARB_LEFT,
    CARB_PARAMS, CARB_RATE, CIRC, DRINK_PARAMS, _with, circ_sql, drift_sql, gi_sql,
)
from glycoflow.catalog.registry import query, r6
from glycoflow.functions import carbs as carb_fn
from glycoflow.functions import circadian, insulin
from glycoflow.operators import dimensions
from glycoflow.operators.ordered import asof_join
from glycoflow.plans import dose, predict, state, tuning

GRID = """
grid AS (SELECT subject_id, lo + i*300000 AS t FROM (SELECT DISTINCT subject_id FROM log), span,
  (SELECT unnest(range(0, 100000)) AS i) WHERE lo + i*300000 <= hi)
"""
# Events a run over [lo, hi] may see.
SEEN = """
seen AS (SELECT log.* FROM log, span WHERE ms <= hi AND (
  (event_type = 'insulin' AND ms >= lo - 24*3600000) OR
  (event_type = 'meal' AND ms >= lo - 6*3600000) OR (event_type = 'bsl' AND ms >= lo - 12*3600000)))
"""
INS = f"""
ins AS (SELECT subject_id, id, t, value * iob AS iob, act * (value/(dur/60.0)) * 2 AS rate,
    ms + CAST(dur*60000 AS BIGINT) AS clear_ms
  FROM (SELECT *, CASE WHEN itype = 'basal' THEN {BASAL_IOB} ELSE {BOLUS_IOB} END AS iob,
               CASE WHEN itype = 'basal' THEN {BASAL_ACT} ELSE {BOLUS_ACT} END AS act
    FROM (SELECT s.*, t, (t - ms)/60000.0::DOUBLE AS m FROM
      (SELECT *, CASE WHEN itype = 'basal' THEN 1440.0 ELSE 240.0 END::DOUBLE AS dur FROM seen WHERE event_type = 'insulin') s
      JOIN grid g ON g.subject_id = s.subject_id AND t >= ms AND t < ms + 86400000))
  WHERE m < dur)
"""
CARB = f"""
food AS (SELECT *, dur/3 AS hl FROM (SELECT *, {CARB_PARAMS} FROM (
    SELECT subject_id, id, ms, coalesce(carbs, value) AS c, {gi_sql('descr')} AS gi
    FROM seen WHERE event_type = 'meal') WHERE c > 0)),
carb AS (SELECT subject_id, id, t, {CARB_LEFT} AS cob, {CARB_RATE} AS rate,
    CAST(trunc(ms + dur*60000.0::DOUBLE) AS BIGINT) AS done_ms
  FROM (SELECT f.*, t, (t - ms)/60000.0::DOUBLE AS m FROM food f
    JOIN grid g ON g.subject_id = f.subject_id AND t >= ms AND t <= ms + 18000000) WHERE m < dur)
"""
DRINK = f"""
sip AS (SELECT *, greatest(eff, u*10.0/(8.0::DOUBLE)*60.0) AS dur, 70.0::DOUBLE AS kg FROM (
    SELECT *, {DRINK_PARAMS} FROM (SELECT subject_id, id, ms, aunits AS u, coalesce(nullif(atype,''),'mixed') AS t
      FROM seen WHERE event_type = 'meal' AND aunits > 0))),
alc AS (SELECT subject_id, id, gt AS t, {A_ABSORBING} AS absorbing, {A_SYSTEM} AS in_system, {A_SENS} AS md2,
    CAST(trunc(ms + dur*60000.0::DOUBLE) AS BIGINT) AS sober_ms
  FROM (SELECT s.*, g.t AS gt, (g.t - ms)/60000.0::DOUBLE AS m FROM sip s
    JOIN grid g ON g.subject_id = s.subject_id AND g.t >= ms AND g.t <= ms + CAST(dur*60000 AS BIGINT)) WHERE m < dur)
"""
_G = circ_sql("t//3600000%24", "(t//60000%60)")
STATE = f"""
ia AS (SELECT subject_id, t, sum(iob) AS iob, sum(rate) AS arate, max(clear_ms) AS clear_ms FROM ins GROUP BY ALL),
ca AS (SELECT subject_id, t, sum(cob) AS cob, sum(rate) AS crate, max(done_ms) AS done_ms FROM carb GROUP BY ALL),
aa AS (SELECT subject_id, t, sum(absorbing) AS absorbing, sum(in_system) AS in_system, product(md2) AS md,
         max(sober_ms) AS sober_ms FROM alc GROUP BY ALL),
rd AS (SELECT subject_id, ms, arg_max(value, id) AS value, arg_max(coalesce(source, 'manual'), id) AS source FROM seen WHERE event_type = 'bsl' GROUP BY ALL),
st AS (SELECT g.subject_id, g.t, coalesce(iob, 0) AS iob, coalesce(arate, 0) AS arate,
    greatest(coalesce(clear_ms, g.t), g.t) AS clear_ms, coalesce(cob, 0) AS cob, coalesce(crate, 0) AS crate,
    greatest(coalesce(done_ms, g.t), g.t) AS done_ms, coalesce(absorbing, 0) AS absorbing,
    coalesce(in_system, 0) AS in_system, coalesce(md, 1) AS md, sober_ms, rd.value AS last_bsl, rd.ms AS last_ms, rd.source AS last_source,
    {_G['combined_factor'].replace('t//', 'g.t//')} AS cf, {_G['insulin_sensitivity'].replace('t//', 'g.t//')} AS se,
    {_G['dawn_effect'].replace('t//', 'g.t//')} AS de, b, d
  FROM grid g CROSS JOIN circ LEFT JOIN ia ON ia.subject_id = g.subject_id AND ia.t = g.t
  LEFT JOIN ca ON ca.subject_id = g.subject_id AND ca.t = g.t
  LEFT JOIN aa ON aa.subject_id = g.subject_id AND aa.t = g.t
  ASOF LEFT JOIN rd ON rd.subject_id = g.subject_id AND rd.ms <= g.t)
"""
SERIES = f"""
fx AS (SELECT *, -(iob*2.0)*md AS e1, cob/10.0*2.0/cf AS e2, CASE WHEN in_system > 0 THEN in_system*-0.05::DOUBLE ELSE 0 END AS e3,
    {drift_sql('coalesce(last_ms, lo)', 't')} AS e4, CASE WHEN iob < 0.5 THEN 0.1 ELSE 0 END::DOUBLE AS e5,
    least(0.5::DOUBLE + (t - coalesce(last_ms, lo))/60000.0::DOUBLE*0.02::DOUBLE + CASE WHEN in_system > 0 THEN 0.3 ELSE 0 END::DOUBLE
      + CASE WHEN last_bsl IS NULL THEN 1.0 ELSE 0 END::DOUBLE, 5.0) AS u FROM st, span),
pr AS (SELECT *, greatest(2.0::DOUBLE, coalesce(last_bsl, 6.0::DOUBLE) + (e1 + e2 + e3 + e4 + e5)) AS p FROM fx),
series AS (SELECT *, greatest(2.0::DOUBLE, p - u) AS lower_b, p + u AS upper_b, greatest(0.2::DOUBLE, 1 - u/5.0) AS conf FROM pr)
"""
FULL = [LOG, SPAN, GRID, SEEN, CIRC, INS, CARB, DRINK, STATE]


#: Types that the model looks at; named to the scan, as a filter on types worked out later is not pushed down.
MODELLED = ["bsl", "meal", "insulin"]


@query("a10_insulin_on_board", _with(LOG, SPAN, GRID, SEEN, INS) + f"""
SELECT subject_id, t AS at_ts, {r6('coalesce(sum(iob),0)')} AS iob, {r6('coalesce(sum(rate),0)')} AS activity_rate,
  greatest(coalesce(max(clear_ms), t), t) AS clear_ms, CAST(count(id) AS BIGINT) AS active_doses
FROM (SELECT g.subject_id, g.t, id, iob, rate, clear_ms FROM grid g LEFT JOIN ins i ON i.subject_id = g.subject_id AND i.t = g.t)
GROUP BY subject_id, t""")
def insulin_on_board(spark, sf):
    log = event_log(spark, sf, ["insulin"])
    return state.insulin_on_board(log, log_grid(spark, sf), subjects(event_log(spark, sf)))


@query("a11_carbs_on_board", _with(LOG, SPAN, GRID, SEEN, CARB) + f"""
SELECT subject_id, t AS at_ts, {r6('coalesce(sum(cob),0)')} AS cob, {r6('coalesce(sum(rate),0)')} AS absorption_rate,
  greatest(coalesce(max(done_ms), t), t) AS carbs_done_ms, CAST(count(id) AS BIGINT) AS active_meals
FROM (SELECT g.subject_id, g.t, id, cob, rate, done_ms FROM grid g LEFT JOIN carb i ON i.subject_id = g.subject_id AND i.t = g.t)
GROUP BY subject_id, t""")
def carbs_on_board(spark, sf):
    log = event_log(spark, sf, ["meal"])
    return state.carbs_on_board(log, log_grid(spark, sf), subjects(event_log(spark, sf)))


@query("a12_blood_alcohol", _with(LOG, SPAN, GRID, SEEN, DRINK) + f"""
SELECT subject_id, t AS at_ts, {r6('coalesce(sum(absorbing),0)')} AS alcohol_absorbing,
  {r6('coalesce(sum(in_system),0)')} AS alcohol_in_system, {r6('coalesce(product(md2),1)')} AS sensitivity_modifier,
  {r6('greatest(0.0::DOUBLE, coalesce(sum(in_system),0)/(70.0::DOUBLE*0.6::DOUBLE)*10.0)')} AS blood_alcohol,
  max(sober_ms) AS sober_ms, CAST(count(id) AS BIGINT) AS active_drinks
FROM (SELECT g.subject_id, g.t, id, absorbing, in_system, md2, sober_ms FROM grid g LEFT JOIN alc i ON i.subject_id = g.subject_id AND i.t = g.t)
GROUP BY subject_id, t""")
def blood_alcohol(spark, sf):
    log = event_log(spark, sf, ["meal"])
    return state.blood_alcohol(log, log_grid(spark, sf), subjects(event_log(spark, sf)))


@query("j4_insulin_contributions", _with(LOG, SPAN, GRID, SEEN, INS) + f"""
SELECT subject_id, t AS at_ts, id AS dose_id, {r6('iob')} AS iob FROM ins""")
def insulin_contributions(spark, sf):
    grid = log_grid(spark, sf)
    return state.contributions(event_log(spark, sf, ["insulin"]), grid, "dose").select(
        "subject_id",
        F.timestamp_millis(grid.at_ms(F.col("idx"))).alias("at_ts"),
        F.col("id").alias("dose_id"),
        "iob",
    )


@query("j6_asof_last_reading", _with(LOG) + f"""
SELECT m.subject_id, m.id, m.ms AS ts, {r6('r.value')} AS last_bsl, r.ms AS last_ts, r.source AS last_source
FROM (SELECT * FROM log WHERE event_type <> 'bsl') m
ASOF LEFT JOIN (SELECT subject_id, ms, arg_max(value, id) AS value, arg_max(source, id) AS source
  FROM log WHERE event_type = 'bsl' GROUP BY subject_id, ms) r
ON r.subject_id = m.subject_id AND r.ms <= m.ms""")
def asof_last_reading(spark, sf):
    """The glucose last known at every meal, dose and exercise."""
    log = event_log(spark, sf)
    readings = log.filter(F.col("event_type") == "bsl").select(
        "subject_id", F.col("id").alias("tie"), F.col("ts").alias("last_ts"),
        F.col("value").alias("last_bsl"), F.col("meta.source").alias("last_source"),
    )
    others = log.filter(F.col("event_type") != "bsl").select("subject_id", "id", "ts")
    return asof_join(
        others, readings, ["subject_id"], F.col("ts"), "last_ts",
        ["last_bsl", "last_ts", "last_source"], "tie",
    )


# The parameters once more, so that a slip in the engine's own tables shows.
DIMENSIONS = """
ik(insulin_type, onset_minutes, peak_minutes, duration_minutes, half_life_minutes) AS (
  VALUES ('bolus', 15.0, 75.0, 240.0, 55.0), ('basal', 90.0, 360.0, 1440.0, 300.0)),
dk(drink_type, absorption_half_life, lowest_modifier, effect_hours) AS (
  VALUES ('beer', 20.0, 0.85, 12.0), ('wine', 25.0, 0.8, 14.0), ('spirit', 15.0, 0.75, 16.0), ('mixed', 25.0, 0.8, 12.0)),
ch(hour, base_factor, dawn_effect, overnight_weight) AS (
  VALUES (0, 0.95, 0.0, 0.0), (1, 0.9, 0.0, 0.0), (2, 0.85, 0.0, 0.0), (3, 0.85, 0.2, 0.0), (4, 0.9, 0.5, 0.15), (5, 1.0, 0.8, 0.2),
         (6, 1.15, 1.0, 0.25), (7, 1.2, 0.8, 0.2), (8, 1.15, 0.4, 0.1), (9, 1.1, 0.1, 0.0), (10, 1.0, 0.0, 0.0), (11, 1.0, 0.0, 0.0),
         (12, 1.05, 0.0, 0.0), (13, 1.0, 0.0, 0.0), (14, 0.95, 0.0, 0.0), (15, 0.95, 0.0, 0.0), (16, 1.0, 0.0, 0.0), (17, 1.05, 0.0, 0.0),
         (18, 1.1, 0.0, 0.0), (19, 1.05, 0.0, 0.0), (20, 1.0, 0.0, 0.0), (21, 0.95, 0.0, 0.0), (22, 0.9, 0.0, 0.0), (23, 0.95, 0.0, 0.0))
"""


@query("j11_event_parameters", _with(LOG, DIMENSIONS) + """
SELECT id, insulin_type, onset_minutes::DOUBLE AS onset_minutes, peak_minutes::DOUBLE AS peak_minutes, duration_minutes::DOUBLE AS duration_minutes,
  half_life_minutes::DOUBLE AS half_life_minutes, drink_type, absorption_half_life::DOUBLE AS absorption_half_life,
  lowest_modifier::DOUBLE AS lowest_modifier, effect_hours::DOUBLE AS effect_hours, base_factor::DOUBLE AS base_factor,
  dawn_effect::DOUBLE AS dawn_effect, overnight_weight::DOUBLE AS overnight_weight
FROM log LEFT JOIN ik ON event_type = 'insulin' AND insulin_type = itype LEFT JOIN dk ON aunits > 0 AND drink_type = atype
JOIN ch ON hour = ms // 3600000 % 24""")
def event_parameters(spark, sf):
    return dimensions.with_dimensions(event_log(spark, sf)).select(
        "id", "insulin_type", "onset_minutes", "peak_minutes", "duration_minutes", "half_life_minutes", "drink_type",
        "absorption_half_life", "lowest_modifier", "effect_hours", "base_factor", "dawn_effect", "overnight_weight",
    )


@query("m1_metabolic_state", _with(*FULL) + f"""
SELECT subject_id, t AS at_ts, {r6('iob')} AS iob, {r6('arate')} AS activity_rate, clear_ms,
  {r6('cob')} AS cob, {r6('crate')} AS absorption_rate, done_ms AS carbs_done_ms, {r6('absorbing')} AS alcohol_absorbing,
  {r6('in_system')} AS alcohol_in_system, {r6('md')} AS sensitivity_modifier,
  {r6('greatest(0.0::DOUBLE, in_system/(70.0::DOUBLE*0.6::DOUBLE)*10.0)')} AS blood_alcohol, sober_ms,
  CAST(t//3600000%24 AS BIGINT) AS hour, {r6('se')} AS insulin_sensitivity, {r6('de')} AS dawn_effect,
  {r6('cf')} AS combined_factor, {r6('last_bsl')} AS last_bsl, last_ms AS last_bsl_ms, last_source AS last_bsl_source FROM st""")
def metabolic_state(spark, sf):
    log = event_log(spark, sf, MODELLED)
    out = state.metabolic_state(log, log_grid(spark, sf), subjects(event_log(spark, sf)))
    return out.drop("idx", *values.USER_DEFAULTS)


@query("m2_prediction_factors", _with(*FULL, SERIES) + f"""
SELECT subject_id, t AS at_ts, {r6('e1')} AS insulin_effect, {r6('e2')} AS carb_effect, {r6('e3')} AS alcohol_effect,
  {r6('e4')} AS circadian_adjustment, {r6('e5')} AS baseline_drift FROM series""")
def prediction_factors(spark, sf):
    log, grid = event_log(spark, sf, MODELLED), log_grid(spark, sf)
    known = state.metabolic_state(log, grid, subjects(event_log(spark, sf)))
    return predict.prediction_factors(known, grid.start).select(
        "subject_id", "at_ts", "insulin_effect", "carb_effect", "alcohol_effect",
        "circadian_adjustment", "baseline_drift",
    )


SERIES_OUT = f"""
SELECT subject_id, t AS at_ts, {r6('coalesce(last_bsl, 6.0)')} AS current_bsl, {r6('p')} AS predicted_bsl,
  {r6('lower_b')} AS lower_bound, {r6('upper_b')} AS upper_bound, {r6('conf')} AS confidence,
  {r6('iob')} AS iob, {r6('cob')} AS cob, {r6('in_system')} AS alcohol_in_system FROM series"""
SERIES_COLUMNS = [
    "subject_id", "at_ts", "current_bsl", "predicted_bsl", "lower_bound", "upper_bound",
    "confidence", "iob", "cob", "alcohol_in_system",
]


@query("m4_glucose_series", _with(*FULL, SERIES) + SERIES_OUT)
def glucose_series(spark, sf):
    log, grid = event_log(spark, sf, MODELLED), log_grid(spark, sf)
    return predict.glucose_series(log, grid, subjects(event_log(spark, sf)), grid.start).select(*SERIES_COLUMNS)




@query("m3_predict_at_instant", _with(
    LOG, SPAN.replace("span AS", "whole AS"),
    "span AS (SELECT lo + 7*86400000 AS lo, lo + 7*86400000 AS hi FROM whole)",
    GRID, SEEN, CIRC, INS, CARB, DRINK, STATE, SERIES) + SERIES_OUT)
def predict_at_instant(spark, sf):
    from glycoflow.operators.grid import Grid

    log = event_log(spark, sf, MODELLED)
    start, _ = log_span(spark, sf)
    moment = start + timedelta(days=7)
    return predict.glucose_series(log, Grid(moment, moment), subjects(event_log(spark, sf)), moment).select(
        *SERIES_COLUMNS
    )


ALERTS = """
al AS (SELECT subject_id, t, 0 AS kind_no, 'hypo' AS kind, p, u, lower_b, upper_b,
    CASE WHEN p < 3.5 THEN 'urgent' WHEN p < 4 THEN 'alert' ELSE 'warning' END AS severity FROM series WHERE lower_b < 4
  UNION ALL SELECT subject_id, t, 1, 'hyper', p, u, lower_b, upper_b,
    CASE WHEN p > 15 THEN 'urgent' WHEN p > 10 THEN 'alert' ELSE 'warning' END FROM series WHERE upper_b > 10),
al2 AS (SELECT *, lag(kind) OVER w AS k0, lag(t) OVER w AS t0 FROM al
  WINDOW w AS (PARTITION BY subject_id ORDER BY t, kind_no))
"""


@query("m5_w3_alerts", _with(*FULL, SERIES, ALERTS) + f"""
SELECT subject_id, t AS predicted_ts, kind AS type, severity, {r6('p')} AS predicted_bsl,
  {r6('1 - (upper_b - lower_b)/10.0')} AS confidence
FROM al2 WHERE k0 IS NULL OR k0 <> kind OR t - t0 > 1800000""")
def alerts(spark, sf):
    log, grid = event_log(spark, sf, MODELLED), log_grid(spark, sf)
    series = predict.glucose_series(
        log, grid, subjects(event_log(spark, sf)), grid.start, halo=predict.alert_reach(grid)
    )
    return predict.alerts(series, grid)


@query("w6_time_to_target", _with(
    LOG, SPAN.replace("span AS", "whole AS"),
    "span AS (SELECT lo + 15*86400000 AS lo, lo + 15*86400000 + 6*3600000 AS hi FROM whole)",
    GRID, SEEN, CIRC, INS, CARB, DRINK, STATE, SERIES,
    """first_p AS (SELECT subject_id, p AS p0, lo FROM series WHERE t = lo),
crossed AS (SELECT s.subject_id, min(s.t) AS t1, arg_min(s.p, s.t) AS p1 FROM series s JOIN first_p f ON f.subject_id = s.subject_id
  WHERE s.t > f.lo AND CASE WHEN p0 > 6 THEN s.p <= 6 ELSE s.p >= 6 END GROUP BY s.subject_id)""") + f"""
SELECT f.subject_id, {r6('p0')} AS now_bsl, CASE WHEN abs(p0 - 6) < 0.5 THEN lo ELSE t1 END AS target_ts,
  {r6('CASE WHEN abs(p0 - 6) < 0.5 THEN p0 ELSE p1 END')} AS target_bsl_predicted
FROM first_p f LEFT JOIN crossed c ON c.subject_id = f.subject_id""")
def time_to_target(spark, sf):
    log = event_log(spark, sf, MODELLED)
    start, _ = log_span(spark, sf)
    return predict.time_to_target(log, subjects(event_log(spark, sf)), start + timedelta(days=15), 6.0)


@query("r6_projections", _with(*FULL) + f"""
SELECT subject_id, t AS at_ts, {r6('iob')} AS iob, {r6('cob')} AS cob,
  {r6('greatest(0.0::DOUBLE, in_system/(70.0::DOUBLE*0.6::DOUBLE)*10.0)')} AS blood_alcohol, {r6('md')} AS sensitivity_modifier
FROM st WHERE t % 900000 = 0""")
def projections(spark, sf):
    """The three decay projections side by side on a 15-minute grid."""
    log = event_log(spark, sf, MODELLED)
    out = state.metabolic_state(log, log_grid(spark, sf, 15), subjects(event_log(spark, sf)))
    return out.select(
        "subject_id", "at_ts", "iob", "cob", "blood_alcohol", "sensitivity_modifier"
    )


# -- curves for plots -------------------------------------------------------------


@query("r5_dose_curves", _with(LOG) + f"""
SELECT kind, CAST(m AS BIGINT) AS minute, {r6('n * act')} AS activity, {r6('n * iob')} AS on_board FROM (
  SELECT kind, n, m, CASE WHEN kind = 'basal' THEN {BASAL_ACT} ELSE {BOLUS_ACT} END AS act,
    CASE WHEN kind = 'basal' THEN {BASAL_IOB} ELSE {BOLUS_IOB} END AS iob
  FROM (SELECT itype AS kind, sum(value) AS n FROM log WHERE event_type = 'insulin' GROUP BY itype),
    (SELECT unnest(range(0, 1441, 5))::DOUBLE AS m)
  WHERE m <= CASE WHEN kind = 'basal' THEN 1440 ELSE 240 END)""")
def dose_curves(spark, sf):
    """Activity curve of each insulin type, scaled to all units logged of it."""
    kinds = (
        event_log(spark, sf)
        .filter(F.col("event_type") == "insulin")
        .groupBy(F.col("meta.type").alias("kind"))
        .agg(F.sum("value").alias("n"))
    )
    until = insulin.duration_minutes(F.col("kind")).cast("bigint")
    minute = F.col("minute").cast("double")
    return (
        kinds.withColumn(
            "minute", F.explode(F.sequence(F.lit(0).cast("bigint"), until, F.lit(5).cast("bigint")))
        )
        .select(
            "kind",
            "minute",
            (F.col("n") * insulin.activity(minute, F.col("kind"))).alias("activity"),
            (F.col("n") * insulin.on_board(minute, F.col("kind"))).alias("on_board"),
        )
    )


@query("r5_meal_curves", _with(LOG) + f"""
SELECT gi, CAST(m AS BIGINT) AS minute, {r6(CARB_RATE)} AS absorption_rate, {r6(CARB_LEFT)} AS on_board
FROM (SELECT *, dur/3 AS hl FROM (SELECT *, {CARB_PARAMS} FROM (
  SELECT {gi_sql('descr')} AS gi, sum(carbs) AS c FROM log WHERE event_type = 'meal' GROUP BY 1))),
  (SELECT unnest(range(0, 301, 5))::DOUBLE AS m) WHERE m <= dur""")
def meal_curves(spark, sf):
    """Absorption curve of each glycaemic index, scaled to all carbohydrate logged at it."""
    from glycoflow.functions.text import glycemic_index

    eaten = (
        event_log(spark, sf)
        .filter(F.col("event_type") == "meal")
        .groupBy(glycemic_index(F.col("meta.description")).alias("gi"))
        .agg(F.sum("meta.carbs").alias("c"))
    )
    until = F.floor(carb_fn.duration_minutes(F.col("gi")))
    minute = F.col("minute").cast("double")
    return (
        eaten.withColumn(
            "minute", F.explode(F.sequence(F.lit(0).cast("bigint"), until, F.lit(5).cast("bigint")))
        )
        .select(
            "gi",
            "minute",
            carb_fn.absorption_rate(minute, F.col("c"), F.col("gi")).alias("absorption_rate"),
            carb_fn.on_board(minute, F.col("c"), F.col("gi")).alias("on_board"),
        )
    )


@query("r5_circadian_table", _with(LOG, CIRC) + f"""
SELECT subject_id, CAST(h AS BIGINT) AS hour, CAST(count(*) AS BIGINT) AS n_events, {r6('any_value(b[h+1])')} AS insulin_sensitivity,
  {r6('any_value(d[h+1])')} AS dawn_effect, {r6('any_value(b[h+1]+d[h+1]*0.1::DOUBLE)')} AS combined_factor
FROM (SELECT subject_id, ms//3600000%24 AS h, b, d FROM log, circ) GROUP BY subject_id, h""")
def circadian_table(spark, sf):
    """Hourly factors beside the number of events each subject logs in that hour."""
    hour = F.col("hour")
    return (
        event_log(spark, sf)
        .groupBy("subject_id", F.hour("ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(
            "subject_id", "hour", "n_events",
            circadian.base_sensitivity(hour).alias("insulin_sensitivity"),
            circadian.dawn_effect(hour).alias("dawn_effect"),
            circadian.combined(hour).alias("combined_factor"),
        )
    )


# -- dose scoring -------------------------------------------------------------------

REQ = """
req AS (SELECT id AS request_id, subject_id, ms AS t, intensity, value AS carbs,
    CASE WHEN value >= 20 THEN value / 6 END AS bsl FROM log WHERE event_type = 'exercise'),
grid AS (SELECT DISTINCT subject_id, t FROM req)
"""
_R = circ_sql("q.t//3600000%24", "(q.t//60000%60)")
DOSE = f"""
seen AS (SELECT * FROM log), {INS}, {CARB}, {DRINK},
di AS (SELECT subject_id, t, sum(iob) AS iob FROM ins GROUP BY ALL),
dc AS (SELECT c.subject_id, c.t, sum(cob) AS cob FROM carb c JOIN log l ON l.id = c.id WHERE c.t - l.ms <= 6*3600000 GROUP BY ALL),
da AS (SELECT a.subject_id, a.t, sum(in_system) AS sys, product(md2) AS md, arg_min(l.aunits, (l.ms, l.id)) AS first_units
  FROM alc a JOIN log l ON l.id = a.id WHERE a.t - l.ms <= 6*3600000 GROUP BY ALL),
q0 AS (SELECT q.*, coalesce(iob, 0) AS iob, coalesce(cob, 0) AS cob, coalesce(sys, 0) AS sys, coalesce(md, 1) AS md, first_units,
    carbs/10 AS cc, CASE WHEN bsl > 7 THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, (bsl - 6)/2)) ELSE 0 END AS kd,
    {_R['combined_factor']} AS cf
  FROM req q CROSS JOIN circ LEFT JOIN di ON di.subject_id = q.subject_id AND di.t = q.t
  LEFT JOIN dc ON dc.subject_id = q.subject_id AND dc.t = q.t LEFT JOIN da ON da.subject_id = q.subject_id AND da.t = q.t),
q1 AS (SELECT *, CASE WHEN cob > 20 AND bsl < 6 THEN -cob/10*0.25::DOUBLE ELSE 0 END AS cadj,
    CASE WHEN sys > 0 THEN -(cc + kd)*(1 - md) ELSE 0 END AS aadj, (cc + kd)*cf - (cc + kd) AS zadj FROM q0),
q2 AS (SELECT *, cc + kd - iob + cadj + aadj + zadj AS total FROM q1),
q3 AS (SELECT *, CASE WHEN bsl < 4 THEN 0 WHEN bsl < 5 THEN least(total, cc*0.5::DOUBLE) ELSE total END AS cau FROM q2),
q4 AS (SELECT *, CASE WHEN (iob + cau)*2 > 8 THEN 'high' WHEN (iob + cau)*2 > 5 THEN 'medium' ELSE 'low' END AS stk FROM q3),
q5 AS (SELECT *, floor(greatest(0.0::DOUBLE, least(30.0::DOUBLE, CASE WHEN stk = 'high' THEN least(cau, cc) ELSE cau END))*2 + 0.5)/2 AS dose FROM q4),
q6 AS (SELECT *, dose*0.15::DOUBLE + dose*0.2::DOUBLE + CASE WHEN sys > 0 THEN dose*0.3::DOUBLE ELSE 0 END
    + CASE WHEN bsl IS NULL THEN 1.0 ELSE 0 END::DOUBLE + CASE WHEN carbs > 60 THEN (carbs - 60)/100 ELSE 0 END AS u FROM q5),
q7 AS (SELECT *, greatest(0.0::DOUBLE, floor((dose - u)*2 + 0.5)/2) AS low_d, floor((dose + u)*2 + 0.5)/2 AS up_d,
    greatest(0.3::DOUBLE, least(0.95::DOUBLE, CASE WHEN dose > 0 THEN 1 - u/dose ELSE 0.5 END)) AS conf,
    CASE WHEN first_units <= 2 THEN 'LOW' WHEN first_units <= 4 THEN 'MEDIUM' ELSE 'HIGH' END AS sev FROM q6)
"""


def dose_requests(log):
    """A request at every exercise: its minutes stand for carbs, and for glucose if 20 or more."""
    value = F.col("value")
    return log.filter(F.col("event_type") == "exercise").select(
        F.col("id").alias("request_id"), "subject_id", F.col("ts").alias("as_of"),
        value.alias("carbs"), F.when(value >= 20, value / 6).alias("current_bsl"),
    )


@query("m6_dose_scores", _with(LOG, CIRC, REQ, DOSE) + f"""
SELECT request_id, {r6('dose')} AS recommended_dose, {r6('cc')} AS carb_coverage, {r6('kd')} AS correction_dose,
  {r6('-iob')} AS iob_adjustment, {r6('cadj')} AS cob_adjustment, {r6('aadj')} AS alcohol_adjustment,
  {r6('zadj')} AS circadian_adjustment, stk AS stacking,
  array_to_string(list_filter([CASE WHEN bsl < 4 THEN 'BSL_CRITICAL' WHEN bsl < 5 THEN 'BSL_LOW' END,
    CASE WHEN iob > 2 THEN 'IOB_ACTIVE' END, CASE WHEN cob > 20 THEN 'COB_ACTIVE' END, CASE WHEN sys > 0 THEN 'ALCOHOL' END,
    CASE WHEN sys > 0 AND sev <> 'LOW' THEN 'HYPO_RISK_' || sev END,
    CASE WHEN stk <> 'low' THEN 'STACK_' || upper(stk) END], lambda x: x IS NOT NULL), '|') AS warnings FROM q7""")
def dose_scores(spark, sf):
    log = event_log(spark, sf)
    return dose.score_doses(log, dose_requests(log)).select(
        "request_id", "recommended_dose", "carb_coverage", "correction_dose", "iob_adjustment",
        "cob_adjustment", "alcohol_adjustment", "circadian_adjustment", "stacking", "warnings",
    )


@query("m7_dose_interval", _with(LOG, CIRC, REQ, DOSE) + f"""
SELECT request_id, {r6('low_d')} AS lower, {r6('up_d')} AS upper, {r6('conf')} AS confidence FROM q7""")
def dose_interval(spark, sf):
    log = event_log(spark, sf)
    return dose.score_doses(log, dose_requests(log)).select(
        "request_id", "lower", "upper", "confidence"
    )


def _fixed_sql(x: str) -> str:
    return f"printf('%.1f', sign({x})*floor(abs({x})*10+0.5)/10)"


def _line_sql(label: str, x: str, shown: str, plus: bool) -> str:
    sign = f"CASE WHEN {x} > 0 THEN '+' ELSE '' END || " if plus else ""
    return f"CASE WHEN {shown} THEN '{label} ' || {sign}{_fixed_sql(x)} || 'u' END"


@query("m9_dose_explanation", _with(LOG, CIRC, REQ, DOSE) + f"""
SELECT request_id, concat_ws(chr(10), 'dose ' || {_fixed_sql('dose')} || 'u',
  'sure ' || CAST(CAST(floor(conf*100+0.5) AS BIGINT) AS VARCHAR) || '% of ' || {_fixed_sql('low_d')} || '-' || {_fixed_sql('up_d')} || 'u',
  {_line_sql('carbs', 'cc', 'cc > 0', True)}, {_line_sql('correction', 'kd', 'kd > 0', True)},
  {_line_sql('active insulin', '(-iob)', '-iob < 0', False)}, {_line_sql('active carbs', 'cadj', 'cadj <> 0', False)},
  {_line_sql('alcohol', 'aadj', 'aadj <> 0', False)}, {_line_sql('time of day', 'zadj', 'abs(zadj) > 0.1', True)}) AS explanation
FROM q7""")
def dose_explanation(spark, sf):
    log = event_log(spark, sf)
    return dose.explained(dose.score_doses(log, dose_requests(log))).select(
        "request_id", "explanation"
    )


# -- learning from history ------------------------------------------------------------

PAIRS = """
meal AS (SELECT subject_id, id, ms, CASE WHEN carbs IS NULL OR carbs = 0 THEN value ELSE carbs END AS c
  FROM log WHERE event_type = 'meal' AND CASE WHEN carbs IS NULL OR carbs = 0 THEN value ELSE carbs END >= 10),
pd AS (SELECT m.subject_id, m.id, m.ms, m.c, arg_min(i.value, (i.ms, i.id)) AS units FROM meal m JOIN log i
  ON i.subject_id = m.subject_id AND i.event_type = 'insulin' AND i.ms > m.ms - 1800000 AND i.ms < m.ms + 1800000 GROUP BY ALL),
pb AS (SELECT p.subject_id, p.id, p.ms, p.c, p.units, arg_min(b.value, (b.ms, b.id)) AS after_bsl FROM pd p JOIN log b
  ON b.subject_id = p.subject_id AND b.event_type = 'bsl' AND b.ms >= p.ms + 7200000 AND b.ms <= p.ms + 14400000
  WHERE p.units >= 1 GROUP BY ALL),
po AS (SELECT *, CASE WHEN after_bsl < 4.5 THEN 'low' WHEN after_bsl > 9 THEN 'high' ELSE 'good' END AS outcome FROM pb)
"""


@query("j5_meal_outcomes", _with(LOG, PAIRS) + f"""
SELECT subject_id, id, ms AS ts, {r6('c')} AS carbs, {r6('units')} AS units, {r6('after_bsl')} AS after_bsl, outcome FROM po""")
def meal_outcomes(spark, sf):
    return tuning.meal_outcomes(event_log(spark, sf)).drop("dose_ts", "after_ts")


@query("a14_ratio_suggestions", _with(LOG, PAIRS) + f"""
SELECT s.subject_id, n AS data_points,
  {r6('CASE WHEN n < 5 THEN 10 WHEN hi > n*0.4 THEN 9.0 WHEN lw > n*0.2 THEN 11.5 ELSE 10 END::DOUBLE')} AS suggested_ratio,
  {r6('CASE WHEN n < 5 THEN 0 ELSE least(0.9::DOUBLE, n/20) END')} AS confidence,
  CASE WHEN n < 5 THEN 'INSUFFICIENT' WHEN hi > n*0.4 THEN 'MOSTLY_HIGH' WHEN lw > n*0.2 THEN 'MOSTLY_LOW'
    WHEN gd > n*0.6 THEN 'WORKING' ELSE 'MIXED' END AS finding
FROM (SELECT s.subject_id, CAST(count(id) AS BIGINT) AS n, count_if(outcome = 'high') AS hi, count_if(outcome = 'low') AS lw,
    count_if(outcome = 'good') AS gd FROM (SELECT DISTINCT subject_id FROM log) s LEFT JOIN po ON po.subject_id = s.subject_id
  GROUP BY s.subject_id) s""")
def ratio_suggestions(spark, sf):
    log = event_log(spark, sf)
    return tuning.ratio_suggestions(log, subjects(log))


@query("a18_overnight_pattern", _with(LOG) + f"""
SELECT user_id, n, {r6('CASE WHEN n >= 3 THEN rise END')} AS rise, CAST(coalesce(n >= 3 AND rise > 1.5, false) AS BIGINT) AS dawn_detected,
  {r6('CASE WHEN n >= 3 AND rise > 1.5 THEN 1 + least(rise/3, 1.0::DOUBLE)*0.25::DOUBLE END')} AS hour_6,
  {r6('CASE WHEN n >= 3 AND rise > 1.5 THEN 1 + least(rise/3, 1.0::DOUBLE)*0.1::DOUBLE END')} AS hour_8,
  CASE WHEN n < 3 THEN 'INSUFFICIENT' WHEN rise IS NULL THEN 'NO_DATA_IN_WINDOW' WHEN rise > 1.5 THEN 'DAWN' ELSE 'NONE' END AS finding
FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n, avg(value) FILTER (h BETWEEN 3 AND 7) - avg(value) FILTER (h BETWEEN 0 AND 3) AS rise
  FROM (SELECT e.user_id, l.value, l.ms//3600000%24 AS h FROM log l JOIN events e ON e.event_id = l.event_id WHERE l.event_type = 'bsl') WHERE h < 8 GROUP BY user_id)""")
def overnight_pattern(spark, sf):
    readings = event_log(spark, sf, ["bsl"]).filter(F.hour("ts") < 8).select("subject_id", "ts", "value")
    found = tuning.overnight_patterns(readings)
    adjust = F.col("suggested_adjustments")
    return found.select(
        F.col("subject_id").alias("user_id"), "n", "rise", "dawn_detected",
        adjust.getItem(6).alias("hour_6"), adjust.getItem(8).alias("hour_8"), "finding",
    )
