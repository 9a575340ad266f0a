"""Kernels evaluated over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.catalog.adapter import LOG, event_log, table
from glycoflow.catalog.logs import _with
from glycoflow.catalog.registry import query, r6
from glycoflow.functions import alcohol, carbs, circadian, dates, insulin, jsmath, macros, text
from glycoflow.functions import glucose

# Each line item reads as one sample of a kernel: minutes, amount and a kind.
SAMPLE = """
sample AS (
  SELECT l_orderkey, l_linenumber, l_extendedprice / 70 - 20 AS m, l_quantity AS amount,
         l_tax * 1250 AS gi, l_discount * 100 AS score, l_returnflag AS flag,
         epoch_us(l_shipdate) // 1000 + CAST(floor(l_extendedprice) AS BIGINT) * 977 AS ms
  FROM lineitem)
"""
KEYS = ["l_orderkey", "l_linenumber"]


def sample(spark, sf):
    return table(spark, sf, "lineitem").select(
        *KEYS,
        (F.col("l_extendedprice") / 70 - 20).alias("m"),
        F.col("l_quantity").alias("amount"),
        (F.col("l_tax") * 1250).alias("gi"),
        (F.col("l_discount") * 100).alias("score"),
        F.col("l_returnflag").alias("flag"),
        (
            F.unix_millis(F.col("l_shipdate").cast("timestamp"))
            + F.floor("l_extendedprice") * 977
        ).alias("ms"),
    )


def _curve(slow: float, fast: float, dur: float) -> tuple[str, str]:
    t1, t2 = f"{slow}::DOUBLE", f"{fast}::DOUBLE"
    tp = f"({t1}*{t2}*ln({t1}/{t2})/({t1}-{t2}))"
    act = f"(exp(-m/{t1})-exp(-m/{t2}))/(exp(-{tp}/{t1})-exp(-{tp}/{t2}))"
    iob = f"({t1}*exp(-m/{t1})-{t2}*exp(-m/{t2}))/({t1}-{t2})"
    return (
        f"CASE WHEN m < 0 OR m >= {dur} THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {act})) END",
        f"CASE WHEN m < 0 THEN 1.0::DOUBLE WHEN m >= {dur} THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, {iob})) END",
    )


BOLUS_ACT, BOLUS_IOB = _curve(77.0, 10.5, 240)
BASAL_ACT, BASAL_IOB = _curve(420.0, 63.0, 1440)


@query("f1_insulin_curve", _with(SAMPLE) + f"""
SELECT l_orderkey, l_linenumber,
  {r6(f"CASE WHEN flag = 'A' THEN {BASAL_ACT} ELSE {BOLUS_ACT} END")} AS activity,
  {r6(f"CASE WHEN flag = 'A' THEN {BASAL_IOB} ELSE {BOLUS_IOB} END")} AS on_board FROM sample""")
def insulin_curve(spark, sf):
    kind = F.when(F.col("flag") == "A", F.lit("basal")).otherwise(F.lit("bolus"))
    return sample(spark, sf).select(
        *KEYS,
        insulin.activity(F.col("m"), kind).alias("activity"),
        insulin.on_board(F.col("m"), kind).alias("on_board"),
    )


@query("f2_absorption_params", _with(SAMPLE) + f"""
SELECT l_orderkey, l_linenumber, {r6('120 - g/100*90')} AS peak_minutes,
  {r6('120 + (100-g)/100*180')} AS duration_minutes, {r6('(120 + (100-g)/100*180)/3')} AS half_life_minutes
FROM (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, gi*1.2-5)) AS g FROM sample)""")
def absorption_params(spark, sf):
    gi = F.col("gi") * 1.2 - 5
    return sample(spark, sf).select(
        *KEYS,
        carbs.peak_minutes(gi).alias("peak_minutes"),
        carbs.duration_minutes(gi).alias("duration_minutes"),
        carbs.half_life_minutes(gi).alias("half_life_minutes"),
    )


# Carbohydrate curve over m (minutes), c (grams), pk, dur, hl.
CARB_PARAMS = "120.0::DOUBLE - gi/100.0*90.0 AS pk, 120.0::DOUBLE + (100.0-gi)/100.0*180.0 AS dur"
CARB_RATE = """CASE WHEN m < 0 OR m >= dur THEN 0.0::DOUBLE ELSE
  greatest(0.0::DOUBLE, (CASE WHEN m < pk THEN pow(m/pk, pk/hl) ELSE exp(-((m-pk)/hl)) END) * (c*2/(dur/60))) END"""
CARB_LEFT = """CASE WHEN m < 0 THEN c WHEN m >= dur THEN 0.0::DOUBLE ELSE
  c - greatest(0.0::DOUBLE, least(c, CASE WHEN m < pk THEN c*pow(m/pk, pk/hl+1)*pk/((pk/hl+1)*dur)
    ELSE c*0.4 + (c - c*0.4)*(1-exp(-((m-pk)/hl))) END)) END"""


@query("f3_carb_curve", _with(SAMPLE) + f"""
SELECT l_orderkey, l_linenumber, {r6(CARB_RATE)} AS absorption_rate, {r6(CARB_LEFT)} AS on_board
FROM (SELECT *, dur/3 AS hl FROM (SELECT l_orderkey, l_linenumber, m/4 AS m, amount AS c, {CARB_PARAMS} FROM sample))""")
def carb_curve(spark, sf):
    m, grams, gi = F.col("m") / 4, F.col("amount"), F.col("gi")
    return sample(spark, sf).select(
        *KEYS,
        carbs.absorption_rate(m, grams, gi).alias("absorption_rate"),
        carbs.on_board(m, grams, gi).alias("on_board"),
    )


def gi_sql(column: str) -> str:
    rules = " ".join(
        f"WHEN contains(lower({column}), '{w}') THEN {g}.0"
        for w, g in values.GI_KEYWORDS + values.GI_MODIFIERS
    )
    return f"CAST(CASE WHEN {column} IS NULL OR {column} = '' THEN 60.0 {rules} ELSE 60.0 END AS DOUBLE)"


def groups_sql(column: str, groups, otherwise: str) -> str:
    rules = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), '{w}')" for w in words)
        + f" THEN '{label}'"
        for label, words in groups
    )
    return f"CASE {rules} ELSE '{otherwise}' END"


@query("f4_glycemic_index", _with(LOG) + f"""
SELECT 'doc' || doc_id AS id, {gi_sql('text')} AS gi FROM documents
UNION ALL SELECT 'event' || id, {gi_sql('descr')} FROM log WHERE event_type = 'meal'
UNION ALL SELECT 'part' || p_partkey, {gi_sql('p_name')} FROM part""")
def glycemic_index(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("id"), F.col("text").alias("d")
    )
    meals = event_log(spark, sf).filter(F.col("event_type") == "meal").select(
        F.concat(F.lit("event"), "id").alias("id"), F.col("meta.description").alias("d")
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("part"), "p_partkey").alias("id"), F.col("p_name").alias("d")
    )
    return docs.union(meals).union(parts).select("id", text.glycemic_index(F.col("d")).alias("gi"))


# Alcohol over m (minutes), u (units), hl, md, eff (minutes), kg.
DRINK_PARAMS = """
  CASE t WHEN 'beer' THEN 20.0 WHEN 'spirit' THEN 15.0 ELSE 25.0 END::DOUBLE AS hl,
  CASE t WHEN 'beer' THEN 0.85 WHEN 'spirit' THEN 0.75 ELSE 0.8 END::DOUBLE AS md,
  CASE t WHEN 'wine' THEN 840.0 WHEN 'spirit' THEN 960.0 ELSE 720.0 END::DOUBLE AS eff"""
A_ABSORBED = "(u*10.0*(1.0-exp(-m/hl)))"
A_RATE = "(8.0::DOUBLE*pow(kg/70.0::DOUBLE, 0.25::DOUBLE))"
A_ABSORBING = f"greatest(0.0::DOUBLE, u*10.0 - {A_ABSORBED})"
A_SYSTEM = f"greatest(0.0::DOUBLE, {A_ABSORBED} - least({A_ABSORBED}, {A_RATE}*(m/60.0)))"
A_SENS = """CASE WHEN m >= eff THEN 1.0::DOUBLE WHEN m < 60 THEN 1.0 - (1.0-md)*(m/60.0)
  ELSE md + (1.0-md)*((m-60.0)/(eff-60.0)) END"""


@query("f5_alcohol_state", _with(SAMPLE) + f"""
SELECT l_orderkey, l_linenumber, {r6(A_ABSORBING)} AS absorbing, {r6(A_SYSTEM)} AS in_system,
  {r6(f'{A_SYSTEM}/(kg*0.6)*10.0')} AS blood_alcohol
FROM (SELECT *, {DRINK_PARAMS} FROM (
  SELECT l_orderkey, l_linenumber, abs(m) AS m, amount/5 AS u, 50.0::DOUBLE + amount AS kg,
    CASE flag WHEN 'A' THEN 'beer' WHEN 'N' THEN 'wine' ELSE 'spirit' END AS t FROM sample))""")
def alcohol_state(spark, sf):
    m, units, weight = F.abs("m"), F.col("amount") / 5, F.col("amount") + 50.0
    kind = (
        F.when(F.col("flag") == "A", F.lit("beer"))
        .when(F.col("flag") == "N", F.lit("wine"))
        .otherwise(F.lit("spirit"))
    )
    system = alcohol.in_system(m, units, kind, weight)
    return sample(spark, sf).select(
        *KEYS,
        alcohol.absorbing(m, units, kind).alias("absorbing"),
        system.alias("in_system"),
        alcohol.blood_level(system, weight).alias("blood_alcohol"),
    )


@query("f6_alcohol_sensitivity", _with(SAMPLE) + f"""
SELECT l_orderkey, l_linenumber, {r6(A_SENS)} AS modifier
FROM (SELECT *, {DRINK_PARAMS} FROM (SELECT l_orderkey, l_linenumber, abs(m) AS m,
    CASE flag WHEN 'A' THEN 'beer' WHEN 'N' THEN 'wine' ELSE 'spirit' END AS t FROM sample))""")
def alcohol_sensitivity(spark, sf):
    kind = (
        F.when(F.col("flag") == "A", F.lit("beer"))
        .when(F.col("flag") == "N", F.lit("wine"))
        .otherwise(F.lit("spirit"))
    )
    return sample(spark, sf).select(
        *KEYS, alcohol.sensitivity(F.abs("m"), kind).alias("modifier")
    )


@query("f7_sober_and_risk", _with(LOG) + f"""
SELECT id, {r6('aunits*10.0/8.0*60.0')} AS sober_minutes, ms + 6*3600000 AS risk_start,
  ms + 12*3600000 AS risk_end,
  CASE WHEN aunits <= 2 THEN 'low' WHEN aunits <= 4 THEN 'medium' ELSE 'high' END AS severity
FROM log WHERE aunits > 0""")
def sober_and_risk(spark, sf):
    units = F.col("meta.alcohol_units")
    return event_log(spark, sf).filter(units > 0).select(
        "id",
        alcohol.minutes_to_sober(alcohol.grams(units), F.lit(70.0)).alias("sober_minutes"),
        alcohol.hypo_risk_start(F.col("ts")).alias("risk_start"),
        alcohol.hypo_risk_end(F.col("ts")).alias("risk_end"),
        alcohol.hypo_risk_severity(units).alias("severity"),
    )


def _list(numbers) -> str:
    return "[" + ",".join(f"{n}" for n in numbers) + "]::DOUBLE[]"


CIRC = f"""
circ AS (SELECT {_list(values.CIRCADIAN_BASE)} AS b, {_list(values.DAWN_EFFECT)} AS d)
"""


def circ_sql(hour: str, minute: str) -> dict[str, str]:
    def lerp(f):
        here, ahead = f(f"({hour})"), f(f"(({hour}+1)%24)")
        return f"({here} + ({ahead} - {here}) * ({minute}/60.0::DOUBLE))"

    return {
        "insulin_sensitivity": lerp(lambda h: f"b[{h}+1]"),
        "dawn_effect": lerp(lambda h: f"d[{h}+1]"),
        "combined_factor": lerp(lambda h: f"(b[{h}+1] + d[{h}+1]*0.1::DOUBLE)"),
    }


_C = circ_sql("ms//3600000%24", "(ms//60000%60)")


@query("f8_circadian_factors", _with(SAMPLE, CIRC) + f"""
SELECT l_orderkey, l_linenumber, CAST(ms//3600000%24 AS BIGINT) AS hour,
  {r6(_C['insulin_sensitivity'])} AS insulin_sensitivity, {r6(_C['dawn_effect'])} AS dawn_effect,
  {r6(_C['combined_factor'])} AS combined_factor FROM sample, circ""")
def circadian_factors(spark, sf):
    factors = circadian.interpolated(F.timestamp_millis("ms"))
    return sample(spark, sf).select(*KEYS, *[c.alias(n) for n, c in factors.items()])


def drift_sql(start_ms: str, end_ms: str) -> str:
    """12 left-edge samples of the interpolated dawn effect, from hour tables."""
    minute = f"(CAST(trunc({start_ms} + (i/12.0::DOUBLE)*({end_ms}-{start_ms})) AS BIGINT)//60000%1440)"
    here, ahead = f"d[{minute}//60+1]", f"d[({minute}//60+1)%24+1]"
    term = f"({here} + ({ahead} - {here})*(({minute}%60)/60.0::DOUBLE))/12.0::DOUBLE"
    return (
        f"(list_sum(list_transform(range(12), lambda i: {term}))"
        f"*1.5::DOUBLE*(({end_ms}-{start_ms})/3600000.0::DOUBLE))"
    )


@query("f9_circadian_drift", _with(SAMPLE, CIRC) + f"""
SELECT l_orderkey, l_linenumber, {r6(drift_sql('ms', '(ms + CAST(amount*600000 AS BIGINT))'))} AS drift
FROM sample, circ""")
def circadian_drift(spark, sf):
    start = F.timestamp_millis("ms")
    end = F.timestamp_millis(F.col("ms") + (F.col("amount") * 600000).cast("bigint"))
    spans = sample(spark, sf).select(*KEYS, start.alias("start_ts"), end.alias("end_ts"))
    return spans.select(*KEYS, circadian.drift("start_ts", "end_ts").alias("drift"))


@query("f10_time_of_day_dose", _with(SAMPLE, CIRC) + f"""
SELECT l_orderkey, l_linenumber, {r6('amount*cf')} AS adjusted_dose, {r6('amount*cf-amount')} AS adjustment,
  CASE WHEN de > 0.5 THEN 'DAWN' WHEN se < 0.95 THEN 'MORE_SENSITIVE' WHEN se > 1.05 THEN 'LESS_SENSITIVE'
  ELSE 'BASELINE' END AS reason
FROM (SELECT *, {_C['combined_factor']} AS cf, {_C['dawn_effect']} AS de, {_C['insulin_sensitivity']} AS se
      FROM sample, circ)""")
def time_of_day_dose(spark, sf):
    factors = circadian.interpolated(F.timestamp_millis("ms"))
    dose = F.col("amount")
    return sample(spark, sf).select(
        *KEYS,
        (dose * factors["combined_factor"]).alias("adjusted_dose"),
        (dose * factors["combined_factor"] - dose).alias("adjustment"),
        circadian.dose_reason(factors["dawn_effect"], factors["insulin_sensitivity"]).alias(
            "reason"
        ),
    )


@query("f11_food_category", f"""
SELECT 'doc' || doc_id AS id, {groups_sql('text', values.CATEGORY_KEYWORDS, 'other')} AS category FROM documents
UNION ALL SELECT 'part' || p_partkey, {groups_sql('p_name', values.CATEGORY_KEYWORDS, 'other')} FROM part
UNION ALL SELECT 'turn' || conv_id || '-' || turn, {groups_sql('text', values.CATEGORY_KEYWORDS, 'other')} FROM conversations""")
def food_category(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), "doc_id").alias("id"), F.col("text").alias("d")
    )
    parts = table(spark, sf, "part").select(
        F.concat(F.lit("part"), "p_partkey").alias("id"), F.col("p_name").alias("d")
    )
    turns = table(spark, sf, "conversations").select(
        F.concat(F.lit("turn"), "conv_id", F.lit("-"), "turn").alias("id"),
        F.col("text").alias("d"),
    )
    return docs.union(parts).union(turns).select(
        "id", text.food_category(F.col("d")).alias("category")
    )


@query("f12_estimate_errors", _with(SAMPLE) + f"""
SELECT l_orderkey, l_linenumber, {r6('abs(p-a)')} AS mae_carbs, {r6('mp')} AS mape_carbs,
  {r6('abs(p*4-a*4)*0.1::DOUBLE + abs(p-a)*0.5::DOUBLE + abs(p/2-a/2)*0.2::DOUBLE + abs(p/3-a/3)*0.2::DOUBLE')} AS mae_overall
FROM (SELECT *, CASE WHEN a = 0 THEN CASE WHEN p = 0 THEN 0 ELSE 100 END ELSE abs((p-a)/a)*100 END::DOUBLE AS mp
      FROM (SELECT l_orderkey, l_linenumber, amount AS p, score AS a FROM sample))""")
def estimate_errors(spark, sf):
    p, a = F.col("amount"), F.col("score")
    parts = {
        "calories": macros.absolute_error(p * 4, a * 4),
        "carbs": macros.absolute_error(p, a),
        "protein": macros.absolute_error(p / 2, a / 2),
        "fat": macros.absolute_error(p / 3, a / 3),
    }
    return sample(spark, sf).select(
        *KEYS,
        parts["carbs"].alias("mae_carbs"),
        macros.percent_error(p, a).alias("mape_carbs"),
        macros.weighted(parts).alias("mae_overall"),
    )


@query("f13_effects_and_stacking", _with(SAMPLE) + f"""
SELECT l_orderkey, l_linenumber, {r6('score*2.0')} AS insulin_drop, {r6('amount/10.0*2.0')} AS carb_rise,
  CASE WHEN (score+amount/20)*2.0 > 8 THEN 'high' WHEN (score+amount/20)*2.0 > 5 THEN 'medium' ELSE 'low' END AS risk
FROM sample""")
def effects_and_stacking(spark, sf):
    iob, grams, cf = F.col("score"), F.col("amount"), F.lit(2.0)
    return sample(spark, sf).select(
        *KEYS,
        insulin.glucose_drop(iob, cf).alias("insulin_drop"),
        carbs.glucose_rise(grams, F.lit(10.0), cf).alias("carb_rise"),
        insulin.stacking_risk(iob, grams / 20, cf).alias("risk"),
    )


@query("f14_date_parsing", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN y BETWEEN 2000 AND 2100 THEN stamp END AS us_ms,
  CASE WHEN year(swapped) BETWEEN 2000 AND 2100 THEN epoch_us(swapped) // 1000 + 30600000 END AS eu_ms,
  CASE WHEN y BETWEEN 2000 AND 2100 THEN stamp END AS iso_ms,
  CASE WHEN y BETWEEN 2000 AND 2100 THEN stamp END AS spaced_ms,
  'LIBRE_US,ISO,DEXCOM' AS formats
FROM (SELECT *, epoch_us(l_shipdate) // 1000 + 30600000 AS stamp,
        make_date(CAST(y AS INT), 1, 1) + to_months(CAST(d-1 AS INT)) + to_days(CAST(m-1 AS INT)) AS swapped
FROM (SELECT *, year(l_shipdate) AS y, month(l_shipdate) AS m, day(l_shipdate) AS d FROM lineitem))""")
def date_parsing(spark, sf):
    """The same dates written three ways; month and day swapped roll over."""
    ship = F.col("l_shipdate")
    us = F.concat(F.date_format(ship, "MM-dd-yyyy"), F.lit(" 08:30"))
    iso = F.concat(F.date_format(ship, "yyyy-MM-dd"), F.lit("T08:30:00"))
    spaced = F.concat(F.date_format(ship, "yyyy-MM-dd"), F.lit(" 08:30:00"))
    return table(spark, sf, "lineitem").select(
        *KEYS,
        dates.parse_any(us).alias("us_ms"),
        dates.parse_any(us, us_format=False).alias("eu_ms"),
        dates.parse_any(iso).alias("iso_ms"),
        dates.parse_any(spaced).alias("spaced_ms"),
        F.concat_ws(
            ",", dates.date_format(us), dates.date_format(iso), dates.date_format(spaced)
        ).alias("formats"),
    )


@query("p6_material_correction", _with(SAMPLE) + """
SELECT l_orderkey, l_linenumber, CAST(abs(amount - score) > 0.5 OR abs(amount/4 - score/4) > 0.5
  OR abs(amount/9 - score/9) > 0.5 OR abs(amount*0.3::DOUBLE - score*0.3::DOUBLE) > 1 AS BIGINT) AS is_material FROM sample""")
def material_correction(spark, sf):
    def side(x):
        return {"carbs": x, "protein": x / 4, "fat": x / 9, "calories": x * 0.3}

    return sample(spark, sf).select(
        *KEYS,
        macros.correction_is_material(side(F.col("amount")), side(F.col("score"))).alias(
            "is_material"
        ),
    )


@query("p9_calories_and_servings", _with(SAMPLE) + f"""
SELECT l_orderkey, l_linenumber, {r6('floor(amount*4+score*4+gi*9+0.5)')} AS calories,
  {r6('floor(amount*1.5+0.5)')} AS served_carbs FROM sample""")
def calories_and_servings(spark, sf):
    return sample(spark, sf).select(
        *KEYS,
        macros.calories(F.col("amount"), F.col("score"), F.col("gi")).alias("calories"),
        macros.per_servings(F.col("amount"), F.lit(1.5)).alias("served_carbs"),
    )


@query("m8_premeal_timing", _with(SAMPLE) + """
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN bsl IS NULL THEN 0 WHEN bsl < 4 THEN -15 WHEN bsl < 5 THEN 0
  WHEN bsl < 7 THEN 10 WHEN bsl < 10 THEN 15 ELSE 20 END AS BIGINT) AS minutes_before,
  CASE WHEN bsl IS NULL THEN 'BSL_UNKNOWN' WHEN bsl < 4 THEN 'BSL_LOW_EAT_FIRST' WHEN bsl < 5 THEN 'BSL_LOW_SIDE'
  WHEN bsl < 7 THEN 'BSL_NORMAL' WHEN bsl < 10 THEN 'BSL_ELEVATED' ELSE 'BSL_HIGH' END AS reason
FROM (SELECT *, CASE WHEN score > 0 THEN amount/4 END AS bsl FROM sample)""")
def premeal_timing(spark, sf):
    bsl = F.when(F.col("score") > 0, F.col("amount") / 4)
    return sample(spark, sf).select(
        *KEYS,
        glucose.premeal_minutes(bsl).alias("minutes_before"),
        glucose.premeal_reason(bsl).alias("reason"),
    )


@query("js_number_rules", _with(SAMPLE) + f"""
SELECT l_orderkey, l_linenumber, {r6('floor(m*100.0+0.5)/100.0')} AS half_up_2,
  {r6('CASE WHEN score = 0 THEN 7.5 ELSE score END')} AS or_default, {r6('amount + 0.25')} AS parsed
FROM sample""")
def number_rules(spark, sf):
    written = F.concat(F.lit(" "), (F.col("amount") + 0.25).cast("string"), F.lit("abc"))
    return sample(spark, sf).select(
        *KEYS,
        jsmath.half_up(F.col("m"), 2).alias("half_up_2"),
        jsmath.or_default(F.col("score"), 7.5).alias("or_default"),
        jsmath.parse_number(written).alias("parsed"),
    )
