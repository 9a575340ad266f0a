"""Dose scoring for a table of requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions import alcohol, carbs, circadian, insulin
from glycoflow.functions.jsmath import clamp, half_up
from glycoflow.operators.decay import decaying_sums
from glycoflow.plans.params import with_params
from glycoflow.plans.state import carb_effects, carb_events, dose_events, drink_effects, drink_events

BUCKET_MS = 3_600_000

MAX_DOSE = 30.0
MAX_CORRECTION = 10.0
CORRECT_ABOVE = 7.0
LOW_BSL = 5.0
CRITICAL_BSL = 4.0


def state_at(
    log: DataFrame,
    requests: DataFrame,
    params: DataFrame | None = None,
    meal_lookback_hours: int = values.LOOKBACK_HOURS["meal"],
) -> DataFrame:
    """Insulin, carbs and alcohol at the `as_of` of each request.

    State depends on (subject, instant) only, so requests are first reduced to distinct instants. Insulin, and carbs
    after their peak, are sums of exponentials that are carried from hour to hour (`decaying_sums`): a
    request costs one row, however many doses act. The rising part of meals, up to two hours, and drinks, whose modifiers
    multiply, meet the instants by equality on (subject, hour) and are summed map-side.
    """
    instants = requests.select("subject_id", F.unix_millis("as_of").alias("at_ms")).distinct()
    placed = instants.withColumn("bucket", F.floor(F.col("at_ms") / F.lit(BUCKET_MS)))
    lookback = meal_lookback_hours * 60.0
    parts = [
        carried_state(log, instants, lookback),
        _rising_carbs(log, placed, lookback),
        _acting_drinks(log, placed, params, lookback),
    ]
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    found = found.groupBy("subject_id", "at_ms").agg(
        F.sum("iob").alias("iob"),
        F.sum("cob").alias("cob"),
        F.sum("alcohol_in_system").alias("alcohol_in_system"),
        F.product("sensitivity_modifier").alias("sensitivity_modifier"),
        F.min("sip").alias("sip"),
    )
    return (
        requests.withColumn("at_ms", F.unix_millis("as_of"))
        .join(found, ["subject_id", "at_ms"], "left")
        .drop("at_ms")
        .withColumn("first_drink_units", F.col("sip").getField("units"))
        .drop("sip")
        .fillna({"iob": 0.0, "cob": 0.0, "alcohol_in_system": 0.0, "sensitivity_modifier": 1.0})
    )


#: Fixed time constants: two of each insulin type, and one of each glycaemic index in use.
_KINDS = ("bolus", "basal")
_INDEXES = sorted({float(gi) for _, gi in values.GI_KEYWORDS + values.GI_MODIFIERS} | {float(values.GI_DEFAULT)})
_TAUS = [insulin.constants(kind)[name] for kind in _KINDS for name in ("slow", "fast")] + [
    carbs.half_life_of(gi) for gi in _INDEXES
]


def _ms_after(ms: Column, minutes: Column) -> Column:
    """The first whole millisecond that many minutes later."""
    return F.ceil(ms.cast("double") + minutes * 60000.0).cast("bigint")


def carried_state(log: DataFrame, instants: DataFrame, lookback_minutes: float) -> DataFrame:
    """subject_id, at_ms, iob, and cob of the meals past their peak; one row per instant."""
    doses = dose_events(log)
    slow, fast = F.col("slow"), F.col("fast")
    first = F.when(F.col("kind") == "basal", F.lit(2)).otherwise(F.lit(0))

    def of_dose(no: Column, weight: Column) -> Column:
        return F.struct(no.alias("tau_no"), (F.col("dose") * weight / (slow - fast)).alias("weight"))

    insulin_terms = doses.select(
        "subject_id",
        F.col("ms").alias("from_ms"),
        _ms_after(F.col("ms"), F.col("minutes")).alias("to_ms"),
        F.explode(F.array(of_dose(first, slow), of_dose(first + 1, -fast))).alias("t"),
    ).select("subject_id", "from_ms", "to_ms", "t.tau_no", "t.weight")
    grams, peak, half = F.col("grams"), F.col("peak"), F.col("half_life")
    since = (F.col("from_ms") - F.col("ms")).cast("double") / 60000.0
    until = F.least(
        _ms_after(F.col("ms"), F.col("minutes")),
        F.col("ms") + F.lit(int(lookback_minutes * 60000) + 1),
    )
    carb_terms = (
        carb_events(log)
        .withColumn("from_ms", _ms_after(F.col("ms"), peak))
        .select(
            "subject_id",
            "from_ms",
            until.alias("to_ms"),
            (F.array_position(F.array(*map(F.lit, _INDEXES)), F.col("gi")).cast("int") + 3).alias("tau_no"),
            (grams * (1.0 - carbs.AT_PEAK) * F.exp((peak - since) / half)).alias("weight"),
        )
    )
    sums = decaying_sums(insulin_terms.unionByName(carb_terms), instants, _TAUS)
    total = lambda names: reduce(lambda a, b: a + b, map(F.col, names))
    return sums.select(
        "subject_id",
        "at_ms",
        total(f"sum_{i}" for i in range(4)).alias("iob"),
        total(f"sum_{i}" for i in range(4, len(_TAUS))).alias("cob"),
    )


def _met(events: DataFrame, instants: DataFrame, minutes: Column, lookback_minutes: float) -> DataFrame:
    """Each event with the instants less than `minutes` after it, and `since`."""
    start = F.floor(F.col("ms") / F.lit(BUCKET_MS))
    stop = F.floor((F.col("ms").cast("double") + minutes * 60000.0) / F.lit(BUCKET_MS))
    since = F.col("since")
    return (
        instants.join(events.withColumn("bucket", F.explode(F.sequence(start, stop))), ["subject_id", "bucket"])
        .withColumn("since", (F.col("at_ms") - F.col("ms")).cast("double") / 60000.0)
        .filter((since >= 0) & (since < minutes) & (since <= lookback_minutes))
    )


def _rising_carbs(log: DataFrame, instants: DataFrame, lookback_minutes: float) -> DataFrame:
    """cob of meals before their peak, one row per meal."""
    return carb_effects(_met(carb_events(log), instants, F.col("peak"), lookback_minutes)).select("subject_id", "at_ms", "cob")


def _acting_drinks(log: DataFrame, instants: DataFrame, params: DataFrame | None, lookback_minutes: float) -> DataFrame:
    """Effects of drinks, one row per drink."""
    met = _met(drink_events(log, params), instants, F.col("minutes"), lookback_minutes)
    return drink_effects(met).withColumn("sip", F.struct("ms", "id", "units")).drop("ms", "id", "units")


def _half_units(x: Column) -> Column:
    return half_up(x * 2.0) / 2.0


def score_doses(
    log: DataFrame,
    requests: DataFrame,
    params: DataFrame | None = None,
    meal_lookback_hours: int = values.LOOKBACK_HOURS["meal"],
) -> DataFrame:
    """Recommended dose, its breakdown, interval and warning codes.

    `requests`: request_id, subject_id, as_of, carbs, current_bsl (NULL when unknown).
    A correction dose is a request with no carbs.
    """
    state = with_params(
        state_at(log, requests, params, meal_lookback_hours),
        params,
        [*values.USER_DEFAULTS, "circadian_adjustments", "tz"],
    )
    bsl, iob, cob = F.col("current_bsl"), F.col("iob"), F.col("cob")
    ratio, cf = F.col("insulin_to_carb_ratio"), F.col("correction_factor")
    tz = F.col("tz") if "tz" in state.columns else None
    adjustments = (
        F.col("circadian_adjustments") if "circadian_adjustments" in state.columns else None
    )
    factors = circadian.interpolated(circadian.local_time(F.col("as_of"), tz), adjustments)
    drunk = F.col("alcohol_in_system") > 0
    correction = F.when(
        bsl > CORRECT_ABOVE, clamp((bsl - F.col("target_bsl")) / cf, 0.0, MAX_CORRECTION)
    ).otherwise(F.lit(0.0))
    parts = state.select(
        "*",
        (F.col("carbs") / ratio).alias("carb_coverage"),
        correction.alias("correction_dose"),
        (-iob).alias("iob_adjustment"),
        F.when((cob > 20) & (bsl < 6), -cob / ratio * 0.25)
        .otherwise(F.lit(0.0))
        .alias("cob_adjustment"),
        factors["combined_factor"].alias("combined_factor"),
        drunk.alias("has_alcohol"),
    )
    wanted = F.col("carb_coverage") + F.col("correction_dose")
    parts = parts.withColumn(
        "alcohol_adjustment",
        F.when(drunk, -wanted * (F.lit(1.0) - F.col("sensitivity_modifier"))).otherwise(
            F.lit(0.0)
        ),
    ).withColumn("circadian_adjustment", wanted * F.col("combined_factor") - wanted)
    total = (
        wanted
        + F.col("iob_adjustment")
        + F.col("cob_adjustment")
        + F.col("alcohol_adjustment")
        + F.col("circadian_adjustment")
    )
    cautious = (
        F.when(bsl < CRITICAL_BSL, F.lit(0.0))
        .when(bsl < LOW_BSL, F.least(total, F.col("carb_coverage") * 0.5))
        .otherwise(total)
    )
    scored = parts.withColumn("cautious", cautious).withColumn(
        "stacking", insulin.stacking_risk(iob, F.col("cautious"), cf)
    )
    limited = F.when(
        F.col("stacking") == "high", F.least(F.col("cautious"), F.col("carb_coverage"))
    ).otherwise(F.col("cautious"))
    scored = scored.withColumn(
        "recommended_dose", _half_units(clamp(limited, 0.0, MAX_DOSE))
    ).withColumn("warnings", _warnings())
    return _with_interval(scored).drop("cautious", *values.USER_DEFAULTS)


def _warnings() -> Column:
    bsl, first_drink = F.col("current_bsl"), F.col("first_drink_units")
    drunk = F.col("has_alcohol")
    severity = alcohol.hypo_risk_severity(first_drink)
    return F.array_compact(
        F.array(
            F.when(bsl < CRITICAL_BSL, F.lit("BSL_CRITICAL")).when(
                bsl < LOW_BSL, F.lit("BSL_LOW")
            ),
            F.when(F.col("iob") > 2, F.lit("IOB_ACTIVE")),
            F.when(F.col("cob") > 20, F.lit("COB_ACTIVE")),
            F.when(drunk, F.lit("ALCOHOL")),
            F.when(
                drunk & (severity != "low"), F.concat(F.lit("HYPO_RISK_"), F.upper(severity))
            ),
            F.when(
                F.col("stacking") != "low", F.concat(F.lit("STACK_"), F.upper(F.col("stacking")))
            ),
        )
    )


def _with_interval(scored: DataFrame) -> DataFrame:
    dose, carbs = F.col("recommended_dose"), F.col("carbs")
    spread = dose * 0.15 + dose * 0.2
    spread = spread + F.when(F.col("has_alcohol"), dose * 0.3).otherwise(F.lit(0.0))
    spread = spread + F.when(F.col("current_bsl").isNull(), F.lit(1.0)).otherwise(F.lit(0.0))
    spread = spread + F.when(carbs > 60, (carbs - 60) / 100).otherwise(F.lit(0.0))
    sure = F.when(dose > 0, F.lit(1.0) - F.col("dose_spread") / dose).otherwise(F.lit(0.5))
    return (
        scored.withColumn("dose_spread", spread)
        .withColumn("lower", F.greatest(F.lit(0.0), _half_units(dose - F.col("dose_spread"))))
        .withColumn("upper", _half_units(dose + F.col("dose_spread")))
        .withColumn("confidence", clamp(sure, 0.3, 0.95))
    )


def fixed(x: Column) -> Column:
    """One decimal, halves away from zero."""
    return F.format_string("%.1f", F.signum(x) * half_up(F.abs(x), 1))


def explained(scored: DataFrame) -> DataFrame:
    """The score as lines of text."""

    def line(label: str, column: str, shown: Column, plus: bool = False) -> Column:
        sign = F.when(F.col(column) > 0, F.lit("+")).otherwise(F.lit("")) if plus else F.lit("")
        return F.when(shown, F.concat(F.lit(f"{label} "), sign, fixed(F.col(column)), F.lit("u")))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("dose "), fixed(F.col("recommended_dose")), F.lit("u")),
        F.concat(
            F.lit("sure "),
            F.floor(F.col("confidence") * 100 + 0.5).cast("string"),
            F.lit("% of "),
            fixed(F.col("lower")),
            F.lit("-"),
            fixed(F.col("upper")),
            F.lit("u"),
        ),
        line("carbs", "carb_coverage", F.col("carb_coverage") > 0, plus=True),
        line("correction", "correction_dose", F.col("correction_dose") > 0, plus=True),
        line("active insulin", "iob_adjustment", F.col("iob_adjustment") < 0),
        line("active carbs", "cob_adjustment", F.col("cob_adjustment") != 0),
        line("alcohol", "alcohol_adjustment", F.col("alcohol_adjustment") != 0),
        line(
            "time of day", "circadian_adjustment",
            F.abs(F.col("circadian_adjustment")) > 0.1, plus=True,
        ),
    )
    return scored.withColumn("explanation", text)
