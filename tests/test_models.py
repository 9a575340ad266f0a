"""Plans against an independent plain-Python calculation on a small log."""

import math
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import BASE, at, event, utc_ms
from glycoflow.functions.text import glycemic_index  # noqa: F401  (documents the rule used below)
from glycoflow.operators import log as log_ops
from glycoflow.operators.grid import Grid
from glycoflow.plans import dose, predict, state, tuning

ROWS = [
    event("g1", at(-11 * 60), "bsl", 6.5), event("g2", at(30), "bsl", 8.0), event("g2b", at(30), "bsl", 8.4),
    event("g3", at(1500), "bsl", 4.2),
    event("d1", at(0), "insulin", 4.0, type="bolus"), event("d2", at(10, 1), "insulin", 2.0),
    event("d3", at(-600), "insulin", 15.0, type="basal"), event("d4", at(-1500), "insulin", 9.0, type="basal"),
    event("m1", at(5), "meal", 50.0), event("m2", at(20), "meal", 0.0, carbs=30.0, description="whole grain bread"),
    event("m3", at(40), "meal", 12.0, carbs=0.0),
    event("a1", at(60), "meal", 0.0, carbs=0.0, alcohol_units=2.0, alcohol_type="beer"),
    event("a2", at(90), "meal", 0.0, carbs=0.0, alcohol_units=1.0),
    event("a3", at(-420), "meal", 0.0, carbs=0.0, alcohol_units=3.0, alcohol_type="spirit"),
    event("x", at(60), "insulin", 3.0, subject=2, type="bolus"),
]
INSULIN = {"bolus": (15, 240, 55), "basal": (90, 1440, 300)}
DRINK = {"beer": (20, 0.85, 720), "spirit": (15, 0.75, 960), "mixed": (25, 0.8, 720)}


def plain_state(subject, t_ms, start_ms, meal_back=6):
    out = {"iob": 0.0, "cob": 0.0, "sys": 0.0, "mod": 1.0, "bsl": None, "bsl_ms": None}
    best = None
    for id, sub, ts, kind, value, meta, *_ in ROWS:
        ms = utc_ms(ts)
        m = (t_ms - ms) / 60000
        if sub != subject or m < 0:
            continue
        type_, carbs, description, units, drink = meta[0], meta[5], meta[9], meta[11], meta[12]
        if kind == "insulin" and ms >= start_ms - 24 * 3600000:
            onset, duration, half = INSULIN[type_ or "bolus"]
            if m < duration:
                a, b = half * 1.4, onset * 0.7
                out["iob"] += value * (a * math.exp(-m / a) - b * math.exp(-m / b)) / (a - b)
        if kind == "meal" and ms >= start_ms - meal_back * 3600000:
            grams = value if carbs is None else carbs
            gi = 75 if description else 60
            peak, duration = 120 - gi * 0.9, 120 + (100 - gi) * 1.8
            half = duration / 3
            if grams > 0 and m < duration:
                k = peak / half
                taken = (grams * (m / peak) ** (k + 1) * peak / ((k + 1) * duration) if m < peak
                         else 0.4 * grams + 0.6 * grams * (1 - math.exp(-(m - peak) / half)))
                out["cob"] += grams - taken
            if units:
                half, low, effect = DRINK[drink or "mixed"]
                if m < max(units * 10 / 8 * 60, effect):
                    absorbed = units * 10 * (1 - math.exp(-m / half))
                    out["sys"] += max(0, absorbed - min(absorbed, 8 * m / 60))
                    out["mod"] *= (1 - (1 - low) * m / 60 if m < 60 else low + (1 - low) * (m - 60) / (effect - 60))
        if kind == "bsl" and ms >= start_ms - 12 * 3600000 and (best is None or (ms, id) > best):
            best = (ms, id)
            out["bsl"], out["bsl_ms"] = value, ms
    return out


@pytest.fixture(scope="module")
def log(make_log):
    return make_log(ROWS)


def subjects_of(log):
    return log.select("subject_id").distinct()


@pytest.mark.parametrize("meal_back", [6, 16])
def test_state_equals_a_plain_loop(log, meal_back):
    grid = Grid(BASE, BASE + timedelta(hours=30), 10)
    got = state.metabolic_state(log, grid, subjects_of(log), meal_lookback_hours=meal_back).collect()
    assert len(got) == 2 * 181
    for r in got:
        want = plain_state(r.subject_id, utc_ms(r.at_ts), utc_ms(BASE), meal_back)
        assert r.iob == pytest.approx(want["iob"], abs=1e-9)
        assert r.cob == pytest.approx(want["cob"], abs=1e-9)
        assert r.alcohol_in_system == pytest.approx(want["sys"], abs=1e-9)
        assert r.sensitivity_modifier == pytest.approx(want["mod"], abs=1e-9)
        assert (r.last_bsl, r.last_bsl_ms) == (want["bsl"], want["bsl_ms"])
        assert 0 <= r.iob


def test_contributions_add_up_to_the_totals(log):
    grid = Grid(BASE, BASE + timedelta(hours=5))
    parts = state.contributions(log, grid, "dose").groupBy("subject_id", "idx").agg(F.sum("iob").alias("s"))
    at_ts = F.timestamp_millis(grid.at_ms(F.col("idx")))
    total = state.insulin_on_board(log, grid, subjects_of(log))
    joined = total.join(parts.withColumn("at_ts", at_ts), ["subject_id", "at_ts"], "left").fillna(0.0)
    assert joined.filter(F.abs(F.col("iob") - F.col("s")) > 1e-9).count() == 0
    falling = state.contributions(log, grid, "dose").filter("id = 'd1'").orderBy("idx").collect()
    assert all(a.iob > b.iob for a, b in zip(falling, falling[1:]))


def test_user_parameters_replace_the_defaults(spark, log):
    params = spark.createDataFrame(
        [(1, 8.0, None, 90.0, "Australia/Sydney")],
        "subject_id long, insulin_to_carb_ratio double, target_bsl double, body_weight_kg double, tz string",
    )
    grid = Grid(BASE, BASE + timedelta(hours=2), 30)
    rows = predict.glucose_series(log, grid, subjects_of(log), BASE, params).collect()
    ours = {r.subject_id: r for r in rows if r.idx == 4}
    assert (ours[1].insulin_to_carb_ratio, ours[1].target_bsl, ours[1].correction_factor) == (8.0, 6.0, 2.0)
    assert ours[1].hour == 13 and ours[2].insulin_to_carb_ratio == 10.0


def test_a_modifier_below_one_weakens_insulin_in_predictions(log):
    grid = Grid(BASE, BASE + timedelta(hours=3), 30)
    known = state.metabolic_state(log, grid, subjects_of(log))
    rows = predict.prediction_factors(known, BASE).filter("subject_id = 1 and sensitivity_modifier < 1").collect()
    assert rows and all(abs(r.insulin_effect) < r.iob * 2.0 for r in rows)


def test_without_a_reading_time_runs_from_as_of(log):
    grid = Grid(BASE, BASE + timedelta(hours=1), 30)
    rows = predict.glucose_series(log, grid, subjects_of(log), BASE).filter("subject_id = 2").orderBy("idx").collect()
    assert [r.current_bsl for r in rows] == [6.0] * 3
    assert [round(r.uncertainty, 6) for r in rows] == [1.5, 2.1, 2.7]


def test_alert_runs_look_at_the_previous_unfiltered_alert(spark):
    grid = Grid(BASE, BASE + timedelta(hours=30), 5)
    calm, low, high, both = (5.5, 7.0), (3.0, 7.0), (5.5, 12.0), (3.0, 12.0)
    plan = {0: low, 1: low, 2: calm, 7: low, 8: low, 15: low, 20: high, 21: low, 22: both, 23: high, 286: low, 289: low, 300: low}
    rows = [(1, i, at(5 * i), 5.0, *plan.get(i, calm)) for i in range(grid.last + 1)]
    series = spark.createDataFrame(
        rows, "subject_id long, idx long, at_ts timestamp, predicted_bsl double, lower_bound double, upper_bound double"
    )
    got = [((utc_ms(r.predicted_ts) - utc_ms(BASE)) // 300000, r.type) for r in predict.alerts(series, grid).collect()]
    kept, previous = [], None
    for i in sorted(plan):
        lower, upper = plan[i]
        for kind, hit in (("hypo", lower < 4), ("hyper", upper > 10)):
            if hit:
                if previous is None or previous[1] != kind or (i - previous[0]) * 5 > 30:
                    kept.append((i, kind))
                previous = (i, kind)
    assert sorted(got) == sorted(kept)


def test_dose_scoring_codes_and_limits(spark, log):
    requests = spark.createDataFrame(
        [("low", 1, at(100), 60.0, 3.5), ("lowish", 1, at(100), 60.0, 4.5), ("unknown", 2, at(60, 1), 80.0, None),
         ("correct", 3, at(100), 0.0, 12.0), ("stacked", 3, at(100), 0.0, 16.0), ("huge", 3, at(100), 900.0, 6.0)],
        "request_id string, subject_id long, as_of timestamp, carbs double, current_bsl double",
    )
    got = {r.request_id: r for r in dose.score_doses(log, requests).collect()}
    assert got["low"].recommended_dose == 0 and got["low"].warnings[0] == "BSL_CRITICAL"
    assert got["lowish"].warnings[0] == "BSL_LOW" and got["lowish"].recommended_dose <= 3.0
    assert "ALCOHOL" in got["low"].warnings and got["low"].first_drink_units == 2.0
    assert got["unknown"].iob == pytest.approx(3.0, abs=1e-3) and got["unknown"].confidence < 0.65
    assert got["correct"].correction_dose == 3.0 and got["correct"].carb_coverage == 0
    assert got["huge"].recommended_dose == 30.0
    # A high stacking risk limits the dose to the carb part, which a pure correction lacks.
    assert (got["stacked"].stacking, got["stacked"].recommended_dose) == ("high", 0.0)
    text = {r.request_id: r.explanation for r in dose.explained(dose.score_doses(log, requests)).collect()}
    assert text["correct"].startswith("dose 2.5u\n") and "correction +3.0u" in text["correct"]


def test_ratio_tuning_needs_five_pairs_and_strict_half_hours(spark, make_log):
    def meal_set(n, after, gap=29):
        rows = []
        for i in range(n):
            t = i * 600
            rows += [event(f"m{i}", at(t), "meal", 40.0), event(f"i{i}", at(t + gap), "insulin", 4.0, type="bolus"),
                     event(f"b{i}", at(t + 120), "bsl", after)]
        return make_log(rows)

    def suggest(log):
        return tuning.ratio_suggestions(log, subjects_of(log)).first()

    assert suggest(meal_set(4, 12.0)).finding == "INSUFFICIENT"
    high = suggest(meal_set(6, 12.0))
    assert (high.suggested_ratio, high.finding, high.data_points) == (9.0, "MOSTLY_HIGH", 6)
    assert suggest(meal_set(6, 4.0)).suggested_ratio == 11.5
    assert suggest(meal_set(6, 6.0)).finding == "WORKING"
    assert suggest(meal_set(6, 6.0, gap=30)).data_points == 0


def test_overnight_pattern_counts_hour_three_twice(spark):
    def find(pairs):
        rows = [(1, BASE + timedelta(hours=h), v) for h, v in pairs]
        return tuning.overnight_patterns(spark.createDataFrame(rows, "subject_id long, ts timestamp, value double")).first()

    assert find([(1, 5.0), (4, 9.0)]).finding == "INSUFFICIENT"
    assert find([(4, 5.0), (5, 9.0), (6, 9.0)]).finding == "NO_DATA_IN_WINDOW"
    dawn = find([(1, 5.0), (3, 5.0), (5, 8.0), (6, 8.0)])
    assert dawn.finding == "DAWN" and dawn.rise == pytest.approx(2.0)
    assert dawn.suggested_adjustments[6] == pytest.approx(1 + (2 / 3) * 0.25)


def test_latest_by_type_takes_the_latest(log):
    assert [r.id for r in log_ops.of_type(log, "bsl", 1).collect()] == ["g3"]


def test_window_lookback_boundary(make_log):
    log = make_log([event("in", at(-720), "bsl", 5), event("out", at(-720, -1), "bsl", 5)])
    assert [r.id for r in log_ops.event_window(log, BASE, BASE).collect()] == ["in"]
