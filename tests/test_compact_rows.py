"""Curves, decay totals and payloads: what is shuffled or parsed, and the same rows as plain loops."""

import json
import random
from bisect import bisect_left, bisect_right
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import BASE, at, event, utc_ms
from glycoflow.operators import curves
from glycoflow.operators.grid import Grid
from glycoflow.sources import payloads
from glycoflow.streaming import windows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def traced(spark):
    rng = random.Random(3)
    rows = [(s, i, at(0, rng.randint(0, 54_000_000)), float(rng.randint(3, 15)), 0.9) for s in (1, 2) for i in range(60 if s == 1 else 1)]
    points = spark.createDataFrame(rows, "series_id long, pos long, ts timestamp, value double, confidence double")
    axis = spark.createDataFrame(
        [(1, at(0), at(1440)), (2, at(0), at(1440)), (3, at(0), at(1440))], "series_id long, start_ts timestamp, end_ts timestamp"
    )
    return rows, points, axis


@pytest.mark.parametrize("block", [7, 4096])
def test_brackets_equal_a_search_of_every_instant(traced, block):
    rows, points, axis = traced
    got = curves.bracket(points, axis, block=block).collect()
    assert len(got) == 2 * 289
    for r in got:
        times = sorted(utc_ms(t) for s, _, t, _, _ in rows if s == r.series_id)
        i, j = bisect_right(times, r.at_ms), bisect_left(times, r.at_ms)
        assert (r.before and r.before.ms) == (times[i - 1] if i else None)
        assert (r.after and r.after.ms) == (times[j] if j < len(times) else None)


def test_the_instants_of_an_axis_are_made_after_the_last_shuffle(traced):
    _, points, axis = traced
    first = plan_of(curves.bracket(points, axis)).split("Exchange")[0]
    assert "Generate explode(sequence(" in first  # nearer to the result than any exchange


@pytest.mark.parametrize("block", [5, 4096])
def test_uniform_targets_equal_a_search_and_are_not_shuffled(spark, block):
    rng = random.Random(8)
    rows = [(s, i, float(rng.randint(0, 40)), float(rng.randint(0, 9))) for s in range(20) for i in range(s)]
    rows += [(50, 0, 4.0, 1.0), (50, 1, 4.0, 2.0), (None, 0, 0.0, 1.0), (None, 1, 10.0, 3.0)]
    points = spark.createDataFrame(rows, "series_id long, pos long, x double, y double")
    out = curves.resample_uniform(points, 50, block)
    top = plan_of(out).split("Union")[1].split("Exchange")[0]
    assert "Generate explode(sequence(" in top
    got = {}
    for r in out.collect():
        got.setdefault(r.series_id, {})[r.position] = (r.x, r.y)
    assert set(got) == set(range(1, 20)) | {50, None}
    assert [got[50][i] for i in range(50)] == [(4.0, 1.0)] * 50
    for s in [*range(2, 20), None]:
        own = [(x, pos, y) for sid, pos, x, y in rows if sid == s]
        low, high = min(own)[0], max(own)[0]
        assert sorted(got[s]) == list(range(50))
        for i, (x, y) in got[s].items():
            assert x == low + i * ((high - low) / 49.0)
            left = [k for k in own if k[0] < x]
            right = [k for k in own if k[0] >= x]
            if not left:
                want = min(own)[2]
            elif not right:
                want = min(own)[2] + (x - low) / (high - low) * (max(own)[2] - min(own)[2])
            else:
                a, b = max(left), min(right)
                want = a[2] + (x - a[0]) / (b[0] - a[0]) * (b[2] - a[2])
            assert y == pytest.approx(want, abs=1e-9)


def test_points_without_x_leave_the_first_target_unknown(spark):
    rows = [(1, 0, None, 7.0), (1, 1, 2.0, 4.0), (1, 2, 6.0, 8.0)]
    out = curves.resample_uniform(spark.createDataFrame(rows, "series_id long, pos long, x double, y double"), 5)
    assert [(r.x, r.y) for r in out.orderBy("position").collect()] == [(2.0, None), (3.0, 5.0), (4.0, 6.0), (5.0, 7.0), (6.0, 8.0)]


def test_decay_totals_of_a_batch_shuffle_no_instant(make_log):
    log = make_log([event("d1", at(1400), "insulin", 4.0), event("m1", at(1430), "meal", 30.0)])
    out = windows.decay_totals(log, Grid(BASE, BASE + timedelta(days=2)))
    assert not [x for x in plan_of(out).splitlines() if "Exchange" in x and ("idx#" in x or "at_ts#" in x)]
    assert out.count() == out.select("subject_id", "at_ts").distinct().count() == 48


def test_payloads_are_parsed_once(spark):
    full = {"graphData": [{"Value": 90.0, "Timestamp": "2025-01-01T00:00:00"}] * 3,
            "glucoseMeasurement": {"Value": 90.0, "Timestamp": "2025-01-01T00:00:00", "TrendArrow": 3, "isHigh": False, "isLow": False}}
    bodies = [json.dumps({"data": full}), json.dumps({"data": {"graphData": []}}), "{", None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc long, body string")
    readings, current = payloads.libre_readings(docs, "body", max_count=2), payloads.libre_current(docs, "body")
    for out in (readings, current):
        assert plan_of(out.select(F.col("value"))).count("from_json(") == 1
    assert [r.doc for r in readings.collect()] == [0, 0] and [r.doc for r in current.collect()] == [0]
