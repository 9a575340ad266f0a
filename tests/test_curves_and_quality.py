"""Resampling, calibration, foods and presets on small fixtures."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import at, utc_ms
from glycoflow.operators import accuracy, calibration, curves, foods, presets


def points(spark, rows):
    return spark.createDataFrame(rows, "series_id long, pos int, ts timestamp, value double, confidence double")


def axis(spark, *series):
    return spark.createDataFrame([(s, at(0), at(30)) for s in series], "series_id long, start_ts timestamp, end_ts timestamp")


def test_resampling_edges(spark):
    rows = points(spark, [(1, 0, at(7), 5.0, 0.8), (1, 1, at(17), 7.0, 0.6), (1, 2, at(17), 9.0, 0.6), (2, 0, at(3), 4.44, 0.5)])
    both = axis(spark, 1, 2)

    def run(style):
        out = curves.resample(rows, both, 5, style).collect()
        return sorted((r.series_id, (utc_ms(r.ts) - utc_ms(at(0))) / 60000, r.value, round(r.confidence, 6)) for r in out)

    lone = (2, 3.0, 4.44, 0.5)
    assert run("model") == [
        (1, 10.0, 5.6, 0.582), (1, 15.0, 6.6, 0.552), (1, 20.0, 7.0, 0.48), (1, 25.0, 7.0, 0.48), (1, 30.0, 7.0, 0.48), lone,
    ]
    assert run("freestyle-libre") == [(1, 10.0, 5.6, 0.6), (1, 15.0, 6.6, 0.6), lone]
    assert run("dexcom") == [(1, 10.0, 6.0, 0.6), (1, 15.0, 7.0, 0.6), lone]
    nearest = run("nearest")
    assert (1, 0.0, 5.0, 0.24) in nearest and (1, 25.0, 7.0, 0.12) in nearest and len(nearest) == 7


def test_nearest_tie_goes_to_the_earlier_sample(spark):
    rows = points(spark, [(1, 0, at(8), 1.0, 1.0), (1, 1, at(12), 2.0, 1.0)])
    got = {utc_ms(r.ts): r.value for r in curves.resample(rows, axis(spark, 1), 10, "nearest").collect()}
    assert got[utc_ms(at(10))] == 1.0


def test_upper_median_ignores_how_often_copies_occur(spark):
    rows = [(1, 0, y) for y in (5, 1, 9, 7)] + [(1, 1, 3)] * 1000 + [(1, 1, 8)] * 1000
    got = curves.column_medians(spark.createDataFrame(rows, "series_id long, x long, y long"))
    assert {r.x: r.y for r in got.collect()} == {0: 7.0, 1: 8.0}


def test_short_series_are_left_alone(spark):
    rows = [(1, 0, 3.0, 1.0), (1, 1, 1.0, 2.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 3.0), (2, 2, 2.0, 5.0), (2, 3, 2.0, 7.0)]
    df = spark.createDataFrame(rows, "series_id long, pos int, x double, y double")
    got = sorted((r.series_id, r.position, r.x, r.y) for r in curves.smooth_to(df.drop("pos"), 10).collect())
    assert got == [(1, 0, 1.0, 2.0), (1, 1, 3.0, 1.0), (2, 0, 1.0, 2.0), (2, 1, 2.0, 6.0)]
    one = curves.resample_uniform(df.filter("series_id = 1 and pos = 0"), 5).collect()
    assert [(r.x, r.y) for r in one] == [(3.0, 1.0)]


def js_fold(ratios):
    factor = None
    for r in ratios:
        value = r if factor is None else 0.3 * r + 0.7 * factor
        factor = math.floor(value * 1000 + 0.5) / 1000
    return factor


CORRECTIONS = "food_type_id string, ts timestamp, seq long, estimated double, corrected double"


def test_calibration_golden(spark):
    rows = [("f", at(2), 2, 10.0, 8.0), ("f", at(1), 1, 10.0, 12.0), ("f", at(3), 3, 10.0, 11.0), ("f", at(4), 4, 0.0, 9.0), ("z", at(1), 1, 0.0, 1.0)]
    got = calibration.calibrate(spark.createDataFrame(rows, CORRECTIONS)).collect()
    assert [(r.food_type_id, r.correction_factor, r.sample_count) for r in got] == [("f", 1.086, 3)]


@pytest.mark.parametrize("wild", [1.0, 5000.0])
def test_ordered_chunks_replay_the_fold_exactly(spark, wild):
    rnd = random.Random(11)
    foods_ = {f"f{i}": [rnd.choice([rnd.uniform(0, 2), rnd.uniform(0, wild)]) for _ in range(n)] for i, n in enumerate((4000, 1500, 37, 3))}
    rows = [(name, at(i // 3), i, 1.0, ratio) for name, ratios in foods_.items() for i, ratio in enumerate(ratios)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, CORRECTIONS).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {r.food_type_id: (r.correction_factor, r.sample_count) for r in calibration.calibrate(df, chunk=130).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {name: (js_fold(ratios), len(ratios)) for name, ratios in foods_.items()}


def test_unusable_corrections_are_left_out_and_counted(spark):
    rows = [("f", at(i), i, e, c) for i, (e, c) in enumerate([(10.0, 12.0), (10.0, None), (10.0, float("nan")), (None, 3.0), (0.0, 3.0), (1e-300, 9.0), (10.0, 8.0)])]
    df = spark.createDataFrame(rows, CORRECTIONS)
    for chunk in (1, 3, 1000):
        got = calibration.calibrate(df, chunk=chunk).first()
        assert (got.correction_factor, got.sample_count) == (1.08, 2)
    assert calibration.unusable(df).first().n == 5


def test_food_dimension(spark):
    dim = foods.foods(spark)
    assert dim.count() == 69 and foods.categories(dim).count() == 8
    picks = [r.name for r in foods.popular(dim).collect()]
    assert len(picks) == 12 and picks[8:] == ["Brown Rice (cooked)", "Pasta (cooked)", "White Bread", "Whole Wheat Bread"]
    queries = spark.createDataFrame([(1, "Tomato"), (2, "  "), (3, "zzz")], "query_id int, query string")
    found = [(r.query_id, r.rank, r.food_id, r.score) for r in foods.search(queries).collect()]
    assert found == [(1, 1, "tomato", 115), (1, 2, "sauce-tomato", 65)] or found[0] == (1, 1, "tomato", 115)


def test_unknown_provider_metrics_are_absent_and_null_categories_ignored(spark):
    rows = [(1, "a", None, 10.0, 12.0)]
    cols = [f"{side}_{n}" for side in ("predicted", "corrected") for n in ("calories", "carbs", "protein", "fat")]
    df = spark.createDataFrame([("x", 0.5, *[float(i) for i in range(8)]), (None, 0.5, *[0.0] * 8)],
                               "category string, confidence double, " + ", ".join(f"{c} double" for c in cols))
    got = accuracy.correction_patterns(df).collect()
    assert [(r.category, r.over_carbs, r.under_carbs, r.over_overall) for r in got] == [("x", 0.0, 4.0, 0.0)]
    assert rows


@pytest.mark.parametrize(
    "strategy, kept, totals, counts",
    [
        ("skip", {("e", "x"), ("b2", "y")}, {"e": 1.0, "b2": 20.0}, (1, 3)),
        ("replace", {("b3", "x"), ("b4", "y")}, {"b3": 30.0, "b4": 40.0}, (4, 0)),
        ("merge", {("e", "x"), ("b2", "y")}, {"e": 41.0, "b2": 60.0}, (4, 0)),
    ],
)
def test_preset_import_meets_repeated_names_in_order(spark, strategy, kept, totals, counts):
    existing = spark.createDataFrame([("e", "x")], "preset_id string, name string")
    batch = spark.createDataFrame([("b1", "x", 1), ("b2", "y", 2), ("b3", "x", 3), ("b4", "y", 4)], "preset_id string, name string, seq long")
    schema = "preset_id string, pos int, calories double, carbs double, protein double, fat double"
    old = spark.createDataFrame([("e", 0, 0.0, 1.0, 0.0, None)], schema)
    new = spark.createDataFrame([(f"b{i}", 0, 0.0, i * 10.0, 0.0, None) for i in (1, 2, 3, 4)], schema)
    held, items = presets.import_presets(existing, old, batch, new, strategy)
    assert {tuple(r) for r in held.select("preset_id", "name").collect()} == kept
    assert {r.preset_id: r.carbs for r in presets.totals(items).collect()} == totals
    assert tuple(presets.import_counts(existing, batch, strategy).first()) == counts


@pytest.mark.parametrize("stamps", ["many", "few"])
def test_places_of_many_stamps_are_not_counted_in_one_task(spark, stamps):
    rng = random.Random(3)
    rows = [(i, rng.randrange(10**9) if stamps == "many" else rng.randrange(5)) for i in range(3000)]
    rows += [(i, None) for i in range(3000, 3010)] + [(i, rows[0][1]) for i in range(3010, 3020)]
    out = accuracy.with_place(spark.createDataFrame(rows, "id long, stamp long"), "stamp", "id")
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.stamp) for r in sorted(out.collect(), key=lambda r: r.place)] == want
    assert sorted(r.place for r in out.collect()) == list(range(1, len(rows) + 1))
    # A window over all stamps would begin with their order.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"windowspecdefinition\(_?stamp#\d+L? DESC", plan)


def test_places_of_no_rows(spark):
    assert accuracy.with_place(spark.createDataFrame([], "id long, stamp long"), "stamp", "id").count() == 0
