"""Long series in blocks give what one window over the whole series gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import at, utc_ms
from glycoflow.operators import curves
from glycoflow.operators.ordered import known_around, numbered


def series(spark, rng, n=120):
    rows = []
    for s in (1, 2, None):
        x = -50
        for _ in range(n if s != 2 else 3):
            x += rng.choice([1, 1, 1, 2, 37])
            rows.append((s, x, float(rng.randint(0, 90))))
    return spark.createDataFrame(rows, "series_id long, x long, y double").repartition(5)


def rounded(df):
    return sorted((r.series_id or 0, r.x, round(r.y, 9)) for r in df.collect())


@pytest.mark.parametrize("block", [4, 7, 4096])
def test_smoothing_at_block_edges(spark, block):
    df = series(spark, random.Random(block))
    order = Window.partitionBy("series_id").orderBy("x")
    want = df.withColumn("y", F.avg("y").over(order.rowsBetween(-2, 2)))
    assert rounded(curves.smooth_mean(df, 2, block)) == rounded(want)
    assert rounded(curves.smooth_weighted(df, 3, block)) == rounded(curves.smooth_weighted(df, 3, 100_000))
    by_hand = {}
    for s, x, y in sorted((r.series_id or 0, r.x, r.y) for r in df.collect()):
        by_hand.setdefault(s, []).append((x, y))
    got = {(r.series_id or 0, r.x): r.y for r in curves.smooth_weighted(df, 3, block).collect()}
    for s, points in by_hand.items():
        for i, (x, _) in enumerate(points):
            near = [(1 / (1 + abs(k) * 0.5), points[i + k][1]) for k in range(-3, 4) if 0 <= i + k < len(points)]
            assert got[s, x] == pytest.approx(sum(w * y for w, y in near) / sum(w for w, _ in near))


def test_halo_needs_room(spark):
    with pytest.raises(ValueError, match="block"):
        curves.smooth_mean(series(spark, random.Random(1)), 5, 4)


@pytest.mark.parametrize("width", [3, 4096])
def test_places_and_running_sums(spark, width):
    df = series(spark, random.Random(2))
    got = sorted((r.series_id or 0, r["_at"], r.x, r["_sum_y"]) for r in numbered(df, ["series_id"], "x", width, ("y",)).collect())
    want, place, total, last = [], 0, 0.0, None
    for s, x, y in sorted((r.series_id or 0, r.x, r.y) for r in df.collect()):
        place, total = (place + 1, total + y) if s == last else (1, y)
        last = s
        want.append((s, place, x, total))
    assert got == want


@pytest.mark.parametrize("block", [5, 4096])
def test_resampling_does_not_depend_on_blocks(spark, block):
    rng = random.Random(block)
    df = series(spark, rng).filter("series_id IS NOT NULL").withColumn("pos", F.lit(0))
    one, many = (sorted((r.series_id, r.position, round(r.x, 6), round(r.y, 6)) for r in curves.resample_uniform(df, 40, b).collect()) for b in (10**9, block))
    assert one == many
    few = df.select("series_id", F.col("x").cast("double").alias("x"), "y")
    one, many = (sorted((r.series_id, r.position, round(r.x, 6), round(r.y, 6)) for r in curves.smooth_to(few, 11, b).collect()) for b in (10**9, block))
    assert one == many


def test_bracket_over_blocks_without_samples(spark):
    points = spark.createDataFrame([(1, 0, at(3), 5.0, 1.0), (1, 1, at(400), 7.0, 1.0)], "series_id long, pos int, ts timestamp, value double, confidence double")
    axis = spark.createDataFrame([(1, at(0), at(600)), (2, at(0), at(50)), (3, at(50), at(0))], "series_id long, start_ts timestamp, end_ts timestamp")
    got = {(r.series_id, (r.at_ms - utc_ms(at(0))) // 60000): (r.before and r.before.value, r.after and r.after.value) for r in curves.bracket(points, axis, 5, 4).collect()}
    want = {(1, m): (None if m < 3 else 5.0 if m < 400 else 7.0, 5.0 if m <= 3 else 7.0 if m <= 400 else None) for m in range(0, 601, 5)}
    assert got == want


def test_one_series_spreads_over_many_tasks(spark):
    df = spark.range(40_000).select(F.lit(1).alias("series_id"), F.col("id").alias("k"), F.when(F.col("id") % 50 == 0, F.col("id")).alias("v"))
    rows = df.withColumn("block", F.floor(F.col("k") / 1000))
    out = known_around(rows, ["series_id"], "block", ["k"], ("v", "before"), ("v", "after"))
    keys = "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"
    old = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, ("false", "10m"), strict=True):
            spark.conf.set(k, v)
        tasks = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert out.filter("before <> k - k % 50 OR (k <= 39950 AND after <> k + (50 - k % 50) % 50)").count() == 0
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)
