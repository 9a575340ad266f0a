"""Traced glucose curves: column medians, smoothing, scaling to values, resampling.

Series are handled in blocks: neighbours are copied over the edges of a block, running sums and last
known samples are carried from block to block by one row each, so a series of any length spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions.jsmath import half_up
from glycoflow.operators.ordered import known_around, numbered, with_blocks, with_halo


#: Points in a block, which are at most as many distinct x.
BLOCK = 4096


def column_medians(pixels: DataFrame, x_from: int | None = None, x_to: int | None = None):
    """Upper median of y per (series_id, x), optionally only x in [x_from, x_to).

    Pixels are counted per y first, so a crowded column is a handful of counts and the
    median is where the running count passes half.
    """
    if x_from is not None:
        pixels = pixels.filter(F.col("x") >= x_from)
    if x_to is not None:
        pixels = pixels.filter(F.col("x") < x_to)
    counts = pixels.groupBy("series_id", "x", "y").agg(F.count(F.lit(1)).alias("_n"))
    column = Window.partitionBy("series_id", "x")
    up_to = column.orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        counts.withColumn("_seen", F.sum("_n").over(up_to))
        .withColumn("_half", F.floor(F.sum("_n").over(column) / 2))
        .filter((F.col("_seen") > F.col("_half")) & (F.col("_seen") - F.col("_n") <= F.col("_half")))
        .select("series_id", "x", F.col("y").cast("double").alias("y"))
    )


def smooth_mean(points: DataFrame, reach: int = 2, block: int = BLOCK) -> DataFrame:
    """Centred moving average of 2*reach+1 points, shorter at the ends."""
    dealt, order = with_halo(numbered(points, ["series_id"], "x", block), ["series_id"], reach, block)
    smooth = dealt.withColumn("y", F.avg("y").over(order.rowsBetween(-reach, reach)))
    return smooth.filter("_own").select(*points.columns)


def smooth_weighted(points: DataFrame, reach: int = 3, block: int = BLOCK) -> DataFrame:
    """Centred average with weights 1/(1 + d/2), renormalised at the ends."""
    dealt, order = with_halo(numbered(points, ["series_id"], "x", block), ["series_id"], reach, block)
    total = weight = None
    for step in range(-reach, reach + 1):
        y = F.lag("y", -step).over(order)
        w = 1.0 / (1.0 + abs(step) * 0.5)
        term = F.coalesce(y * w, F.lit(0.0))
        share = F.when(y.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
        total = term if total is None else total + term
        weight = share if weight is None else weight + share
    return dealt.withColumn("y", total / weight).filter("_own").select(*points.columns)


def average_by_x(points: DataFrame) -> DataFrame:
    return points.groupBy("series_id", "x").agg(F.avg("y").alias("y"))


def smooth_to(points: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """Moving average over point indexes down to `n` points per series.

    Series of fewer than four points come back as they are; of fewer than four distinct x
    as their averages. Window sums are differences of running sums, found by equality on
    the index, so no index range is joined.
    """
    size = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("_raw"))
    known = average_by_x(points).join(size.filter("_raw >= 4"), "series_id")
    averaged = numbered(known, ["series_id"], "x", block, sums=("x", "y")).withColumnsRenamed(
        {"_sum_x": "_sx", "_sum_y": "_sy"}
    )
    lengths = averaged.groupBy("series_id").agg(F.max("_at").alias("_len"))
    length = F.col("_len")
    width = F.greatest(F.lit(3).cast("bigint"), F.floor(length / n))
    centre = F.floor(F.col("position") / F.lit(float(n)) * length)
    spans = (
        lengths.filter(length >= 4)
        .withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select(
            "series_id",
            F.col("position").cast("bigint").alias("position"),
            F.greatest(F.lit(0).cast("bigint"), centre - F.floor(width / 2)).alias("_from"),
            F.least(length, centre + F.ceil(width / 2)).alias("_to"),
        )
        .filter(F.col("_to") > F.col("_from"))
    )

    def sums(name: str) -> DataFrame:
        return averaged.select(
            "series_id",
            F.col("_at").cast("bigint").alias(name),
            F.col("_sx").alias(f"{name}_x"),
            F.col("_sy").alias(f"{name}_y"),
        )

    zero, count = F.lit(0.0), F.col("_to") - F.col("_from")
    smoothed = (
        spans.join(sums("_to"), ["series_id", "_to"])
        .join(sums("_from"), ["series_id", "_from"], "left")
        .select(
            "series_id",
            "position",
            ((F.col("_to_x") - F.coalesce("_from_x", zero)) / count).alias("x"),
            ((F.col("_to_y") - F.coalesce("_from_y", zero)) / count).alias("y"),
        )
    )

    def in_order(rows: DataFrame) -> DataFrame:
        by_point = Window.partitionBy("series_id").orderBy("x", "y")
        return rows.select(
            "series_id",
            (F.row_number().over(by_point) - 1).cast("bigint").alias("position"),
            F.col("x").cast("double").alias("x"),
            F.col("y").cast("double").alias("y"),
        )

    short = in_order(averaged.join(lengths.filter(length < 4), "series_id", "left_semi"))
    few = in_order(points.join(size.filter("_raw < 4"), "series_id", "left_semi"))
    return smoothed.unionByName(short).unionByName(few)


def resample_uniform(points: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """`n` evenly spaced x per series, linear in between. Points: series_id, pos, x, y.

    Equal x are kept as their first and last y in `pos` order: a target just right of them
    starts from the last, one at or left of them ends at the first.
    """
    knots = points.groupBy("series_id", "x").agg(
        F.min_by("y", "pos").alias("y_first"), F.max_by("y", "pos").alias("y_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    ends = (
        knots.groupBy("series_id")
        .agg(
            F.min("x").alias("x_min"),
            F.max("x").alias("x_max"),
            F.min_by("y_first", "x").alias("y_start"),
            F.max_by("y_last", "x").alias("y_end"),
            F.sum("_n").alias("n_points"),
            F.bool_or(F.col("x").isNull()).alias("_unplaced"),
        )
    )
    # Each knot with the next one makes the targets between them, so only knots are ordered.
    step = (F.col("x_max") - F.col("x_min")) / F.lit(float(n - 1))
    knot = F.struct(F.col("x").alias("x"), "y_first", "y_last")
    keys = ["series_id", "_block"]
    placed = knots.select(
        "series_id", "x", knot.alias("left"), F.floor(F.col("x") / F.lit(float(block))).alias("_block")
    )
    blocks = placed.groupBy(*keys).agg(F.min_by("left", "x").alias("_knot"))
    following = blocks.select(
        *keys, F.lead("_knot").over(Window.partitionBy("series_id").orderBy("_block")).alias("_knot")
    )
    next_knot = F.lead("left").over(Window.partitionBy(*keys).orderBy("x"))
    pairs = with_blocks(placed.withColumn("_next", next_knot), following, keys).select(
        "series_id", "left", F.coalesce("_next", "_knot").alias("right")
    )
    pairs = with_blocks(pairs, ends.filter("n_points >= 2"), ["series_id"])

    def place(x: Column) -> Column:
        """Position of x among the targets, one off at most."""
        return F.coalesce(F.try_divide(x - F.col("x_min"), step), F.lit(0.0))

    # Positions a little beyond both knots; which target lies between them is asked of its x below.
    low = F.greatest(F.lit(0.0), F.floor(place(F.col("left.x"))) - 1)
    high = F.when(F.col("right").isNull(), F.lit(n - 1.0)).otherwise(
        F.least(F.lit(n - 1.0), F.ceil(place(F.col("right.x"))) + 1)
    )
    x, first_x = F.col("x"), F.col("left.x") == F.col("x_min")
    between = (x > F.col("left.x")) & (F.col("right").isNull() | (x <= F.col("right.x")))
    targets = pairs.select(
        "*", F.explode(F.sequence(low.cast("int"), F.greatest(low, high).cast("int"))).alias("position")
    ).withColumn("x", F.col("x_min") + F.col("position") * step)
    at_start = F.col("x_min").isNull() | (first_x & (x <= F.col("x_min")))
    placed = targets.filter(between | at_start).withColumn(
        "left", F.when(x > F.col("x_min"), F.col("left"))
    )
    ratio = (F.col("x") - F.col("left.x")) / (F.col("right.x") - F.col("left.x"))
    whole = (F.col("x") - F.col("x_min")) / (F.col("x_max") - F.col("x_min"))
    # Points without x come before all others, so what the first target starts from is not known.
    y = (
        F.when(F.col("left").isNull(), F.when(~F.col("_unplaced") | F.col("right").isNull(), F.col("y_start")))
        .when(F.col("right").isNull(), F.col("y_start") + whole * (F.col("y_end") - F.col("y_start")))
        .otherwise(
            F.col("left.y_last") + ratio * (F.col("right.y_first") - F.col("left.y_last"))
        )
    )
    resampled = placed.select(
        "series_id", F.col("position").cast("bigint").alias("position"), "x", y.alias("y")
    )
    single = points.join(ends.filter("n_points < 2"), "series_id", "left_semi").select(
        "series_id", F.lit(0).cast("bigint").alias("position"), "x", "y"
    )
    return resampled.unionByName(single)


# -- from pixels to values ---------------------------------------------------------


def to_values(points: DataFrame, axis: DataFrame, device: str = "local") -> DataFrame:
    """Pixels to instants and values; points outside the value range are dropped.

    `axis`: series_id, start_ts, end_ts, bsl_min, bsl_max, region_x/y/width/height in
    percent, image_w, image_h. The pixel y axis points down.
    """
    profile = values.GRAPH_PROFILES[device]

    def pixel(percent: str, size: str) -> Column:
        return F.floor(F.col(percent) / 100.0 * F.col(size))

    across = (F.col("x") - pixel("region_x", "image_w")) / pixel("region_width", "image_w")
    up = F.lit(1.0) - (F.col("y") - pixel("region_y", "image_h")) / pixel("region_height", "image_h")
    start = F.unix_millis("start_ts")
    span = F.unix_millis("end_ts") - start
    return (
        points.join(axis, "series_id")
        .select(
            "series_id",
            F.timestamp_millis((start + across * span).cast("bigint")).alias("ts"),
            (F.col("bsl_min") + up * (F.col("bsl_max") - F.col("bsl_min"))).alias("raw"),
            "bsl_min",
            "bsl_max",
        )
        .filter((F.col("raw") >= F.col("bsl_min")) & (F.col("raw") <= F.col("bsl_max")))
        .select(
            "series_id",
            "ts",
            half_up(F.col("raw"), profile["digits"]).alias("value"),
            F.lit(profile["confidence"]).alias("confidence"),
        )
    )


def overnight_end(start: Column, end: Column) -> Column:
    """An axis that ends at or before its start runs into the next day."""
    return F.when(end <= start, end + F.expr("INTERVAL 24 HOURS")).otherwise(end)


def from_minutes(points: DataFrame, axis: DataFrame) -> DataFrame:
    """Points given in minutes from the axis start; values outside the axis are doubted."""
    inside = F.col("value").between(F.col("bsl_min"), F.col("bsl_max"))
    ms = F.unix_millis("start_ts") + F.col("minutes_from_start") * 60000.0
    return points.join(axis, "series_id").select(
        "series_id",
        F.timestamp_millis(ms.cast("bigint")).alias("ts"),
        "value",
        F.when(inside, F.lit(0.9)).otherwise(F.lit(0.5)).alias("confidence"),
    )


def default_axis(traced: DataFrame, as_of) -> DataFrame:
    """Axis guessed per series (series_id, device and any x): more points, longer view."""
    n, device = F.col("n_points"), F.col("device")
    hours = (
        F.when(
            device == "dexcom",
            F.when(n < 50, F.lit(3)).when(n < 100, F.lit(6)).when(n < 200, F.lit(12)).otherwise(
                F.lit(24)
            ),
        )
        .when(
            device == "freestyle-libre",
            F.when(n < 100, F.lit(8)).when(n < 200, F.lit(12)).otherwise(F.lit(24)),
        )
        .otherwise(F.lit(8))
    )

    def by_device(at: int) -> Column:
        rule = F
        for name, numbers in values.DEFAULT_VALUE_RANGES.items():
            rule = rule.when(device == name, F.lit(numbers[at]))
        return rule.otherwise(F.lit(values.DEFAULT_VALUE_RANGES["generic"][at]))

    end = F.lit(as_of).cast("timestamp")
    return (
        traced.groupBy("series_id", "device")
        .agg(F.count(F.lit(1)).alias("n_points"))
        .select(
            "series_id",
            "n_points",
            (end - F.make_dt_interval(F.lit(0), hours)).alias("start_ts"),
            end.alias("end_ts"),
            by_device(1).alias("bsl_min"),
            by_device(2).alias("bsl_max"),
            by_device(0).alias("unit"),
        )
    )


def given_or_default(given: DataFrame, guessed: DataFrame) -> DataFrame:
    """Axis values somebody supplied win over guessed ones, one by one."""
    names = [c for c in guessed.columns if c not in ("series_id", "n_points")]
    renamed = given.select(
        "series_id", *[F.col(c).alias(f"_given_{c}") for c in names if c in given.columns]
    )
    return guessed.join(renamed, "series_id", "left").select(
        "series_id",
        *[
            F.coalesce(f"_given_{c}", c).alias(c) if c in given.columns else F.col(c)
            for c in names
        ],
    )


# -- resampling in time ---------------------------------------------------------------


def bracket(
    points: DataFrame, axis: DataFrame, interval_minutes: int = 5, block: int = BLOCK
) -> DataFrame:
    """Each axis instant with the nearest sample at or before and at or after it.

    Samples are first reduced to the newest and the oldest per grid cell. Windows over blocks of the
    axis carry them from cell to cell; the instants between two cells are made last and neither
    shuffled nor ordered. An axis that ends before it starts has none. Also returns `n_points` of the series.
    """
    step = interval_minutes * 60_000
    ms, start = F.col("ms"), F.col("start_ms")
    bounds = axis.select(
        "series_id",
        F.unix_millis("start_ts").alias("start_ms"),
        F.expr(f"(unix_millis(end_ts) - unix_millis(start_ts)) div {step}").alias("final"),
    )
    samples = (
        points.withColumn("ms", F.unix_millis("ts"))
        .groupBy("series_id", "ms")
        .agg(
            F.min_by(F.struct("value", "confidence"), "pos").alias("s"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select("series_id", "ms", "s.value", "s.confidence", "_n")
    )
    placed = samples.join(bounds, "series_id")
    before_at = F.greatest(F.lit(0).cast("bigint"), F.ceil((ms - start) / F.lit(step)))
    after_at = F.least(F.col("final"), F.floor((ms - start) / F.lit(step)))
    sample = F.struct("ms", "value", "confidence")
    cells = placed.select(
        "series_id",
        sample.alias("p"),
        "_n",
        F.explode(
            F.array(
                F.struct(
                    F.when(before_at <= F.col("final"), before_at).alias("idx"),
                    F.lit(True).alias("is_before"),
                ),
                F.struct(
                    F.when(after_at >= 0, after_at).alias("idx"), F.lit(False).alias("is_before")
                ),
            )
        ).alias("c"),
    ).select("series_id", "c.idx", "c.is_before", "p")
    # A block has a row at its first and its last instant, and one per cell with a sample.
    size = F.lit(block)
    first = F.col("_block") * size
    final = F.least(first + (block - 1), F.col("final"))
    blocks = F.sequence(F.lit(0).cast("bigint"), F.expr(f"final div {block}"))
    edges = (
        bounds.filter("final >= 0")
        .join(samples.select("series_id").distinct(), "series_id", "left_semi")
        .select("series_id", "final", F.explode(blocks).alias("_block"))
        .select("series_id", F.explode(F.array(first, final)).alias("idx"))
    )
    known = (
        cells.filter(F.col("idx").isNotNull())
        .unionByName(edges, allowMissingColumns=True)
        .groupBy("series_id", "idx")
        .agg(
            F.max_by("p", F.when(F.col("is_before"), F.col("p.ms"))).alias("_b"),
            F.min_by("p", F.when(~F.col("is_before"), F.col("p.ms"))).alias("_a"),
        )
    )
    counts = samples.groupBy("series_id").agg(F.sum("_n").alias("n_points"))
    order = Window.partitionBy("series_id", "_block").orderBy("idx")
    runs = (
        known_around(
            known.withColumn("_block", F.expr(f"idx div {block}")),
            ["series_id"], "_block", ["idx"], ("_b", "before"), ("_a", "after"),
        )
        .withColumn("_next", F.coalesce(F.lead("idx").over(order), F.col("idx") + 1))
        .withColumn("_later", F.lead("after").over(order))
        .join(bounds.join(counts, "series_id"), "series_id")
    )
    at = F.col("_at")
    return runs.withColumn("_at", F.explode(F.sequence(F.col("idx"), F.col("_next") - 1))).select(
        "series_id", "n_points", (start + at * step).alias("at_ms"), "before",
        F.when(at == F.col("idx"), F.col("after")).otherwise(F.col("_later")).alias("after"),
    )


def resample(
    points: DataFrame, axis: DataFrame, interval_minutes: int = 5, style: str = "model"
) -> DataFrame:
    """Regular series of value and confidence. Points: series_id, pos, ts, value, confidence.

    `model`: linear, 0.1, confidence shrinks toward the later sample, the last value is
    carried on. `freestyle-libre` and `dexcom`: linear, no carrying on, 0.1 or whole
    numbers. `nearest`: the closest sample within two intervals.
    Series of fewer than two points come back unchanged.
    """
    known = bracket(points, axis, interval_minutes)
    at, before, after = F.col("at_ms"), F.col("before"), F.col("after")
    b_ms, a_ms = before.getField("ms"), after.getField("ms")
    b_conf, a_conf = before.getField("confidence"), after.getField("confidence")
    both = before.isNotNull() & after.isNotNull()
    if style == "nearest":
        to_before, to_after = at - b_ms, a_ms - at
        take_after = before.isNull() | (to_after < to_before)
        nearest = F.when(take_after, after).otherwise(before)
        distance = F.abs(nearest.getField("ms") - at)
        reach = interval_minutes * 60_000 * 2
        usable = distance < reach
        value = nearest.getField("value")
        confidence = nearest.getField("confidence") * (F.lit(1.0) - distance / F.lit(float(reach)))
    else:
        ratio = (at - b_ms) / (a_ms - b_ms)
        line = before.getField("value") + ratio * (
            after.getField("value") - before.getField("value")
        )
        same = b_ms == a_ms
        digits = 0 if style == "dexcom" else 1
        value = half_up(F.when(same, before.getField("value")).otherwise(line), digits)
        weakest = F.least(b_conf, a_conf)
        if style == "model":
            weakest = weakest * (F.lit(1.0) - ratio * 0.1)
        confidence = F.when(same, b_conf).otherwise(weakest)
        usable = both
        if style == "model":
            usable = before.isNotNull()
            value = F.when(both, value).otherwise(before.getField("value"))
            confidence = F.when(both, confidence).otherwise(b_conf * 0.8)
    regular = known.filter((F.col("n_points") >= 2) & F.coalesce(usable, F.lit(False))).select(
        "series_id",
        F.timestamp_millis(at).alias("ts"),
        value.alias("value"),
        confidence.alias("confidence"),
    )
    single = points.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("ts").alias("ts"),
        F.max("value").alias("value"),
        F.max("confidence").alias("confidence"),
    )
    return regular.unionByName(
        single.filter("n < 2").select("series_id", "ts", "value", "confidence")
    )
