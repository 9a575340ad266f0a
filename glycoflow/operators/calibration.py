"""Correction factors per food: an ordered, rounded running average.

factor = ratio at first, then 0.3 * ratio + 0.7 * factor, rounded to three places each
time. The rounding makes the order matter and the fold non-associative, so it is exact
only if replayed. Corrections are brought into order by a range partitioning and cut into
chunks of bounded length. A chunk does not know the factor it starts from, but the fold is
monotone and shrinks differences by 0.7 a step: after a head of 100 corrections every start
up to 1e12 has landed on a handful of neighbouring values. A chunk keeps its head and, for
those few values, where each of them ends; joining the chunks of a food is a fold over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glycoflow.functions.jsmath import half_up

ALPHA = 0.3
HEAD = 100
CHUNK = 100_000
BOUND = 1e12


def ratios(corrections: DataFrame) -> DataFrame:
    """(food_type_id, ts, seq, ratio) of the usable corrections.

    Not usable: an estimate of 0, a missing value, and ratios that are not numbers or beyond
    1e12. `unusable` counts them.
    """
    rows = _with_ratio(corrections)
    return rows.filter(_usable()).select("food_type_id", "ts", "seq", "ratio")


def unusable(corrections: DataFrame) -> DataFrame:
    """(food_type_id, n) of the corrections that `ratios` leaves out."""
    out = _with_ratio(corrections).filter(~_usable())
    return out.groupBy("food_type_id").agg(F.count(F.lit(1)).alias("n"))


def _with_ratio(corrections: DataFrame) -> DataFrame:
    estimated = F.when(F.col("estimated") != 0, F.col("estimated"))
    return corrections.withColumn("ratio", F.col("corrected") / estimated)


def _usable() -> Column:
    ratio = F.col("ratio")
    return F.coalesce(~F.isnan(ratio) & (F.abs(ratio) <= BOUND), F.lit(False))


def _step(factor: Column, ratio: Column) -> Column:
    return F.when(factor.isNull(), half_up(ratio, 3)).otherwise(
        half_up(ratio * ALPHA + factor * (1 - ALPHA), 3)
    )


def _fold(ratio_list: Column, start: Column) -> Column:
    return F.aggregate(ratio_list, start, _step)


def calibrate(corrections: DataFrame, chunk: int = CHUNK, head: int = HEAD) -> DataFrame:
    """Factor, sample count and last update per food."""
    ordered = ratios(corrections).repartitionByRange("food_type_id", "ts", "seq", "ratio")
    place = F.monotonically_increasing_id()
    chunks = (
        ordered.sortWithinPartitions("food_type_id", "ts", "seq", "ratio")
        .withColumn("_place", place)
        .groupBy(
            "food_type_id", F.shiftright("_place", 33).alias("_part"),
            F.expr(f"(_place & {(1 << 33) - 1}L) div {chunk}").alias("_chunk"),
        )
        .agg(F.sort_array(F.collect_list(F.struct("ts", "seq", "ratio"))).alias("c"))
        .select(
            "food_type_id", F.get("c", F.lit(0)).alias("first"), F.size("c").alias("n"),
            F.element_at("c", -1)["ts"].alias("last_ts"),
            F.transform("c", lambda e: e["ratio"]).alias("ratios"),
        )
    )

    def thousandths(factor: Column) -> Column:
        return F.floor(factor * 1000 + 0.5)

    start = F.slice("ratios", 1, head)
    bounded = chunks.select(
        "food_type_id", "first", "n", "last_ts", start.alias("head"),
        F.slice("ratios", F.lit(head + 1), F.greatest(F.col("n") - head, F.lit(0))).alias("rest"),
        thousandths(_fold(start, F.lit(-BOUND))).alias("low"),
        thousandths(_fold(start, F.lit(BOUND))).alias("high"),
    )
    ends = F.transform(F.sequence("low", "high"), lambda s: _fold(F.col("rest"), s / F.lit(1000.0)))
    mapped = bounded.select(
        "food_type_id", "n", "last_ts",
        F.struct("first", "head", "low", F.when(F.size("rest") > 0, ends).alias("ends")).alias("m"),
    )

    def through(factor: Column, m: Column) -> Column:
        after_head = _fold(m["head"], factor)
        at = (thousandths(after_head) - m["low"]).cast("int")
        return F.when(m["ends"].isNull(), after_head).otherwise(F.get(m["ends"], at))

    nothing = F.lit(None).cast("double")
    return (
        mapped.groupBy("food_type_id")
        .agg(
            F.sort_array(F.collect_list("m")).alias("c"), F.sum("n").alias("sample_count"),
            F.max("last_ts").alias("last_updated"),
        )
        .select(
            "food_type_id", F.aggregate("c", nothing, through).alias("correction_factor"),
            "sample_count", "last_updated",
        )
    )


def stats(calibration: DataFrame) -> DataFrame:
    """Foods, corrections and the mean distance of factors from 1, in percent."""
    away = F.avg(F.abs(F.col("correction_factor") - 1))
    return calibration.agg(
        F.count(F.lit(1)).alias("total_foods"),
        F.coalesce(F.sum("sample_count"), F.lit(0)).alias("total_corrections"),
        F.coalesce(F.floor(away * 100 + 0.5), F.lit(0)).alias("average_deviation"),
    )


def with_factor(rows: DataFrame, calibration: DataFrame, key: str = "food_type_id") -> DataFrame:
    """Add `correction_factor`, 1 where the food was never corrected."""
    factors = calibration.select(F.col("food_type_id").alias(key), "correction_factor")
    return rows.join(factors, key, "left").fillna({"correction_factor": 1.0})


def apply_factor(value: Column, factor: Column) -> Column:
    return half_up(value * factor, 1)


def export_lines(calibration: DataFrame) -> DataFrame:
    return calibration.select(
        F.to_json(
            F.struct(
                F.col("food_type_id").alias("foodTypeId"),
                F.col("correction_factor").alias("correctionFactor"),
                F.col("sample_count").alias("sampleCount"),
                F.unix_millis("last_updated").alias("lastUpdated"),
            )
        ).alias("value")
    )


def import_lines(lines: DataFrame) -> DataFrame:
    schema = "foodTypeId string, correctionFactor double, sampleCount bigint, lastUpdated bigint"
    e = lines.select(F.from_json("value", schema).alias("e"))
    return e.select(
        F.col("e.foodTypeId").alias("food_type_id"),
        F.col("e.correctionFactor").alias("correction_factor"),
        F.col("e.sampleCount").alias("sample_count"),
        F.timestamp_millis("e.lastUpdated").alias("last_updated"),
    )
