"""How good nutrition estimates are: error metrics, correction bias, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glycoflow.functions import macros

FIELDS = macros.FIELDS
MIN_CORRECTIONS = 5
SIGNIFICANT = 10.0
LARGEST_ADJUSTMENT = 30.0
#: Blocks of stamps that are counted by tasks of their own.
BLOCKS = 256


def with_errors(results: DataFrame) -> DataFrame:
    """Add mae_* and mape_* from predicted_* and actual_* of the four macros."""

    def side(rule) -> dict[str, Column]:
        parts = {n: rule(F.col(f"predicted_{n}"), F.col(f"actual_{n}")) for n in FIELDS}
        return {**parts, "overall": macros.weighted(parts)}

    mae, mape = side(macros.absolute_error), side(macros.percent_error)
    return results.select(
        "*",
        *[c.alias(f"mae_{n}") for n, c in mae.items()],
        *[c.alias(f"mape_{n}") for n, c in mape.items()],
    )


def where_equal(rows: DataFrame, newest: str, **values) -> DataFrame:
    """Rows whose columns have the given values, newest first."""
    for name, value in values.items():
        rows = rows.filter(F.col(name) == value)
    return rows.orderBy(F.desc(newest))


def with_place(rows: DataFrame, newest: str, key: str) -> DataFrame:
    """Number all rows newest first, without sorting them in one task.

    Rows are numbered within their stamp; the rows of newer stamps are counted per stamp within blocks of stamps, and
    per block. One task orders the blocks, of which there are at most `BLOCKS` + 1.
    """
    counts = rows.groupBy(F.col(newest).alias("_stamp")).agg(F.count(F.lit(1)).alias("_n"))
    # Bounds are drawn by hash, so that a task that runs again finds the same ones.
    drawn = counts.filter(F.col("_stamp").isNotNull()).orderBy(F.xxhash64("_stamp"), "_stamp").limit(BLOCKS - 1)
    bounds = drawn.agg(F.collect_list("_stamp").alias("_bounds"))
    newer = F.size(F.filter("_bounds", lambda b: b > F.col("_stamp")))
    block = F.when(F.col("_stamp").isNull(), F.lit(BLOCKS)).otherwise(newer)
    blocked = counts.crossJoin(F.broadcast(bounds)).select("_stamp", "_n", block.alias("_block"))

    def earlier(window) -> Column:
        before = F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1))
        return F.coalesce(before, F.lit(0))

    totals = blocked.groupBy("_block").agg(F.sum("_n").alias("_n"))
    offsets = totals.select("_block", earlier(Window.orderBy("_block")).alias("_offset"))
    inside = earlier(Window.partitionBy("_block").orderBy(F.desc("_stamp")))
    places = blocked.withColumn("_inside", inside).join(offsets, "_block")
    places = places.select("_stamp", (F.col("_offset") + F.col("_inside")).alias("_before"))
    within = F.row_number().over(Window.partitionBy(newest).orderBy(key))
    numbered = rows.withColumn("_within", within)
    joined = numbered.join(places, F.col(newest).eqNullSafe(F.col("_stamp")))
    return joined.withColumn("place", F.col("_before") + F.col("_within")).drop("_stamp", "_before", "_within")


def of_category(results: DataFrame, entries: DataFrame, category: str) -> DataFrame:
    """Results whose test entry is of one category."""
    ids = entries.filter(F.col("category") == category).select(F.col("id").alias("test_entry_id"))
    return results.join(ids, "test_entry_id", "left_semi")


def accuracy_metrics(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Mean errors for every provider and category, each alone, and overall, in one pass.

    `all` stands for "any provider" or "any category". Results whose entry has no category
    count only where the category is `all`.
    """
    known = results.join(
        entries.select(F.col("id").alias("test_entry_id"), "category"), "test_entry_id", "left"
    )
    names = [*FIELDS, "overall"]
    means = [
        *[F.avg(f"mae_{n}").alias(f"mae_{n}") for n in names],
        *[F.avg(f"mape_{n}").alias(f"mape_{n}") for n in names],
        F.avg("confidence").alias("avg_confidence"),
        F.avg("processing_ms").alias("avg_processing_ms"),
    ]
    any_provider, any_category = F.grouping("provider") == 1, F.grouping("category") == 1
    cubed = known.cube("provider", "category").agg(
        F.count(F.lit(1)).alias("sample_count"),
        *means,
        any_provider.alias("_any_p"),
        any_category.alias("_any_c"),
    )
    return (
        cubed.filter(F.col("_any_c") | F.col("category").isNotNull())
        .withColumn("provider", F.when(F.col("_any_p"), F.lit("all")).otherwise(F.col("provider")))
        .withColumn("category", F.when(F.col("_any_c"), F.lit("all")).otherwise(F.col("category")))
        .drop("_any_p", "_any_c")
    )


def correction_patterns(corrections: DataFrame) -> DataFrame:
    """Mean over- and underestimate per category; both are divided by all corrections.

    Rows: category, predicted_*, corrected_*, confidence. Those without category are left out.
    """
    n = F.count(F.lit(1))

    def gap(name: str) -> Column:
        return F.col(f"predicted_{name}") - F.col(f"corrected_{name}")

    zero = F.lit(0.0)
    return (
        corrections.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            *[(F.sum(F.greatest(gap(f), zero)) / n).alias(f"over_{f}") for f in FIELDS],
            *[(F.sum(F.greatest(-gap(f), zero)) / n).alias(f"under_{f}") for f in FIELDS],
            n.alias("correction_count"),
            F.avg("confidence").alias("avg_confidence"),
        )
        .withColumn("over_overall", zero)
        .withColumn("under_overall", zero)
    )


def adjustment_suggestions(patterns: DataFrame) -> DataFrame:
    """Which macro of which category to raise or lower. The thresholds are named percent
    but compared with absolute amounts; that is kept."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"), F.col(f"over_{f}").alias("over"),
                F.col(f"under_{f}").alias("under"),
            )
            for f in FIELDS
        ]
    )
    over, under = F.col("p.over"), F.col("p.under")
    adjustment = (
        F.when((over > under) & (over > SIGNIFICANT), F.lit("decrease"))
        .when((under > over) & (under > SIGNIFICANT), F.lit("increase"))
    )
    return (
        patterns.filter(F.col("correction_count") >= MIN_CORRECTIONS)
        .select("category", "correction_count", F.explode(pairs).alias("p"))
        .select(
            "category",
            F.col("p.field").alias("field"),
            adjustment.alias("adjustment"),
            F.least(F.greatest(over, under), F.lit(LARGEST_ADJUSTMENT)).alias(
                "percentage_adjustment"
            ),
            F.least(F.col("correction_count") / 20, F.lit(1.0)).alias("confidence"),
            F.col("correction_count").alias("sample_size"),
        )
        .filter(F.col("adjustment").isNotNull())
    )


def check_entries(entries: DataFrame) -> DataFrame:
    """Ground-truth rows with `error` set where image, truth or source is missing."""
    missing = (
        F.coalesce(F.col("image_url"), F.lit("")) == ""
    ) | F.col("ground_truth").isNull() | (F.coalesce(F.col("source"), F.lit("")) == "")
    return entries.withColumn("error", F.when(missing, F.lit("MISSING_FIELDS")))


def dataset_manifest(entries: DataFrame) -> DataFrame:
    """Envelope of a dataset export. The two lists hold vocabulary words, not rows."""
    return entries.agg(
        F.count(F.lit(1)).alias("count"),
        F.sort_array(F.collect_set("source")).alias("sources"),
        F.sort_array(F.collect_set("category")).alias("categories"),
    ).withColumn("version", F.lit("1.0"))
