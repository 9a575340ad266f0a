"""Meal presets. A preset is a row (preset_id, name, updated_at); its items are rows
(preset_id, pos, calories, carbs, protein, fat), so merging presets never builds an array
whose length grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycoflow.functions.macros import FIELDS

STRATEGIES = ("skip", "replace", "merge")


def by_last_use(presets: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = presets.orderBy(F.desc("updated_at"), "preset_id")
    return ordered if limit is None else ordered.limit(limit)


def by_name(presets: DataFrame) -> DataFrame:
    return presets.orderBy("name", "preset_id")


def named(presets: DataFrame, name: str, ignore_case: bool = False) -> DataFrame:
    if ignore_case:
        return presets.filter(F.lower("name") == name.lower())
    return presets.filter(F.col("name") == name)


def search_name(presets: DataFrame, text: str) -> DataFrame:
    return presets.filter(F.contains(F.lower("name"), F.lit(text.lower())))


def mark_used(presets: DataFrame, used: DataFrame) -> DataFrame:
    """Move the stamp of used presets (preset_id, used_at) forward."""
    newest = used.groupBy("preset_id").agg(F.max("used_at").alias("_used"))
    return (
        presets.join(newest, "preset_id", "left")
        .withColumn("updated_at", F.coalesce("_used", "updated_at"))
        .drop("_used")
    )


def totals(items: DataFrame) -> DataFrame:
    """Macro totals per preset, missing values as 0."""
    return items.groupBy("preset_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        *[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in FIELDS],
    )


def target_of(existing: DataFrame, batch: DataFrame, strategy: str) -> DataFrame:
    """Which preset each batch row (preset_id, name, seq) ends up in: `target_id`, NULL if
    the row is skipped or replaced by a later one.

    The batch works in order, so a repeated name meets the row before it. Existing names
    are unique.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    pick = F.max_by if strategy == "replace" else F.min_by
    chosen = batch.groupBy("name").agg(pick("preset_id", "seq").alias("_chosen"))
    held = existing.select("name", F.col("preset_id").alias("_held"))
    known = batch.join(chosen.join(held, "name", "left"), "name")
    mine = F.col("preset_id") == F.col("_chosen")
    if strategy == "skip":
        target = F.when(F.col("_held").isNull() & mine, F.col("preset_id"))
    elif strategy == "replace":
        target = F.when(mine, F.col("preset_id"))
    else:
        target = F.coalesce("_held", "_chosen")
    return known.select("preset_id", "name", "seq", target.alias("target_id"))


def import_presets(
    existing: DataFrame, existing_items: DataFrame, batch: DataFrame, batch_items: DataFrame,
    strategy: str = "skip",
) -> tuple[DataFrame, DataFrame]:
    """Presets (preset_id, name) and items after the import. Merged items keep their order
    by (`seq`, `pos`), existing ones first with seq -1."""
    placed = target_of(existing, batch, strategy)
    kept = existing.select("preset_id", "name")
    if strategy == "replace":
        kept = kept.join(batch.select("name"), "name", "left_anti").select("preset_id", "name")
    added = placed.filter(F.col("target_id") == F.col("preset_id")).select("preset_id", "name")
    kept_items = existing_items.join(kept, "preset_id", "left_semi").withColumn(
        "seq", F.lit(-1).cast("bigint")
    )
    moved = placed.filter(F.col("target_id").isNotNull()).select("preset_id", "seq", "target_id")
    new_items = (
        batch_items.join(moved, "preset_id")
        .drop("preset_id")
        .withColumnRenamed("target_id", "preset_id")
    )
    return kept.unionByName(added), kept_items.unionByName(new_items)


def import_counts(existing: DataFrame, batch: DataFrame, strategy: str) -> DataFrame:
    placed = target_of(existing, batch, strategy)
    if strategy != "skip":
        return placed.agg(
            F.count(F.lit(1)).alias("imported"), F.lit(0).cast("bigint").alias("skipped")
        )
    return placed.agg(
        F.count("target_id").alias("imported"),
        F.count_if(F.col("target_id").isNull()).alias("skipped"),
    )
