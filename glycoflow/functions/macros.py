"""Nutrition arithmetic: calories, servings, estimate errors, item totals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glycoflow.functions.jsmath import half_up

FIELDS = ("calories", "carbs", "protein", "fat")
WEIGHTS = {"calories": 0.1, "carbs": 0.5, "protein": 0.2, "fat": 0.2}


def calories(carbs: Column, protein: Column, fat: Column) -> Column:
    return half_up(carbs * 4.0 + protein * 4.0 + fat * 9.0)


def per_servings(amount: Column, servings: Column) -> Column:
    return half_up(amount * servings)


def correction_is_material(before: dict[str, Column], after: dict[str, Column]) -> Column:
    hit = F.abs(before["calories"] - after["calories"]) > 1
    for name in ("carbs", "protein", "fat"):
        hit = hit | (F.abs(before[name] - after[name]) > 0.5)
    return hit


def absolute_error(predicted: Column, actual: Column) -> Column:
    return F.abs(predicted - actual)


def percent_error(predicted: Column, actual: Column) -> Column:
    """Percent error; an actual of 0 gives 0 or 100."""
    return F.when(actual == 0, F.when(predicted == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(
        F.abs((predicted - actual) / actual) * 100.0
    )


def weighted(parts: dict[str, Column]) -> Column:
    """Overall error, carbohydrate counting most."""
    total = None
    for name in FIELDS:
        term = parts[name] * WEIGHTS[name]
        total = term if total is None else total + term
    return total


def item_total(items: Column, name: str) -> Column:
    """Sum of one macro over the items of one meal, missing values as 0."""
    return F.aggregate(
        items,
        F.lit(0.0),
        lambda acc, item: acc + F.coalesce(item.getField("macros").getField(name), F.lit(0.0)),
    )
