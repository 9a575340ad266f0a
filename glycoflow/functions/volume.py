"""Food volume from outlined regions, and macros from volume."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions.jsmath import half_up


def _shape_value(shape: Column, position: int) -> Column:
    rule = None
    for name, numbers in values.SHAPES.items():
        test, out = shape == name, F.lit(numbers[position])
        rule = F.when(test, out) if rule is None else rule.when(test, out)
    return rule


def polygon_area(points: Column) -> Column:
    """Area inside a closed outline of {x, y}; fewer than three corners have none."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(
        points,
        following,
        lambda a, b: a.getField("x") * b.getField("y") - b.getField("x") * a.getField("y"),
    )
    total = F.aggregate(cross, F.lit(0.0), lambda acc, term: acc + term)
    return F.when(F.size(points) < 3, F.lit(0.0)).otherwise(F.abs(total / 2.0))


def centroid(points: Column) -> Column:
    def mean(axis: str) -> Column:
        total = F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p.getField(axis))
        return F.when(F.size(points) == 0, F.lit(0.0)).otherwise(total / F.size(points))

    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def area_mm2(area_px: Column, pixels_per_mm: Column) -> Column:
    scale = F.coalesce(pixels_per_mm, F.lit(values.DEFAULT_PIXELS_PER_MM))
    return area_px / (scale * scale)


def height_mm(area: Column, shape: Column) -> Column:
    return F.sqrt(area / math.pi) * _shape_value(shape, 0)


def volume_ml(area: Column, shape: Column) -> Column:
    return area * height_mm(area, shape) * _shape_value(shape, 1) / 1000.0


def volume_ml_with_shape(area: Column, shape: Column) -> Column:
    """Second opinion with another shape; it starts from the rounded area."""
    return volume_ml(half_up(area), shape)


def confidence(reference_confidence: Column, regions: Column) -> Column:
    region_part = F.when(
        regions > 0, F.least(F.lit(1.0), F.lit(0.7) + regions * 0.1)
    ).otherwise(F.lit(0.0))
    return half_up(F.coalesce(reference_confidence, F.lit(0.5)) * 0.6 + region_part * 0.4, 2)


def uncertainty(reference_confidence: Column, result_confidence: Column) -> Column:
    base = (
        F.when(reference_confidence.isNull(), F.lit(0.5))
        .when(reference_confidence < 0.7, F.lit(0.4))
        .otherwise(F.lit(0.3))
    )
    return F.when(result_confidence > 0.8, base * 0.9).otherwise(base)


def grams(volume: Column, density: Column) -> Column:
    return volume * density


def macro_amount(per_gram: Column, weight: Column, name: str) -> Column:
    return half_up(per_gram * weight, 0 if name == "calories" else 1)


def calibrated(amount: Column, factor: Column, name: str) -> Column:
    return F.when(factor == 1.0, amount).otherwise(
        half_up(amount * factor, 0 if name in ("calories", "weight") else 1)
    )
