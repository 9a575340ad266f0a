"""The food dimension: lookup, ranked search, popular list, estimates from outlines."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions import macros, volume
from glycoflow.functions.jsmath import half_up
from glycoflow.functions.text import serving_shape
from glycoflow.operators.calibration import with_factor

COLUMNS = (
    "pos int, id string, name string, category string, density double, "
    "calories double, carbs double, protein double, fat double"
)


def foods(spark: SparkSession) -> DataFrame:
    """The built-in dimension: a fixed 69 rows, so joins may broadcast it."""
    return spark.createDataFrame(
        [(pos, *row) for pos, row in enumerate(values.FOODS)], COLUMNS
    )


def categories(dim: DataFrame) -> DataFrame:
    """Distinct categories in order of first appearance."""
    return dim.groupBy("category").agg(F.min("pos").alias("first_pos")).orderBy("first_pos")


def with_food(rows: DataFrame, dim: DataFrame, key: str = "food_id") -> DataFrame:
    """Food attributes by id; NULL for unknown ids. The planner broadcasts a small dimension."""
    renamed = dim.select(
        F.col("id").alias(key),
        F.col("name").alias("food_name"),
        F.col("category").alias("food_category"),
        "density",
        *[F.col(n).alias(f"{n}_per_gram") for n in macros.FIELDS],
    )
    return rows.join(renamed, key, "left")


def _boundary_starts(name: str) -> list[str]:
    """The rest of a name from each word boundary on; a term matches at a boundary if one of
    these starts with it."""
    return [name[m.start():] for m in re.finditer(r"\b", name, re.ASCII)]


def _score(food: Column, query: Column, terms: Column) -> Column:
    name, category = food["name"], food["category"]
    whole = (
        F.when(name == query, F.lit(100))
        .when(F.startswith(name, query), F.lit(50))
        .when(F.contains(name, query), F.lit(25))
        .otherwise(F.lit(0))
    )

    def term_score(term: Column) -> Column:
        at_boundary = F.exists(food["starts"], lambda start: F.startswith(start, term))
        in_name = F.when(F.contains(name, term), F.when(at_boundary, F.lit(15)).otherwise(F.lit(10)))
        in_category = F.when(F.contains(category, term), F.lit(5))
        points = F.coalesce(in_name, F.lit(0)) + F.coalesce(in_category, F.lit(0))
        return F.when(F.length(term) < 2, F.lit(0)).otherwise(points)

    return F.aggregate(terms, whole, lambda acc, term: acc + term_score(term))


def search(queries: DataFrame, limit: int = 10) -> DataFrame:
    """Best foods per query text (query_id, query).

    Each distinct text meets the 69 foods of the built-in dimension, which travel as one
    literal; ranking needs no further shuffle, texts being distributed already.
    """
    rows = [
        {"pos": pos, "id": row[0], "name": row[1].lower(), "category": row[2].lower(),
         "starts": _boundary_starts(row[1].lower())}
        for pos, row in enumerate(values.FOODS)
    ]
    dim = F.from_json(
        F.lit(json.dumps(rows)),
        "array<struct<pos:int,id:string,name:string,category:string,starts:array<string>>>",
    )
    cleaned = queries.withColumn("_q", F.lower(F.trim("query"))).filter(F.col("_q") != "")
    # One row per distinct text: equal queries have equal answers.
    texts = cleaned.select("_q").distinct()
    best_first = Window.partitionBy("_q").orderBy(F.desc("score"), "pos")
    answers = (
        texts.withColumn("_terms", F.split("_q", r"\s+"))
        .select("_q", "_terms", F.explode(dim).alias("food"))
        .select(
            "_q",
            F.col("food.pos").alias("pos"),
            F.col("food.id").alias("food_id"),
            _score(F.col("food"), F.col("_q"), F.col("_terms")).cast("bigint").alias("score"),
        )
        .withColumn("rank", F.row_number().over(best_first))
        .filter((F.col("rank") <= limit) & (F.col("score") > 0))
    )
    return cleaned.join(answers, "_q").select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "food_id", "score"
    )


def popular(dim: DataFrame, n: int = 12) -> DataFrame:
    """First item of every category, then items in table order, until there are `n`."""
    firsts = dim.groupBy("category").agg(F.min("pos").alias("pos")).select("pos")
    lead = dim.join(firsts.withColumn("_later", F.lit(0)), "pos")
    rest = dim.join(firsts, "pos", "left_anti").withColumn("_later", F.lit(1))
    return lead.unionByName(rest).orderBy("_later", "pos").limit(n).drop("_later")


# -- volumes and estimates ------------------------------------------------------------


def region_sizes(regions: DataFrame) -> DataFrame:
    """Area, height and volume of every outlined region.

    `regions`: meal_id, region_id, boundary, pixels_per_mm, ref_confidence, shape.
    """
    area = volume.area_mm2(volume.polygon_area(F.col("boundary")), F.col("pixels_per_mm"))
    return regions.withColumn("area_mm2", area).select(
        "*",
        volume.height_mm(F.col("area_mm2"), F.col("shape")).alias("height_mm"),
        volume.volume_ml(F.col("area_mm2"), F.col("shape")).alias("volume_ml"),
    )


def meal_volumes(regions: DataFrame) -> DataFrame:
    """Volume, confidence, interval and warnings of each meal."""
    total, n = F.col("total"), F.col("n_regions")
    reference, scale = F.col("ref_confidence"), F.col("pixels_per_mm")
    confidence = volume.confidence(reference, n)
    known = (
        region_sizes(regions)
        .groupBy("meal_id")
        .agg(
            F.sum("volume_ml").alias("total"),
            F.count(F.lit(1)).alias("n_regions"),
            F.max("ref_confidence").alias("ref_confidence"),
            F.max("pixels_per_mm").alias("pixels_per_mm"),
        )
        .withColumn("total_volume_ml", half_up(total))
        .withColumn("confidence", confidence)
    )
    spread = volume.uncertainty(reference, F.col("confidence"))
    known = known.withColumn("uncertainty", spread)
    warnings = F.array_compact(
        F.array(
            F.when(scale.isNull(), F.lit("NO_REFERENCE")),
            F.when(total > 2000, F.lit("VOLUME_LARGE")),
            F.when(total < 10, F.lit("VOLUME_SMALL")),
        )
    )
    shown = F.col("total_volume_ml")
    return known.select(
        "meal_id",
        "n_regions",
        "total_volume_ml",
        "confidence",
        half_up(F.col("uncertainty") * 100).alias("uncertainty_pct"),
        half_up(shown * (F.lit(1.0) - F.col("uncertainty"))).alias("low_ml"),
        half_up(shown * (F.lit(1.0) + F.col("uncertainty"))).alias("high_ml"),
        warnings.alias("warnings"),
    )


def macros_of(rows: DataFrame, volume_column: str) -> DataFrame:
    """Weight and macros from a volume; needs the columns `with_food` adds."""
    weight = volume.grams(F.col(volume_column), F.col("density"))
    return rows.withColumn("_grams", weight).select(
        "*",
        half_up(F.col("_grams")).alias("weight_grams"),
        *[
            volume.macro_amount(F.col(f"{n}_per_gram"), F.col("_grams"), n).alias(n)
            for n in macros.FIELDS
        ],
    ).drop("_grams")


def calibrated(rows: DataFrame, calibration: DataFrame, key: str = "food_id") -> DataFrame:
    """Weight and macros moved by the food's correction factor."""
    known = with_factor(rows, calibration, key)
    factor = F.col("correction_factor")
    for name in macros.FIELDS:
        known = known.withColumn(name, volume.calibrated(F.col(name), factor, name))
    return known.withColumn(
        "weight_grams", volume.calibrated(F.col("weight_grams"), factor, "weight")
    )


def estimate_meals(
    regions: DataFrame, meal_foods: DataFrame, dim: DataFrame, calibration: DataFrame
) -> DataFrame:
    """Outlines to calibrated macros. `meal_foods`: meal_id, food_id. Meals of unknown foods
    have no estimate; the shape is taken from the food's name where none is given."""
    named = with_food(meal_foods, dim).filter(F.col("food_name").isNotNull())
    shaped = regions.join(named.select("meal_id", "food_name"), "meal_id").withColumn(
        "shape", F.coalesce("shape", serving_shape(F.col("food_name")))
    )
    volumes = meal_volumes(shaped.drop("food_name"))
    return calibrated(macros_of(volumes.join(named, "meal_id"), "total_volume_ml"), calibration)
