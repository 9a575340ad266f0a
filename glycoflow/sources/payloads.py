"""Landed JSON documents: monitor payloads, model replies, food-composition entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glycoflow import schemas
from glycoflow.functions import glucose, macros
from glycoflow.functions.jsmath import clamp, or_default, parse_number
from glycoflow.functions.text import food_category, trend_direction


def _keep(readings: Column, start: Column | None, end: Column | None) -> Column:
    if start is not None:
        readings = F.filter(readings, lambda r: r.getField("ts") >= start)
    if end is not None:
        readings = F.filter(readings, lambda r: r.getField("ts") <= end)
    return readings


def libre_readings(
    docs: DataFrame, body: str, start=None, end=None, max_count: int | None = None
) -> DataFrame:
    """Readings of Libre payloads. `max_count` keeps the tail of each document as sent,
    before anything is sorted."""
    points = F.transform(
        F.from_json(F.col(body), schemas.LIBRE_PAYLOAD)["data"]["graphData"],
        lambda p: F.struct(
            F.try_to_timestamp(p["Timestamp"]).alias("ts"),
            glucose.mgdl_to_mmol(p["Value"], 1).alias("value"),
        ),
    )
    points = _keep(
        points,
        None if start is None else F.lit(start).cast("timestamp"),
        None if end is None else F.lit(end).cast("timestamp"),
    )
    kept = docs.withColumn("_points", points)
    if max_count is not None:
        n = F.size("_points")
        tail = F.slice("_points", F.greatest(n - max_count + 1, F.lit(1)), F.lit(max_count))
        kept = kept.withColumn("_points", tail)
    others = [c for c in docs.columns if c != body]
    # explode_outer and a filter on its result: a condition on `_points` would parse the document once more.
    return kept.select(*others, F.explode_outer("_points").alias("p")).filter(F.col("p").isNotNull()).select(
        *others, "p.ts", "p.value", F.lit("mmol/L").alias("unit"), F.lit("cgm").alias("source")
    )


def libre_current(docs: DataFrame, body: str) -> DataFrame:
    """The current measurement of each Libre payload that has one."""
    m = F.from_json(F.col(body), schemas.LIBRE_PAYLOAD)["data"]["glucoseMeasurement"]
    others = [c for c in docs.columns if c != body]
    # Opened as an array, so that the filter is not pushed below and parses the document once more.
    return (
        docs.withColumn("_m", F.explode_outer(F.array(m)))
        .filter(F.col("_m").isNotNull())
        .select(
            *others,
            F.try_to_timestamp(F.col("_m.Timestamp")).alias("ts"),
            glucose.mgdl_to_mmol(F.col("_m.Value"), 1).alias("value"),
            trend_direction(F.col("_m.TrendArrow")).alias("trend"),
            F.col("_m.isHigh").alias("is_high_alarm"),
            F.col("_m.isLow").alias("is_low_alarm"),
        )
    )


def sensor_expiry(docs: DataFrame, body: str) -> DataFrame:
    """Sensors end 14 days after activation."""
    activated = F.from_json(F.col(body), schemas.LIBRE_PAYLOAD)["data"]["sensor"]["a"]
    return docs.withColumn(
        "sensor_expiry", F.timestamp_seconds(activated) + F.expr("INTERVAL 14 DAYS")
    ).drop(body)


def wall_time(text: Column) -> Column:
    """`/Date(ms)/`, else whatever reads as a timestamp."""
    ms = F.regexp_extract(text, r"/Date\((\d+)\)/", 1).try_cast("bigint")
    return F.coalesce(F.timestamp_millis(ms), F.when(ms.isNull(), F.try_to_timestamp(text)))


def dexcom_readings(
    docs: DataFrame, body: str, as_of, start=None, end=None,
    max_count: int = 288, minutes: int = 1440,
) -> DataFrame:
    """Readings of Dexcom payloads: at most the newest `max_count` of the last minutes
    per document (since `start` if given), then the date filters."""
    entries = F.transform(
        F.from_json(F.col(body), schemas.DEXCOM_PAYLOAD),
        lambda e: F.struct(
            wall_time(e["WT"]).alias("ts"),
            glucose.mgdl_to_mmol(e["Value"], 1).alias("value"),
            trend_direction(e["Trend"]).alias("trend"),
        ),
    )
    now = F.lit(as_of).cast("timestamp")
    opened = (
        now - F.expr(f"INTERVAL {minutes} MINUTES")
        if start is None
        else F.lit(start).cast("timestamp")
    )
    newest = F.slice(
        F.sort_array(F.filter(entries, lambda r: r["ts"] >= opened), asc=False), 1, max_count
    )
    if end is not None:
        newest = F.filter(newest, lambda r: r["ts"] <= F.lit(end).cast("timestamp"))
    others = [c for c in docs.columns if c != body]
    rows = docs.select(*others, F.posexplode(newest).alias("pos", "p"))
    return rows.select(
        *others, "p.ts", "p.value", "p.trend", (F.col("pos") == 0).alias("is_current"),
        F.lit("mmol/L").alias("unit"), F.lit("cgm").alias("source"),
    )


# -- model replies ---------------------------------------------------------------


def reply_json(text: Column) -> Column:
    """The JSON inside a reply: a fenced block, else the outermost braces, else all of it."""
    fence = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    braces = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    return F.trim(F.when(fence != "", fence).when(braces != "", braces).otherwise(text))


def parse_reply(text: Column, schema: T.DataType) -> Column:
    """A reply with an optional fence around it, as `schema`; NULL where it is no JSON."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?", "")
    return F.from_json(F.trim(F.regexp_replace(F.trim(bare), r"```$", "")), schema)


def reading_replies(docs: DataFrame, text: str) -> DataFrame:
    """Replies that should list readings: `readings` or, failing that, `error`."""
    parsed = F.from_json(reply_json(F.col(text)), schemas.READINGS_PAYLOAD)
    is_json = F.expr("try_parse_json(_json)").isNotNull()
    return (
        docs.withColumn("_json", reply_json(F.col(text)))
        .withColumn("_parsed", parsed)
        .select(
            *[c for c in docs.columns if c != text],
            F.coalesce(F.col("_parsed.source"), F.lit("unknown")).alias("image_source"),
            F.col("_parsed.readings").alias("readings"),
            F.when(~is_json, F.lit("NOT_JSON"))
            .when(F.col("_parsed.readings").isNull(), F.lit("NO_READINGS"))
            .alias("error"),
        )
    )


def normalised_readings(replies: DataFrame, as_of) -> DataFrame:
    """One row per usable reading: unit settled, range checked, confidence within 0-1."""
    now = F.lit(as_of).cast("timestamp")
    others = [c for c in replies.columns if c not in ("readings", "error")]
    raw = replies.select(*others, F.posexplode("readings").alias("pos", "r"))
    value, unit_text = parse_number(F.col("r.value")), F.lower("r.unit")
    unit = (
        F.when(F.contains(unit_text, F.lit("mg")), F.lit("mg/dL"))
        .when(F.col("r.unit").isNotNull(), F.lit("mmol/L"))
        .when(value > 35, F.lit("mg/dL"))
        .otherwise(F.lit("mmol/L"))
    )
    # A number counts; anything else, a number sent as text too, does not.
    is_number = F.rlike(F.schema_of_variant("r.confidence"), F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"))
    confidence = F.when(is_number, F.try_variant_get("r.confidence", "$", "double"))
    return (
        raw.select(
            *others,
            "pos",
            value.alias("value"),
            unit.alias("unit"),
            F.coalesce(F.try_to_timestamp("r.timestamp"), now).alias("ts"),
            F.when(confidence.isNull(), F.lit(0.8))
            .otherwise(clamp(confidence, 0.0, 1.0))
            .alias("confidence"),
            F.col("r.rawText").alias("raw_text"),
        )
        .filter(F.col("value") > 0)
        .filter(
            F.when(F.col("unit") == "mg/dL", F.col("value").between(20.0, 600.0)).otherwise(
                F.col("value").between(1.0, 35.0)
            )
        )
    )


def food_replies(docs: DataFrame, text: str) -> DataFrame:
    """Replies to a picture of food: one row per item, or one with an error.

    Totals that a reply leaves out are the sums of its items.
    """
    parsed = docs.withColumn("_reply", parse_reply(F.col(text), schemas.FOOD_REPLY))
    others = [c for c in docs.columns if c != text]
    items = parsed.select(
        *others, F.col("_reply.items").alias("_items"), F.col("_reply.totalMacros").alias("_total"),
        F.col("_reply.confidence").alias("reply_confidence"),
    )

    def total(name: str) -> Column:
        amounts = F.transform("_items", lambda x: F.coalesce(x["macros"][name], F.lit(0.0)))
        summed = F.aggregate(amounts, F.lit(0.0), lambda a, b: a + b)
        return F.coalesce(F.col("_total").getField(name), summed).alias(f"total_{name}")

    totals = [total(name) for name in macros.FIELDS]
    error = F.when(F.col("_items").isNull(), F.lit("NO_ITEMS"))
    rows = items.select(*others, "reply_confidence", *totals, error.alias("error"), F.posexplode_outer("_items").alias("pos", "i"))
    return rows.select(
        *others, "error", "pos", "i.name", "i.quantity", "i.unit",
        *[F.col(f"i.macros.{n}").alias(n) for n in macros.FIELDS],
        F.col("i.confidence").alias("confidence"), "reply_confidence", *[f"total_{n}" for n in macros.FIELDS],
    )


def label_replies(docs: DataFrame, text: str) -> DataFrame:
    """Replies to a picture of a label, with an error where there are no macros."""
    r = F.col("_reply")
    parsed = docs.withColumn("_reply", parse_reply(F.col(text), schemas.LABEL_REPLY))
    return parsed.select(
        *[c for c in docs.columns if c != text],
        r["servingSize"].alias("serving_size"), r["servingsPerContainer"].alias("servings"),
        *[r["macros"][n].alias(n) for n in macros.FIELDS],
        r["fiber"].alias("fiber"), r["sugar"].alias("sugar"), r["sodium"].alias("sodium"),
        r["confidence"].alias("confidence"),
        F.when(r["macros"].isNull(), F.lit("NO_MACROS")).alias("error"),
    )


# -- food composition --------------------------------------------------------------


def composition_entries(foods: DataFrame) -> DataFrame:
    """Ground truth from food-composition rows (fdc_id, description, nutrients): of each
    nutrient the first entry whose name holds the word, missing or zero as 0."""

    def amount(word: str) -> Column:
        named = F.filter(
            F.col("nutrients"),
            lambda n: F.contains(F.lower(n["nutrientName"]), F.lit(word)),
        )
        return or_default(F.get(named, 0)["amount"], 0.0)

    return foods.select(
        F.col("fdc_id").cast("string").alias("source_reference"),
        "description",
        food_category(F.col("description")).alias("category"),
        F.lit("usda").alias("source"),
        amount("energy").alias("calories"),
        amount("carbohydrate").alias("carbs"),
        amount("protein").alias("protein"),
        amount("total lipid").alias("fat"),
    )
