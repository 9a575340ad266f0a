"""Keyword rules over free text: the first keyword in listed order decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glycoflow import values
from glycoflow.functions.jsmath import once


def _any_of(text: Column, words: list[str]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def _first_group(text: Column, groups, otherwise) -> Column:
    def rule(lowered: Column) -> Column:
        chain = F
        for label, words in groups:
            chain = chain.when(_any_of(lowered, words), F.lit(label))
        return chain.otherwise(F.lit(otherwise))

    return once(F.lower(text), rule)


def glycemic_index(description: Column) -> Column:
    """Glycaemic index guessed from a meal description."""
    default = F.lit(float(values.GI_DEFAULT))

    def rule(text: Column) -> Column:
        chain = F.when(text.isNull() | (text == ""), default)
        for word, gi in values.GI_KEYWORDS + values.GI_MODIFIERS:
            chain = chain.when(F.contains(text, F.lit(word)), F.lit(float(gi)))
        return chain.otherwise(default)

    return once(F.lower(description), rule)


def food_category(description: Column) -> Column:
    return _first_group(description, values.CATEGORY_KEYWORDS, "other")


def serving_shape(food_name: Column) -> Column:
    return _first_group(food_name, values.SHAPE_KEYWORDS, "irregular")


def trend_direction(code: Column) -> Column:
    rule = None
    for position, name in enumerate(values.TRENDS, start=1):
        test = code == position
        rule = F.when(test, F.lit(name)) if rule is None else rule.when(test, F.lit(name))
    return rule.otherwise(F.lit("unknown"))


def number_label(x: Column) -> Column:
    """A double as text without a trailing ".0" (5.0 is "5", 5.5 is "5.5")."""
    whole = x == F.floor(x)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def event_label(event_type: Column, value: Column, meta: Column) -> Column:
    """One-line display label of an event."""
    units = meta.getField("alcohol_units")
    amount = number_label(value)
    drank = F.coalesce(units, F.lit(0.0)) > 0
    return (
        F.when(
            event_type == "insulin",
            F.concat(amount, F.lit(" units "), F.coalesce(meta.getField("type"), F.lit(""))),
        )
        .when(
            (event_type == "meal") & drank & (value == 0),
            F.concat(number_label(units), F.lit(" units alcohol")),
        )
        .when(
            (event_type == "meal") & drank,
            F.concat(amount, F.lit("g carbs + "), number_label(units), F.lit("u")),
        )
        .when(event_type == "meal", F.concat(amount, F.lit("g carbs")))
        .when(
            event_type == "bsl",
            F.concat(amount, F.lit(" "), F.coalesce(meta.getField("unit"), F.lit("mmol/L"))),
        )
        .when(event_type == "exercise", F.concat(amount, F.lit(" min")))
        .otherwise(amount)
    )
