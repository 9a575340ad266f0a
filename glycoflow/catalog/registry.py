"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glycoflow.functions.jsmath import half_up

MODULES = ("logs", "kernels", "models", "imports", "curves", "estimates", "streams")


@dataclass(frozen=True)
class Entry:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    """Register `fn(spark, sf_dir)`; its result is made comparable by `presentable`."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return presentable(fn(spark, sf_dir))

        if name in ENTRIES:
            raise ValueError(f"{name} is registered twice")
        ENTRIES[name] = Entry(name, run, sql)
        return fn

    return wrap


def presentable(df: DataFrame) -> DataFrame:
    """Plain columns two engines can agree on.

    Doubles are rounded to six places, instants become epoch milliseconds, dates become
    text, flags become 0/1 and arrays of text are joined with "|".
    """
    out = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            column = half_up(column.cast("double"), 6)
        elif isinstance(kind, T.TimestampType):
            column = F.unix_millis(column)
        elif isinstance(kind, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(kind, (T.BooleanType, T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        elif isinstance(kind, T.ArrayType):
            column = F.array_join(column.cast("array<string>"), "|")
        out.append(column.alias(field.name))
    return df.select(*out)


def load_all() -> None:
    for module in MODULES:
        import_module(f"glycoflow.catalog.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return {name: entry.run for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql}


def r6(expression: str) -> str:
    """SQL text rounding a double as `presentable` does."""
    return f"floor(({expression})*1e6+0.5)/1e6"
