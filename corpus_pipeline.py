"""From raw documents to packed training sequences: five stages, each a table that the next one reads.

Order: quality, near duplicates, repeated passages, benchmark passages, packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.llm import base, decontam, minhash, packing, quality, suffix_dedup


#: Passages of this many words go if they occur twice; they are looked for where as many words in a row do.
REPEATED_WORDS, ANCHOR_WORDS = 50, 20


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, each by its own text."""
    return quality.accepted(docs, base.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. A row without doc_id stays."""
    base.ready(spark)
    others = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of fifty words that occur twice; n_chars is that of the new text.

    Every row stays, with its own columns. Rows of equal doc_id and text are one document and do not cut each other;
    others are documents of their own, also without doc_id or of a doc_id with several texts. They are told apart by a
    64-bit hash of both.
    """
    base.ready(spark)
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    cut = suffix_dedup.without_repeats(docs.select(key.alias("doc_id"), "text"), REPEATED_WORDS, ANCHOR_WORDS, unit="word")
    text = cut.select(F.col("doc_id").alias("key"), F.col("kept").cast("string").alias("kept"))
    # Columns of any name stay apart from these in a structure.
    rest = docs.select(key.alias("key"), F.struct(*(c for c in docs.columns if c not in ("text", "n_chars"))).alias("row"))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return text.join(rest, "key").select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.clean(docs, base.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 1024 ids."""
    base.ready(spark)
    return packing.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", accept),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = base.kept_table(stage(spark, docs, sf_dir))
    return docs
