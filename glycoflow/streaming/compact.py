"""Compaction of the small files incremental loads leave behind."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_counts(events: DataFrame) -> DataFrame:
    """Files and rows per day of a table."""
    return events.groupBy("event_date").agg(
        F.count_distinct(F.col("_metadata.file_path")).alias("n_files"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def compact_day(
    spark: SparkSession, path: str, day: date, rows_per_file: int = 5_000_000
) -> None:
    """Rewrite one day into files of about `rows_per_file` rows, in (subject, time) order.

    Ranges, not hashes, of (subject, time) are written, so a crowded subject is cut into as
    many files as it needs. The swap is not atomic: Spark removes the day's old files and then
    moves the new ones there, and two writers of one day would lose each other's rows. Run it
    where the ingest runs, between batches, and let readers of that day wait.
    """
    rows = spark.read.parquet(path).filter(F.col("event_date") == F.lit(day))
    n_files = max(1, -(-rows.count() // rows_per_file))
    (
        rows.repartitionByRange(n_files, "subject_id", "ts")
        .sortWithinPartitions("subject_id", "ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )
