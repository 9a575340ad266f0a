"""Late events: telling them apart and finding what they make stale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glycoflow import values


def flag_late(events: DataFrame, delay_minutes: int, ingested: str = "ingest_ts") -> DataFrame:
    """Add `lateness_ms` and `is_late`."""
    lateness = F.unix_millis(ingested) - F.unix_millis("ts")
    return events.withColumn("lateness_ms", lateness).withColumn(
        "is_late", lateness > delay_minutes * 60_000
    )


def stale_ranges(late: DataFrame) -> DataFrame:
    """Per subject and day of the late events, the span of instants to compute again: from
    the first late event to the end of the longest effect of the last one."""
    longest = int(max(v["duration"] for v in values.INSULIN.values()))
    return (
        late.groupBy("subject_id", F.to_date("ts").alias("day"))
        .agg(F.min("ts").alias("stale_from"), F.max("ts").alias("_last"),
             F.count(F.lit(1)).alias("n_late"))
        .select(
            "subject_id", "day", "stale_from",
            (F.col("_last") + F.expr(f"INTERVAL {longest} MINUTES")).alias("stale_until"), "n_late",
        )
    )
