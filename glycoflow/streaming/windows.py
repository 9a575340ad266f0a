"""Windowed views of the event stream. Each function takes a stream or a batch alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glycoflow.functions import circadian, glucose
from glycoflow.operators import log as log_ops
from glycoflow.operators.grid import Grid
from glycoflow.plans import state

LONGEST_EFFECT_HOURS = 24


def once(events: DataFrame, delay: str, at: str = "ts") -> DataFrame:
    """Events with their watermark, each id once: a file delivered again changes nothing. Rows without an id column stay."""
    marked = events.withWatermark(at, delay)
    if "id" not in events.columns:
        return marked
    if events.isStreaming:
        return marked.dropDuplicatesWithinWatermark(["id"])
    return marked.dropDuplicates(["id"])


def _readings(events: DataFrame, delay: str) -> DataFrame:
    return once(events.filter(F.col("event_type") == "bsl"), delay)


def glucose_windows(events: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Tumbling glucose windows per subject. The grouping combines map-side, so a subject
    with very many readings sends one row per task and window."""
    return (
        _readings(events, delay)
        .groupBy("subject_id", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("avg_bsl"),
            F.min("value").alias("min_bsl"),
            F.max("value").alias("max_bsl"),
            F.count_if(glucose.in_target(F.col("value"), F.lit("mmol/L"))).alias("n_in_range"),
        )
        .select("subject_id", F.col("w.start").alias("window_start"), "n", "avg_bsl", "min_bsl",
                "max_bsl", "n_in_range")
    )


def session_windows(events: DataFrame, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Runs of events of one subject less than a gap apart, as a stream closes them. An id counts once."""
    return (
        once(events, delay)
        .groupBy("subject_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("session_start"),
             F.max("ts").alias("session_last"))
        .select("subject_id", "session_start", "session_last", "n_events")
    )


def day_totals(events: DataFrame, tz: str | None = None, delay_minutes: int = 10) -> DataFrame:
    """The summary of each subject and local day, for a sink in update or append mode.

    A day's event time is the instant at which it ends in the time zone, so its sums, and the ids seen in it, leave the
    state once that instant is a delay behind: in update mode a day's row comes again whenever it changes
    (`upsert_days` stores the last one), in append mode once, when the day is closed. An id counts once.
    """
    day = F.to_date(circadian.local_time(F.col("ts"), tz))
    end = F.date_add(day, 1).cast("timestamp")
    # The newest event's own day may end a whole day after it.
    dated = events.withColumn("day", day).withColumn("day_end", end if tz is None else F.to_utc_timestamp(end, tz))
    known = once(dated, f"{26 * 60 + delay_minutes} minutes", at="day_end")
    return log_ops.day_summary(known, tz, by=["day_end"]).drop("day_end")


def upsert_days(rows: DataFrame, path: str, batch_id: int) -> None:
    """Store the rows of one batch of `day_totals` as the newest of their subject and day.

    One folder per batch, so a batch that runs again writes the same; `stored_days` picks the last row of each day.
    """
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """The last row of every subject and day, from what `upsert_days` has stored."""
    rows = spark.read.parquet(path)
    names = [c for c in rows.columns if c not in ("subject_id", "day", "batch")]
    newest = rows.groupBy("subject_id", "day").agg(F.max_by(F.struct(*names), "batch").alias("row"))
    return newest.select("subject_id", "day", *[F.col("row")[c].alias(c) for c in names])


def decay_totals(
    events: DataFrame, grid: Grid, delay_minutes: int = 10, params: DataFrame | None = None
) -> DataFrame:
    """Active insulin, carbs and alcohol per subject and grid instant, kept across batches.

    An event is spread over the instants it acts in without any state; what is kept is one
    row of sums per open instant, in Spark's own state store. An instant closes when no
    event can reach it any more: the watermark runs behind the furthest instant seen by
    the longest effect plus the allowed delay. A late event within the delay thus still
    reaches all its open instants. In batch an id counts once; a stream can mark time once
    only, here by instants. For files that may be delivered again, a grid without an end and
    instants told again when a late event changes them, see `decay.open_decay`.
    """
    seen = events if events.isStreaming else events.dropDuplicates(["id"])
    behind = f"{LONGEST_EFFECT_HOURS * 60 + delay_minutes} minutes"
    at = F.timestamp_millis(grid.at_ms(F.col("idx")))
    sums = {
        "iob": F.coalesce(F.sum("iob"), F.lit(0.0)),
        "cob": F.coalesce(F.sum("cob"), F.lit(0.0)),
        "alcohol_in_system": F.coalesce(F.sum("alcohol_in_system"), F.lit(0.0)),
        "sensitivity_modifier": F.coalesce(F.product("sensitivity_modifier"), F.lit(1.0)),
    }
    if not events.isStreaming:
        tasks = state.tasks_for(events.select("subject_id").distinct(), grid)
        return state.summed_effects(seen, grid, tasks, sums, params).select(
            "subject_id", at.alias("at_ts"), *sums
        )
    return (
        state.all_contributions(seen, grid, params)
        .withColumn("at_ts", at)
        .withWatermark("at_ts", behind)
        .groupBy("subject_id", "at_ts")
        .agg(*[total.alias(name) for name, total in sums.items()])
    )
