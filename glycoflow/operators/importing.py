"""Import of readings: validation, duplicate detection, conflict strategies, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_MS = 300_000
NEAR_VALUE = 0.5
EXACT_VALUE = 0.01
STRATEGIES = ("skip", "keep-existing", "keep-import", "keep-both")


def validate(rows: DataFrame, as_of) -> DataFrame:
    """Rows (ts, value) with `errors`, `warnings` and `is_valid`."""
    ts, value, now = F.col("ts"), F.col("value"), F.lit(as_of).cast("timestamp")
    unusable = value.isNull() | F.isnan(value)
    impossible = (value < 1) | (value > 35)
    unusual = ((value < 2) | (value > 30)) & ~impossible

    def codes(*rules: tuple[Column, str]) -> Column:
        return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in rules]))

    return (
        rows.withColumn(
            "errors",
            codes(
                (ts.isNull(), "TIMESTAMP_INVALID"),
                (unusable, "VALUE_INVALID"),
                (~unusable & impossible, "VALUE_OUT_OF_RANGE"),
            ),
        )
        .withColumn(
            "warnings",
            codes(
                (ts > now, "TIMESTAMP_FUTURE"),
                (ts < now - F.expr("INTERVAL 5 YEARS"), "TIMESTAMP_OLD"),
                (~unusable & unusual, "VALUE_UNUSUAL"),
            ),
        )
        .withColumn("is_valid", F.size("errors") == 0)
    )


def find_duplicates(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """The existing reading each import row duplicates, at most one.

    `rows`: row_id, subject_id, ts, value; `existing`: a log. Both sides are first reduced
    to distinct (subject, instant, value), so copies cost nothing; they then meet on
    (subject, 5-minute cell, half-unit cell) and the earliest hit by (time, id) is kept by
    a map-side minimum. That earliest hit decides: a near one before an exact one wins.
    """
    cell_of_time = F.expr(f"ms div {WINDOW_MS}")
    cell_of_value = F.floor(F.col("value") / F.lit(NEAR_VALUE))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    keyed = rows.withColumn("ms", F.unix_millis("ts"))
    probes = (
        keyed.select("subject_id", "ms", "value")
        .distinct()
        .withColumn("_t", F.explode(F.transform(near, lambda d: d + cell_of_time)))
        .withColumn("_v", F.explode(F.transform(near, lambda d: d + cell_of_value)))
    )
    targets = (
        existing.filter(F.col("event_type") == "bsl")
        .select("subject_id", F.unix_millis("ts").alias("ms"), "value", "id")
        .groupBy("subject_id", "ms", "value")
        .agg(F.min("id").alias("id"))
        .select(
            "subject_id",
            cell_of_time.alias("_t"),
            cell_of_value.alias("_v"),
            F.col("ms").alias("e_ms"),
            F.col("value").alias("e_value"),
            F.col("id").alias("e_id"),
        )
    )
    close = (F.abs(F.col("ms") - F.col("e_ms")) <= WINDOW_MS) & (
        F.abs(F.col("e_value") - F.col("value")) < NEAR_VALUE
    )
    first = (
        probes.join(targets, ["subject_id", "_t", "_v"])
        .filter(close)
        .groupBy("subject_id", "ms", "value")
        .agg(F.min(F.struct("e_ms", "e_id", "e_value")).alias("e"))
    )
    apart = F.abs(F.col("ms") - F.col("e.e_ms"))
    exact = (apart == 0) & (F.abs(F.col("e.e_value") - F.col("value")) < EXACT_VALUE)
    return keyed.join(first, ["subject_id", "ms", "value"]).select(
        "row_id",
        "subject_id",
        F.col("e.e_id").alias("existing_id"),
        F.when(exact, F.lit("exact")).otherwise(F.lit("near")).alias("match_type"),
        apart.alias("time_difference_ms"),
    )


def duplicate_stats(duplicates: DataFrame) -> DataFrame:
    return duplicates.agg(
        F.count_if(F.col("match_type") == "exact").alias("exact"),
        F.count_if(F.col("match_type") == "near").alias("near"),
        F.count(F.lit(1)).alias("total"),
    )


def rows_to_import(rows: DataFrame, duplicates: DataFrame, strategy: str) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy in ("skip", "keep-existing"):
        return rows.join(duplicates.select("row_id"), "row_id", "left_anti")
    return rows


def rows_to_skip(rows: DataFrame, duplicates: DataFrame, strategy: str) -> DataFrame:
    if strategy in ("skip", "keep-existing"):
        return rows.join(duplicates.select("row_id"), "row_id", "left_semi")
    return rows.limit(0)


def events_to_delete(duplicates: DataFrame, strategy: str) -> DataFrame:
    ids = duplicates.select(F.col("existing_id").alias("id")).distinct()
    return ids if strategy == "keep-import" else ids.limit(0)


def strategy_counts(rows: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(strategy, outcome, n): what every strategy would do, from one look at the duplicates."""
    hits = duplicates.select("row_id", F.lit(True).alias("_hit"))
    dropped = F.col("strategy").isin("skip", "keep-existing") & F.col("_hit").isNotNull()
    outcome = F.when(dropped, F.lit("skip")).otherwise(F.lit("import"))
    strategies = F.explode(F.array(*[F.lit(s) for s in STRATEGIES]))
    taken = (
        rows.join(hits, "row_id", "left")
        .withColumn("strategy", strategies)
        .groupBy("strategy", outcome.alias("outcome"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    gone = events_to_delete(duplicates, "keep-import").agg(F.count(F.lit(1)).alias("n"))
    gone = gone.select(F.lit("keep-import").alias("strategy"), F.lit("delete").alias("outcome"), "n")
    return taken.unionByName(gone.filter(F.col("n") > 0))


def apply_import(
    log: DataFrame, rows: DataFrame, duplicates: DataFrame, strategy: str
) -> DataFrame:
    """The log after the import: what stays of it, and the imported rows as readings."""
    from glycoflow.operators.log import bsl_events

    kept = log
    if strategy == "keep-import":
        kept = log.join(events_to_delete(duplicates, strategy), "id", "left_anti")
    taken = rows_to_import(rows, duplicates, strategy)
    device = F.col("device") if "device" in rows.columns else F.lit(None).cast("string")
    imported = bsl_events(
        taken.select(
            F.col("row_id").alias("id"), "subject_id", "ts", F.col("value").alias("reading"),
            F.lit("csv-import").alias("source"), device.alias("device"),
        )
    )
    return kept.unionByName(imported)


def import_report(checked: DataFrame, duplicates: DataFrame, by: list[str]) -> DataFrame:
    """Per file or subject: totals, valid and invalid rows, duplicates and the time range of
    valid rows, NULL when there are none."""
    valid = F.col("is_valid")
    hits = duplicates.select("row_id", F.lit(1).alias("_dup"))
    return (
        checked.join(hits, "row_id", "left")
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(valid).alias("valid_rows"),
            F.count_if(~valid).alias("invalid_rows"),
            F.count("_dup").alias("duplicates"),
            F.min(F.when(valid, F.col("ts"))).alias("range_start"),
            F.max(F.when(valid, F.col("ts"))).alias("range_end"),
        )
    )


def sample_rows(checked: DataFrame, order: str, n: int = 5) -> DataFrame:
    """First valid rows, as a preview."""
    return checked.filter("is_valid").orderBy(order).limit(n)


def commit_counts(
    checked: DataFrame, duplicates: DataFrame, strategy: str
) -> DataFrame:
    """Imported, skipped, failed and handled, as the commit of an import reports them."""
    skips = strategy in ("skip", "keep-existing")
    hits = duplicates.select("row_id", F.lit(1).alias("_dup"))
    valid, hit = F.col("is_valid"), F.col("_dup").isNotNull()
    dropped = hit if skips else F.lit(False)
    return checked.join(hits, "row_id", "left").agg(
        F.count_if(valid & ~dropped).alias("imported"),
        F.count_if(valid & dropped).alias("skipped"),
        F.count_if(~valid).alias("failed"),
        F.count_if(valid & hit).alias("duplicates_handled"),
    )
