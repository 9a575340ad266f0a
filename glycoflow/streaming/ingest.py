"""Incremental loading of event files into the day-partitioned table."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glycoflow.sources.tables import restore_lines, upsert
from glycoflow.sources.versions import KeyIndex, Version, VersionedTable, days_of
from glycoflow.streaming.late import flag_late


def event_files(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Exported event lines as they land in a folder, each with its text as `raw`."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return restore_lines(lines, keep_raw=True)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _existing(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    files, where = _at(spark, path)
    return spark.read.schema(like.schema).parquet(path) if files.exists(where) else like.limit(0)


def merge_batch(
    spark: SparkSession, batch: DataFrame, path: str, load: str | None = None,
    rejected: str | None = None,
) -> None:
    """Upsert one batch by id, rewriting only the days it touches.

    Those are the days of its rows and the days where the table holds an event of the same
    id, which may have moved. Rows without id, instant or type go to `rejected` (by default
    a folder beside the table), under the name of the load. Running a batch again gives the
    same tables. The swap of days is not atomic: a driver lost between the removal of a day's
    old files and the move of the new ones loses stored rows of that day. `merge_version` has
    no such gap; this is for tables that others read by their path.
    """
    whole = F.col("id").isNotNull() & F.col("ts").isNotNull() & F.col("event_type").isNotNull()
    (
        batch.filter(~whole)
        .withColumn("load", F.lit(load if load is not None else uuid.uuid4().hex))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("load")
        .parquet(rejected or f"{path.rstrip('/')}-rejected")
    )
    rows = batch.filter(whole).drop("raw").withColumn("event_date", F.to_date("ts"))
    table = _existing(spark, path, rows).select(*rows.columns)
    moved = table.join(rows.select("id").distinct(), "id", "left_semi").select("event_date")
    days = moved.union(rows.select("event_date")).distinct()
    merged = upsert(table.join(days, "event_date", "left_semi"), rows, ["id"], "updated_at")
    left = merged.select("event_date").distinct()
    emptied = [r[0] for r in days.join(left, "event_date", "left_anti").toLocalIterator()]
    (
        merged.withColumn("_hour", F.hour("ts"))
        .hint("rebalance", F.col("event_date"), F.col("_hour"))
        .drop("_hour")
        .sortWithinPartitions("event_date", "subject_id", "ts")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )
    # A dynamic overwrite leaves a day alone from which all events have moved away.
    for day in emptied:
        files, where = _at(spark, f"{path}/event_date={day.isoformat()}")
        files.delete(where, True)


def merge_version(
    batch: DataFrame, table: VersionedTable, index: KeyIndex, load: tuple[str, int] | None = None
) -> Version:
    """Upsert one batch by id into a table in versions, as one new version.

    The days to rewrite are those of the batch's rows and those on which the index has its ids; files of other
    days are not read. A batch that stops anywhere leaves the last version in place, and one that is run again under the
    same `load` (stream and batch number) after it was committed changes nothing. Rows without id, instant or type
    are left out, as are columns that the table does not have; those that the batch does not have are NULL.
    """
    whole = F.col("id").isNotNull() & F.col("ts").isNotNull() & F.col("event_type").isNotNull()
    columns = [F.col(f.name) if f.name in batch.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]
    rows = batch.filter(whole).select(*columns).withColumn("event_date", F.to_date("ts"))

    def change(base: Version) -> tuple[dict[str, list[str]], tuple[str, int] | None]:
        if load is not None and base.loads.get(load[0], -1) >= load[1]:
            return {}, load
        known = index.known(rows)
        # The index goes first: naming a day too many does no harm, missing one would.
        index.add(rows, known)
        days = days_of(known.select("event_date").union(rows.select("event_date")))
        merged = upsert(table.read(base, days).select(*rows.columns), rows, ["id"], "updated_at")
        hours = merged.withColumn("_hour", F.hour("ts")).hint("rebalance", F.col("event_date"), F.col("_hour"))
        staged = table.stage(hours.drop("_hour").sortWithinPartitions("event_date", "subject_id", "ts"))
        return {d: staged.get(d, []) for d in days}, load

    return table.replace(change)


def start_versioned_ingest(
    events: DataFrame, table: VersionedTable, index: KeyIndex, checkpoint: str, name: str
) -> StreamingQuery:
    """Keep a table in versions up to date with a stream; stops when all files now there are read.

    `name` tells this stream from others that load into the table, and goes with its checkpoint.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        merge_version(batch, table, index, (name, batch_id))

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_ingest(
    events: DataFrame, path: str, checkpoint: str, late_path: str | None = None,
    delay_minutes: int = 10, ingest_ts: Column | None = None,
) -> StreamingQuery:
    """Keep the table up to date with a stream; stops when all files now there are read.

    Rows that came later than the delay also go to a side table, so that the instants they
    make stale can be computed again. They came when their batch ran, unless `ingest_ts`
    says otherwise.
    """
    spark = events.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        # The batch's own time, and its name in the checkpoint that keeps count of batches.
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        merge_batch(spark, batch, path, f"{query}-{batch_id}")
        if late_path is not None:
            stamped = batch.drop("raw").withColumn("ingest_ts", F.current_timestamp() if ingest_ts is None else ingest_ts)
            seen = flag_late(stamped, delay_minutes)
            (
                seen.filter("is_late")
                .withColumn("batch_id", F.lit(batch_id))
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy("batch_id")
                .parquet(late_path)
            )

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_recent_view(
    events: DataFrame, path: str, checkpoint: str, limit: int = 20
) -> StreamingQuery:
    """Latest `limit` events of every subject, one version of the view per batch.

    A version is the best of the version before and the new rows, so a batch reads at most
    `limit` old rows per subject, and repeating a batch rewrites the same version.
    """
    spark = events.sparkSession
    newest = Window.partitionBy("subject_id").orderBy(F.desc("ts"), F.desc("id"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter("id IS NOT NULL").drop("raw")
        rows = upsert(rows.limit(0), rows, ["id"], "updated_at")
        before = _existing(spark, f"{path}/version={batch_id - 1}", rows)
        (
            before.join(rows.select("id"), "id", "left_anti")
            .unionByName(rows)
            .withColumn("rank", F.row_number().over(newest))
            .filter(F.col("rank") <= limit)
            .drop("rank")
            .write.mode("overwrite")
            .parquet(f"{path}/version={batch_id}")
        )

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
