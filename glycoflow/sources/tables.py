"""The stored event table: keyed upsert, append, patch, delete, compaction, backup."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glycoflow import schemas
from glycoflow.functions import dates
from glycoflow.functions.jsmath import falsy, text_or_default


def event_key(df: DataFrame) -> Column:
    """A key that is the same whenever the same event is loaded again.

    It covers all metadata, and tells a missing field from an empty one. Events alike in
    everything are told apart by their number; which of them gets which does not matter.
    """
    fields = [c for c in ("meta", "metadata_json") if c in df.columns]
    content = F.to_json(
        F.struct("subject_id", F.unix_millis("ts").alias("ms"), "event_type", "value", *fields),
        {"ignoreNullFields": "false"},
    )
    nth = F.row_number().over(Window.partitionBy(F.sha2(content, 256)).orderBy(F.lit(1)))
    return F.sha2(F.concat_ws("|", content, nth), 256)


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of `base` replaced by the newest change with the same key; new keys are added.

    Rows of a key, the stored one among them, are ranked by `order`; a missing stamp ranks
    below all others. Of equal stamps a change goes before the stored row, and among changes
    the content decides, so the result does not depend on the order of arrival. A base
    without the `order` column is older than every change. Only rows of changed keys are
    compared; no window runs over the base table.
    """
    columns = [c for c in base.columns if c not in keys]

    def ranked(rows: DataFrame, is_change: bool) -> DataFrame:
        stamp = F.col(order) if order in rows.columns else F.lit(None)
        stamp = stamp.cast(changes.schema[order].dataType)
        row = F.struct(*columns)
        rank = F.struct(
            stamp.isNotNull().alias("known"), stamp.alias("stamp"),
            F.lit(is_change).alias("is_change"), F.sha2(F.to_json(row), 256).alias("tie"),
        )
        return rows.select(*keys, rank.alias("_rank"), row.alias("_row"))

    newest = ranked(changes, True).groupBy(*keys).agg(
        F.max_by("_row", "_rank").alias("_row"), F.max("_rank").alias("_rank")
    )
    touched = newest.select(*keys)
    kept = base.join(touched, keys, "left_anti")
    stored = ranked(base.join(touched, keys, "left_semi"), False)
    best = stored.unionByName(newest).groupBy(*keys).agg(F.max_by("_row", "_rank").alias("_row"))
    return kept.unionByName(
        best.select(*keys, *[F.col("_row").getField(c).alias(c) for c in columns])
    )


def save_results(
    base: DataFrame, changes: DataFrame, order: str, strict_key: bool = True
) -> DataFrame:
    """Upsert of validation results. The key is (test_entry_id, provider); with
    `strict_key` off it is the entry alone, so providers overwrite each other."""
    keys = ["test_entry_id", "provider"] if strict_key else ["test_entry_id"]
    return upsert(base, changes, keys, order)


def stamped(rows: DataFrame, as_of) -> DataFrame:
    """Rows ready to append: deterministic id, created and updated stamps."""
    now = F.lit(as_of).cast("timestamp")
    return (
        rows.withColumn("id", event_key(rows))
        .withColumn("created_at", now)
        .withColumn("updated_at", now)
        .withColumn("synced", F.lit(False))
    )


def append(rows: DataFrame, path: str) -> None:
    """Append to the table partitioned by day; rows of a day are brought together first so
    that a load writes few files, and a crowded day is split by subject and hour."""
    (
        rows.withColumn("event_date", F.to_date("ts"))
        .withColumn("_hour", F.hour("ts"))
        .hint("rebalance", F.col("event_date"), F.col("_hour"))
        .drop("_hour")
        .sortWithinPartitions("event_date", "subject_id", "ts")
        .write.mode("append")
        .partitionBy("event_date")
        .parquet(path)
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def patch(base: DataFrame, changes: DataFrame, key: str, as_of) -> DataFrame:
    """Shallow merge: non-NULL change columns win and the row's updated stamp moves."""
    names = [c for c in changes.columns if c != key]
    renamed = changes.select(
        key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in names]
    )
    joined = base.join(renamed, key, "left")
    out = []
    for c in base.columns:
        if c in names:
            out.append(F.coalesce(f"_new_{c}", c).alias(c))
        elif c == "updated_at":
            moved = F.when(F.col("_hit"), F.lit(as_of).cast("timestamp"))
            out.append(F.coalesce(moved, F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def missing_keys(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes whose key the base does not hold."""
    return changes.join(base.select(key), key, "left_anti")


def delete(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


# -- JSON and CSV export --------------------------------------------------------------


def export_documents(log: DataFrame) -> DataFrame:
    """Events in the exported field names, instants as ISO text, metadata as JSON.

    Metadata kept as text (`metadata_json`) goes out as it came in.
    """
    names = [F.col("meta").getField(s).alias(c) for s, c in schemas.META_NAMES.items()]
    metadata = F.to_json(F.struct(*names))
    if "metadata_json" in log.columns:
        metadata = F.coalesce("metadata_json", metadata)
    return log.select(
        "id",
        F.col("subject_id").alias("subjectId"),
        dates.iso_millis(F.col("ts")).alias("timestamp"),
        F.col("event_type").alias("eventType"),
        "value",
        metadata.alias("metadata"),
        dates.iso_millis(F.col("created_at")).alias("createdAt"),
        dates.iso_millis(F.col("updated_at")).alias("updatedAt"),
        "synced",
    )


def export_manifest(log: DataFrame, kind: str = "export", as_of=None) -> DataFrame:
    """The envelope of an export: one row; with the time of the export if one is given."""
    stamp = [] if as_of is None else [dates.iso_millis(F.lit(as_of).cast("timestamp")).alias("createdAt")]
    return log.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("1.0").alias("version"), F.lit(kind).alias("type"), *stamp, "count"
    )


def write_backup(log: DataFrame, path: str, as_of=None) -> None:
    """Events one per line under `events`, the envelope under `manifest`."""
    export_documents(log).write.mode("overwrite").json(f"{path}/events")
    export_manifest(log, "backup", as_of).write.mode("overwrite").json(f"{path}/manifest")


def restore_lines(lines: DataFrame, body: str = "value", keep_raw: bool = False) -> DataFrame:
    """Events back from exported JSON lines, ids kept; with the line itself as `raw` on request."""
    raw = [F.col(body).alias("raw")] if keep_raw else []
    parsed = lines.select(F.from_json(body, schemas.EXPORTED_EVENT).alias("e"), *raw)
    return parsed.select(*_event_columns(), *(["raw"] if keep_raw else []))


def restore_documents(
    docs: DataFrame, body: str, run: str | None = None, subject: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """Events out of whole backup documents, under new ids.

    Metadata may be an object in the exported field names, or its text; all of it is kept
    in `metadata_json`. `subject` is taken where an event names none. An id follows from the
    run, the document and the event's place in it: tried again, a task makes the same ids,
    while another run makes copies. A document that cannot be read or holds no events gives
    one row. `error` tells these and events without a readable instant or type apart.
    Columns named in `carry` stay.
    """
    run = run if run is not None else uuid.uuid4().hex
    parsed = docs.select(
        F.sha2(F.coalesce(body, F.lit("")), 256).alias("document"),
        F.from_json(body, schemas.BACKUP, {"columnNameOfCorruptRecord": "broken"}).alias("d"),
        *([] if subject is None else [subject.alias("_subject")]),
        *(carry or []),
    )
    exploded = parsed.select(
        "*", (F.col("d").isNull() | F.col("d.broken").isNotNull()).alias("unreadable"),
        F.posexplode_outer("d.events").alias("pos", "e"),
    )
    error = (
        F.when(F.col("unreadable"), F.lit("NOT_JSON"))
        .when(F.col("pos").isNull(), F.lit("NO_EVENTS"))
        .when(F.col("ts").isNull() | F.col("event_type").isNull(), F.lit("BAD_EVENT"))
    )
    name = F.concat_ws("|", F.lit(run), "document", F.col("pos").cast("string"))
    restored = exploded.select(
        *_event_columns(F.col("_subject") if subject is not None else None),
        *(carry or []), F.col("e.id").alias("source_id"), "pos", "unreadable", F.sha2(name, 256).alias("_new_id"),
    )
    return (
        restored.withColumn("id", F.when(F.col("pos").isNotNull(), F.col("_new_id")))
        .withColumn("error", error)
        .withColumn("failed", F.col("error").isNotNull())
        .drop("_new_id", "pos", "unreadable")
    )


def read_backup(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """Backup files each holding one document with an `events` array, which one task reads.

    Backups made of lines (`write_backup`) are split freely: read them with `restore_lines`.
    """
    docs = spark.read.text(path, wholetext=True)
    return restore_documents(docs, "value", run)


def parsed_meta(text: Column) -> Column:
    """The known metadata fields out of JSON, in exported or in stored field names."""
    stored = F.from_json(text, schemas.META)
    exported = F.from_json(text, schemas.EXPORTED_META)
    fields = [
        F.coalesce(exported.getField(c), stored.getField(s)).alias(s)
        for s, c in schemas.META_NAMES.items()
    ]
    return F.when(text.isNotNull(), F.struct(*fields))


def _event_columns(subject: Column | None = None) -> list[Column]:
    owner = F.col("e.subjectId") if subject is None else F.coalesce(F.col("e.subjectId"), subject)
    return [
        F.col("e.id").alias("id"),
        owner.alias("subject_id"),
        F.try_to_timestamp("e.timestamp").alias("ts"),
        F.col("e.eventType").alias("event_type"),
        F.col("e.value").alias("value"),
        parsed_meta(F.col("e.metadata")).alias("meta"),
        F.col("e.metadata").alias("metadata_json"),
        F.try_to_timestamp("e.createdAt").alias("created_at"),
        F.try_to_timestamp("e.updatedAt").alias("updated_at"),
        F.col("e.synced").alias("synced"),
    ]


def _number(x: Column) -> Column:
    whole = x == F.floor(x)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def export_columns(log: DataFrame) -> DataFrame:
    """The 16 export columns as text; empty and zero metadata become '', `false` stays."""
    meta = F.col("meta")

    def number(name: str) -> Column:
        field = meta.getField(name)
        return F.when(falsy(field), F.lit("")).otherwise(_number(field))

    def text(name: str) -> Column:
        return text_or_default(meta.getField(name), "")

    flag = F.coalesce(meta.getField("is_finger_prick").cast("string"), F.lit(""))
    return log.select(
        "id",
        dates.iso_millis(F.col("ts")).alias("timestamp"),
        F.col("event_type").alias("eventType"),
        _number(F.col("value")).alias("value"),
        text("unit").alias("unit"),
        text("source").alias("source"),
        text("device").alias("device"),
        flag.alias("isFingerPrick"),
        text("type").alias("insulinType"),
        number("carbs").alias("carbs"),
        number("protein").alias("protein"),
        number("fat").alias("fat"),
        number("calories").alias("calories"),
        text("description").alias("description"),
        dates.iso_millis(F.col("created_at")).alias("createdAt"),
        dates.iso_millis(F.col("updated_at")).alias("updatedAt"),
    )


def export_path(prefix: str, as_of, extension: str) -> str:
    return f"{prefix}-{as_of:%Y-%m-%d}.{extension}"


def write_csv(log: DataFrame, prefix: str, as_of) -> str:
    """CSV files under a dated folder; a field is quoted only where it must be."""
    path = export_path(prefix, as_of, "csv")
    (
        export_columns(log)
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
    return path
