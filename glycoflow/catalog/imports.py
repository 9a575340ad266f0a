"""Sources, sinks, validation and import over data derived from the given tables."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from glycoflow.catalog.adapter import LOG, SPAN, event_log, event_rows, log_span, table
from glycoflow.catalog.kernels import groups_sql
from glycoflow.catalog.logs import FLAT, FLAT_SQL, _NUM, _with
from glycoflow.catalog.registry import query, r6
from glycoflow import values
from glycoflow.operators import importing
from glycoflow.session import shared_folder
from glycoflow.sources import csvfiles, payloads, tables, versions
from glycoflow.sources.versions import KeyIndex, Version, VersionedTable
from glycoflow.streaming.ingest import merge_version

LIBRE_HEADER = (
    "Device,Serial Number,Device Timestamp,Record Type,"
    "Historic Glucose mmol/L,Scan Glucose mmol/L"
)
DEXCOM_HEADER = (
    "Index,Timestamp (YYYY-MM-DDThh:mm:ss),Event Type,Event Subtype,"
    "Glucose Value (mg/dL),Transmitter ID"
)
GENERIC_HEADER = "Meter,Date,Blood Glucose,Units"


def export_lines(spark, sf):
    """All glucose readings written as lines of one export file per subject, in three formats."""
    log = event_log(spark, sf, ["bsl"], keep=("k",))
    rows = log.withColumn("style", F.pmod("subject_id", F.lit(3)))
    mgdl = F.floor(F.col("value") * 18.0182 + 0.5).cast("string")
    number, ts, kk = F.col("value").cast("string"), F.col("ts"), F.col("k")
    libre = F.concat(
        F.lit("FreeStyle Libre 3,SN"), F.col("subject_id"), F.lit(","),
        F.date_format(ts, "MM-dd-yyyy HH:mm"), F.lit(","),
        F.when(kk % 3 == 2, F.lit("6")).otherwise((kk % 3).cast("string")), F.lit(","), number,
        F.lit(","),
    )
    dexcom = F.concat(
        F.col("id"), F.lit(","), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(","),
        F.when(kk % 3 == 2, F.lit("Insulin")).otherwise(F.lit("EGV")), F.lit(",,"),
        F.when(F.col("value") < 4, F.lit("Low")).otherwise(mgdl), F.lit(",TX-"), F.col("subject_id"),
    )
    generic = F.concat(
        F.lit('"Acme, ""One""", '), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" ,"),
        F.when(kk % 2 == 0, F.concat(mgdl, F.lit(",mg/dl"))).otherwise(F.concat(number, F.lit("abc,mmol"))),
    )

    def styled(a, b, c):
        return F.when(F.col("style") == 0, a).when(F.col("style") == 1, b).otherwise(c)

    data = rows.select(
        F.concat(F.lit("subject-"), "subject_id").alias("file"),
        (F.col("id").cast("bigint") + 3).alias("line_no"),
        styled(libre, dexcom, generic).alias("value"),
    )
    headers = rows.select("subject_id", "style").distinct().select(
        F.concat(F.lit("subject-"), "subject_id").alias("file"),
        F.lit(2).cast("bigint").alias("line_no"),
        styled(F.lit(LIBRE_HEADER), F.lit(DEXCOM_HEADER), F.lit(GENERIC_HEADER)).alias("value"),
    )
    blanks = headers.select("file", F.lit(1).cast("bigint").alias("line_no"), F.lit("  ").alias("value"))
    return data.unionByName(headers).unionByName(blanks)


READ = """
rd AS (SELECT *, 'subject-' || subject_id AS file, subject_id % 3 AS style, floor(value*18.0182::DOUBLE+0.5) AS mg,
    row_number() OVER (PARTITION BY subject_id ORDER BY event_id) + 1 AS line_number FROM log WHERE event_type = 'bsl'),
pr AS (SELECT file, line_number, style, subject_id, event_id,
    CASE style WHEN 0 THEN 'freestyle-libre' WHEN 1 THEN 'dexcom' ELSE 'generic' END AS format,
    CASE style WHEN 0 THEN ms // 60000 * 60000 ELSE ms // 1000 * 1000 END AS ts,
    CASE style WHEN 0 THEN value WHEN 1 THEN mg/18.0182 ELSE CASE WHEN k % 2 = 0 THEN mg/18.0182 ELSE value END END AS value,
    CASE style WHEN 0 THEN 'FreeStyle Libre 3' WHEN 1 THEN 'Dexcom TX-' || subject_id ELSE 'Acme, "One"' END AS device
  FROM rd WHERE CASE style WHEN 0 THEN k % 3 < 2 WHEN 1 THEN k % 3 < 2 AND value >= 4 ELSE true END)
"""
PARSED_SQL = f"SELECT file, format, line_number, ts, {r6('value')} AS value, device FROM pr WHERE style = "


@query("s6_csv_records", _with(LOG, READ) + f"""
SELECT file, CAST(line_number AS BIGINT) AS line_number, CASE style
  WHEN 0 THEN 'FreeStyle Libre 3|SN' || subject_id || '|' || strftime(make_timestamp(ms*1000), '%m-%d-%Y %H:%M') || '|' ||
    CASE WHEN k % 3 = 2 THEN '6' ELSE CAST(k % 3 AS VARCHAR) END || '|' || CAST(value AS VARCHAR) || '|'
  WHEN 1 THEN id || '|' || strftime(make_timestamp(ms*1000), '%Y-%m-%dT%H:%M:%S') || '|' ||
    CASE WHEN k % 3 = 2 THEN 'Insulin' ELSE 'EGV' END || '||' || CASE WHEN value < 4 THEN 'Low' ELSE CAST(CAST(mg AS BIGINT) AS VARCHAR) END || '|TX-' || subject_id
  ELSE 'Acme, "One"|' || strftime(make_timestamp(ms*1000), '%Y-%m-%d %H:%M:%S') || '|' ||
    CASE WHEN k % 2 = 0 THEN CAST(CAST(mg AS BIGINT) AS VARCHAR) || '|mg/dl' ELSE CAST(value AS VARCHAR) || 'abc|mmol' END END AS cells
FROM rd""")
def csv_records(spark, sf):
    return csvfiles.records(export_lines(spark, sf))


@query("s7_format_detection", _with(LOG, READ) + """
SELECT DISTINCT file, CASE style WHEN 0 THEN 'freestyle-libre' WHEN 1 THEN 'dexcom' ELSE 'generic' END AS format FROM rd""")
def format_detection(spark, sf):
    return csvfiles.file_formats(export_lines(spark, sf))


def parsed(spark, sf):
    return csvfiles.parsed_rows(export_lines(spark, sf))


@query("s8_libre_rows", _with(LOG, READ) + PARSED_SQL + "0")
def libre_rows(spark, sf):
    return parsed(spark, sf).filter(F.col("format") == "freestyle-libre")


@query("s9_dexcom_rows", _with(LOG, READ) + PARSED_SQL + "1")
def dexcom_rows(spark, sf):
    return parsed(spark, sf).filter(F.col("format") == "dexcom")


@query("s10_mapped_rows", _with(LOG, READ) + PARSED_SQL + "2")
def mapped_rows(spark, sf):
    mapping = {"timestamp": "Date", "value": "Blood Glucose", "unit": "Units", "device": "Meter"}
    rows = csvfiles.parsed_rows(export_lines(spark, sf), mapping)
    return rows.filter(F.col("format") == "generic")


@query("s11_mapping_inference", _with(LOG, READ) + """
SELECT DISTINCT file, CASE style WHEN 0 THEN 'Device Timestamp' WHEN 1 THEN 'Timestamp (YYYY-MM-DDThh:mm:ss)' ELSE 'Date' END AS timestamp_column,
  CASE style WHEN 0 THEN 'Historic Glucose mmol/L' WHEN 1 THEN 'Glucose Value (mg/dL)' ELSE 'Blood Glucose' END AS value_column,
  CASE style WHEN 2 THEN 'Units' END AS unit_column, CASE style WHEN 0 THEN 'Device' WHEN 2 THEN 'Meter' END AS device_column FROM rd""")
def mapping_inference(spark, sf):
    return csvfiles.suggest_mapping(csvfiles.file_heads(export_lines(spark, sf)))


@query("s12_column_sniffers", """
SELECT c AS column, CAST(count_if(regexp_matches(t, '^\\d{4}-\\d{2}-\\d{2}|^\\d{2}-\\d{2}-\\d{4}|T\\d{2}:\\d{2}|\\d{2}:\\d{2}:\\d{2}')) >= count(*)*0.8 AS BIGINT) AS is_timestamp,
  CAST(count(x) >= count(*)*0.8 AND coalesce(bool_and(x BETWEEN 2 AND 30 OR x BETWEEN 36 AND 540), true) AS BIGINT) AS is_bsl
FROM (SELECT c, t, TRY_CAST(regexp_extract(t, '^\\s*([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1) AS DOUBLE) AS x FROM (
  SELECT unnest([struct_pack(c := 'ts', t := strftime(ts, '%Y-%m-%d %H:%M:%S')), struct_pack(c := 'value', t := CAST(value AS VARCHAR)),
    struct_pack(c := 'reading', t := CAST(2.0::DOUBLE + CAST(floor(value*100.0::DOUBLE) AS BIGINT) % 1800 / 100.0::DOUBLE AS VARCHAR)),
    struct_pack(c := 'props', t := props)], recursive := true) FROM events)) GROUP BY c""")
def column_sniffers(spark, sf):
    reading = F.lit(2.0) + F.pmod(F.floor(F.col("value") * 100.0), F.lit(1800)) / 100.0
    return csvfiles.sniff_columns(
        table(spark, sf, "events").select(
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
            F.col("value").cast("string").alias("value"),
            reading.cast("string").alias("reading"),
            "props",
        )
    )


# -- validation, duplicates, commit -----------------------------------------------------

ROWS = """
rows_in AS (SELECT 'r' || id AS row_id, subject_id, ms + (k % 10) * 40000 AS ms, value + (k % 12) * 0.05::DOUBLE - CASE WHEN k % 25 = 0 THEN 1.5 ELSE 0 END::DOUBLE AS value
  FROM log WHERE event_type = 'bsl'),
checked AS (SELECT r.*, value BETWEEN 1 AND 35 AS is_valid FROM rows_in r),
dups AS (SELECT row_id, subject_id, e.id AS existing_id, CASE WHEN e.dt = 0 AND abs(e.v - value) < 0.01 THEN 'exact' ELSE 'near' END AS match_type, e.dt AS time_difference_ms
  FROM (SELECT r.row_id, r.subject_id, r.value, arg_min(struct_pack(id := l.id, v := l.value, dt := abs(l.ms - r.ms)), (l.ms, l.id)) AS e
    FROM checked r JOIN log l ON l.subject_id = r.subject_id AND l.event_type = 'bsl' AND l.ms BETWEEN r.ms - 300000 AND r.ms + 300000
      AND abs(l.value - r.value) < 0.5 WHERE r.is_valid GROUP BY ALL))
"""


def import_rows(spark, sf):
    """Every reading again, later by up to six minutes and shifted in value."""
    log = event_log(spark, sf, ["bsl"], keep=("k",))
    shift = (F.col("k") % 12) * 0.05 - F.when(F.col("k") % 25 == 0, F.lit(1.5)).otherwise(F.lit(0.0))
    return log.select(
        F.concat(F.lit("r"), "id").alias("row_id"),
        "subject_id",
        F.timestamp_millis(F.unix_millis("ts") + (F.col("k") % 10) * 40_000).alias("ts"),
        (F.col("value") + shift).alias("value"),
    )


def checked_rows(spark, sf):
    _, end = log_span(spark, sf)
    return importing.validate(import_rows(spark, sf), end)


def found_duplicates(spark, sf):
    valid = checked_rows(spark, sf).filter("is_valid")
    return importing.find_duplicates(valid, event_log(spark, sf))


@query("p4_row_validation", _with(LOG, SPAN, ROWS) + """
SELECT row_id, CASE WHEN value < 1 OR value > 35 THEN 'VALUE_OUT_OF_RANGE' ELSE '' END AS errors,
  array_to_string(list_filter([CASE WHEN ms > mid THEN 'TIMESTAMP_FUTURE' END, CASE WHEN value >= 1 AND value < 2 THEN 'VALUE_UNUSUAL' END], lambda x: x IS NOT NULL), '|') AS warnings,
  CAST(is_valid AS BIGINT) AS is_valid FROM checked, (SELECT lo + 15*86400000 AS mid FROM span)""")
def row_validation(spark, sf):
    start, _ = log_span(spark, sf)
    return importing.validate(import_rows(spark, sf), start + timedelta(days=15)).select(
        "row_id", "errors", "warnings", "is_valid"
    )


@query("j1_duplicate_detection", _with(LOG, ROWS) + """
SELECT row_id, subject_id, existing_id, match_type, time_difference_ms FROM dups""")
def duplicate_detection(spark, sf):
    return found_duplicates(spark, sf)


@query("a8_duplicate_stats", _with(LOG, ROWS) + """
SELECT CAST(count_if(match_type = 'exact') AS BIGINT) AS exact, CAST(count_if(match_type = 'near') AS BIGINT) AS near,
  CAST(count(*) AS BIGINT) AS total FROM dups""")
def duplicate_stats(spark, sf):
    return importing.duplicate_stats(found_duplicates(spark, sf))


@query("j2_conflict_strategies", _with(LOG, ROWS) + """
SELECT strategy, outcome, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT s AS strategy, CASE WHEN d.row_id IS NOT NULL AND s IN ('skip', 'keep-existing') THEN 'skip' ELSE 'import' END AS outcome
  FROM (SELECT unnest(['skip','keep-existing','keep-import','keep-both']) AS s), checked c LEFT JOIN dups d ON d.row_id = c.row_id WHERE c.is_valid
  UNION ALL SELECT 'keep-import', 'delete' FROM (SELECT DISTINCT existing_id FROM dups)) GROUP BY ALL""")
def conflict_strategies(spark, sf):
    rows = checked_rows(spark, sf).filter("is_valid")
    duplicates = found_duplicates(spark, sf)
    return importing.strategy_counts(rows, duplicates)


@query("a9_import_report", _with(LOG, ROWS) + """
SELECT c.subject_id, CAST(count(*) AS BIGINT) AS total_rows, CAST(count_if(is_valid) AS BIGINT) AS valid_rows,
  CAST(count_if(NOT is_valid) AS BIGINT) AS invalid_rows, CAST(count(d.row_id) AS BIGINT) AS duplicates,
  min(ms) FILTER (is_valid) AS range_start, max(ms) FILTER (is_valid) AS range_end
FROM checked c LEFT JOIN dups d ON d.row_id = c.row_id GROUP BY c.subject_id""")
def import_report(spark, sf):
    return importing.import_report(
        checked_rows(spark, sf), found_duplicates(spark, sf), ["subject_id"]
    )


@query("a9_preview_rows", _with(LOG, ROWS) + f"""
SELECT row_id, {r6('value')} AS value FROM (SELECT *, row_number() OVER (ORDER BY row_id) AS n FROM checked WHERE is_valid) WHERE n <= 5""")
def preview_rows(spark, sf):
    """The first five valid rows, as the preview of an import shows them."""
    return importing.sample_rows(checked_rows(spark, sf), "row_id").select("row_id", "value")


@query("a9_commit_counts", _with(LOG, ROWS) + """
SELECT CAST(count_if(is_valid AND d.row_id IS NULL) AS BIGINT) AS imported, CAST(count_if(is_valid AND d.row_id IS NOT NULL) AS BIGINT) AS skipped,
  CAST(count_if(NOT is_valid) AS BIGINT) AS failed, CAST(count_if(is_valid AND d.row_id IS NOT NULL) AS BIGINT) AS duplicates_handled
FROM checked c LEFT JOIN dups d ON d.row_id = c.row_id""")
def commit_counts(spark, sf):
    return importing.commit_counts(checked_rows(spark, sf), found_duplicates(spark, sf), "skip")


@query("u2_import_applied", _with(LOG, ROWS) + f"""
SELECT {FLAT_SQL} FROM log WHERE id NOT IN (SELECT existing_id FROM dups)
UNION ALL SELECT row_id, subject_id, ms, 'bsl', {r6('value')} FROM checked WHERE is_valid""")
def import_applied(spark, sf):
    rows = checked_rows(spark, sf).filter("is_valid")
    out = importing.apply_import(
        event_log(spark, sf), rows, found_duplicates(spark, sf), "keep-import"
    )
    return out.select(*FLAT)


# -- table maintenance ---------------------------------------------------------------------


@query("s17_upsert_events", _with(LOG) + f"""
SELECT {FLAT_SQL.replace("value", "CASE WHEN o.n IS NULL THEN value ELSE o.n END", 1)} FROM log
LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS oid, arg_max(o_totalprice, o_orderkey) AS n FROM orders GROUP BY 1) o ON oid = id
UNION ALL SELECT oid, -1, 0, 'meal', {r6('n')} FROM (SELECT CAST(o_custkey AS VARCHAR) AS oid, arg_max(o_totalprice, o_orderkey) AS n FROM orders GROUP BY 1)
WHERE oid NOT IN (SELECT id FROM log)""")
def upsert_events(spark, sf):
    """Orders overwrite the value of the event their customer number names; several orders
    of one customer are settled by the newest."""
    log = event_log(spark, sf).select(*FLAT)
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("id"), "o_orderkey", F.col("o_totalprice").alias("n")
    )
    changes = orders.join(log.drop("value"), "id", "left").select(
        "id",
        F.coalesce("subject_id", F.lit(-1)).alias("subject_id"),
        F.coalesce("ts", F.timestamp_millis(F.lit(0))).alias("ts"),
        F.coalesce("event_type", F.lit("meal")).alias("event_type"),
        F.col("n").alias("value"),
        "o_orderkey",
    )
    return tables.upsert(log, changes, ["id"], "o_orderkey")


@query("s17_save_results", f"""
SELECT l_orderkey AS test_entry_id, l_returnflag AS provider, {r6('arg_max(l_quantity, (l_linenumber, l_partkey, l_quantity))')} AS score
FROM lineitem GROUP BY ALL""")
def save_results(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("test_entry_id"), F.col("l_returnflag").alias("provider"),
        F.col("l_quantity").alias("score"),
        F.struct("l_linenumber", "l_partkey", "l_quantity").alias("seq"),
    )
    return tables.save_results(lines.limit(0).drop("seq"), lines, "seq")


@query("s18_append_keys", _with(LOG) + """
SELECT subject_id, CAST(2*(count(*) + count_if(event_type = 'insulin')) AS BIGINT) AS n,
  CAST(count(*) + count_if(event_type = 'insulin') AS BIGINT) AS n_keys FROM log GROUP BY subject_id""")
def append_keys(spark, sf):
    """A log whose doses were taken twice at once, loaded twice: every event keeps one id."""
    log = event_log(spark, sf)
    log = log.unionByName(log.filter(F.col("event_type") == "insulin"))
    rows = tables.stamped(log, "2024-02-01").unionByName(tables.stamped(log, "2024-02-02"))
    keys = rows.groupBy("subject_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return keys.groupBy("subject_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_keys"))


@query("s19_patch_and_delete", _with(LOG, SPAN) + f"""
SELECT id, subject_id, ms AS ts, {r6('CASE WHEN event_type = $$meal$$ THEN value + 1 ELSE value END')} AS value,
  CASE WHEN event_type = 'meal' THEN hi ELSE ms END AS updated_at
FROM log, span WHERE event_type <> 'exercise'""")
def patch_and_delete(spark, sf):
    """Meals get one gram more, exercises are deleted."""
    _, end = log_span(spark, sf)
    log = event_log(spark, sf)
    changes = log.filter(F.col("event_type") == "meal").select(
        "id", (F.col("value") + 1).alias("value")
    )
    gone = log.filter(F.col("event_type") == "exercise").select("id")
    left = tables.delete(tables.patch(log, changes, "id", end), gone, "id")
    return left.select("id", "subject_id", "ts", "value", "updated_at")


@query("s19_missing_keys", """
SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events)""")
def missing_keys(spark, sf):
    changes = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return tables.missing_keys(event_log(spark, sf), changes, "id")


# -- JSON, CSV and payloads ------------------------------------------------------------------


def _batches(log):
    """A stored log and two batches of changes to it, see `merged_batches`."""
    kind = F.col("event_id") % 6
    stored = log.withColumn("updated_at", F.when(kind != 3, F.col("updated_at")))
    day = F.expr("INTERVAL 1 DAY")
    stamp = F.when(kind == 1, F.col("updated_at") - day).otherwise(F.col("updated_at") + day)
    change = F.when(kind == 0, 1).when(kind == 1, 100).when(kind == 3, 7).when(kind == 4, 20)
    changed = {
        "id": F.when(kind == 5, F.concat("id", F.lit("-new"))).otherwise(F.col("id")),
        "ts": F.when(kind.isin(2, 4), F.col("ts") + day).otherwise(F.col("ts")),
        "value": F.col("value") + F.coalesce(change, F.lit(0)),
        "updated_at": stamp,
    }
    first = stored.select(*(changed.get(c, F.col(c)).alias(c) for c in stored.columns))
    stale = first.filter(kind == 5).withColumns({"value": F.col("value") + 1, "updated_at": F.lit(None).cast("timestamp")})
    return stored, first, stale


@query("st1_merged_batches", _with(LOG) + f"""
SELECT id, ms + CASE WHEN event_id % 6 IN (2, 4) THEN 86400000 ELSE 0 END AS ts,
  {r6('value + CASE event_id % 6 WHEN 0 THEN 1 WHEN 3 THEN 7 WHEN 4 THEN 20 ELSE 0 END')} AS value FROM log
UNION ALL SELECT id || '-new', ms, {r6('value')} FROM log WHERE event_id % 6 = 5""")
def merged_batches(spark, sf):
    """Two batches merged into the log by id.

    By event number modulo 6 the first brings a newer value (0), an older one (1), a move to
    the next day (2), a value without a stamp, whose stored row has none either (3), a move
    and a newer value at once (4) and a new event (5). The second repeats the first, after
    an older state of the new events that must not win.
    """
    stored, first, stale = _batches(event_log(spark, sf, keep=("event_id",)))
    columns = ["id", "ts", "value", "updated_at"]
    merged = tables.upsert(stored.select(*columns), first.select(*columns), ["id"], "updated_at")
    again = first.unionByName(stale).select(*columns)
    return tables.upsert(merged, again, ["id"], "updated_at").drop("updated_at")


@query("st5_compacted_table", _with(LOG) + f"""
, r AS (
SELECT id, ms + CASE WHEN event_id % 6 IN (2, 4) THEN 86400000 ELSE 0 END AS ts,
  {r6('value + CASE event_id % 6 WHEN 0 THEN 1 WHEN 3 THEN 7 WHEN 4 THEN 20 ELSE 0 END')} AS value FROM log
UNION ALL SELECT id || '-new', ms, {r6('value')} FROM log WHERE event_id % 6 = 5)
SELECT *, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS event_date FROM r""")
def compacted_table(spark, sf):
    """The table in versions after a load, a merge by key index and a compaction of every day."""
    stored, first, _ = _batches(event_log(spark, sf, keep=("event_id",)))
    root = shared_folder(spark)
    loaded = VersionedTable(spark, f"{root}/events", stored.drop("event_id").schema)
    index = KeyIndex(spark, f"{root}/ids")
    dated = stored.withColumn("event_date", F.to_date("ts"))
    index.rebuild(dated)
    hours = dated.withColumn("_hour", F.hour("ts")).hint("rebalance", F.col("event_date"), F.col("_hour"))
    loaded.commit(Version(), {}, loaded.stage(hours))
    merged = merge_version(first, loaded, index)
    versions.compact_days(loaded, sorted(merged.days))
    return loaded.read().select("id", "ts", "value", "event_date")


@query("s13_backup_restore", _with(LOG) + f"""
, d AS (SELECT *, event_id // 3 AS doc FROM log)
SELECT doc, id AS source_id, subject_id, ms AS ts, event_type, {r6('value')} AS value, descr AS description, {r6('aunits')} AS alcohol_units,
  NULL::VARCHAR AS error FROM d WHERE doc % 10 < 8
UNION ALL SELECT DISTINCT doc, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::DOUBLE, NULL::VARCHAR, NULL::DOUBLE,
  CASE doc % 10 WHEN 8 THEN 'NOT_JSON' ELSE 'NO_EVENTS' END FROM d WHERE doc % 10 >= 8""")
def backup_restore(spark, sf):
    """Three events in a document; one document in ten is cut off, one holds no events."""
    log = event_log(spark, sf)
    exported = tables.export_documents(log)
    named = exported.select(F.struct(*exported.columns).alias("e"), F.expr("CAST(id AS BIGINT) div 3").alias("doc"))
    grouped = named.groupBy("doc").agg(F.collect_list("e").alias("events"))
    body = F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit("backup").alias("type"), "events"))
    docs = grouped.select(
        "doc",
        F.when(F.col("doc") % 10 == 8, F.substring(body, 1, 40))
        .when(F.col("doc") % 10 == 9, F.concat(F.lit('{"version":"1.0","doc":'), "doc", F.lit("}")))
        .otherwise(body)
        .alias("body"),
    )
    restored = tables.restore_documents(docs, "body", run="first", carry=["doc"])
    return restored.select(
        "doc", "source_id", "subject_id", "ts", "event_type", "value", "meta.description",
        "meta.alcohol_units", "error",
    )


@query("s14_document_load", _with(LOG) + f"SELECT {FLAT_SQL} FROM log")
def document_load(spark, sf):
    """Exported lines loaded over the same log by id change nothing."""
    log = event_log(spark, sf).select(*FLAT)
    lines = tables.export_documents(event_log(spark, sf))
    loaded = tables.restore_lines(lines.select(F.to_json(F.struct(*lines.columns)).alias("value")))
    return tables.upsert(log, loaded.select(*FLAT), ["id"], "ts")


@query("s15_export_manifest", """
SELECT '1.0' AS version, 'backup' AS type, '2024-02-01T10:00:00.000Z' AS "createdAt", CAST(count(*) AS BIGINT) AS count FROM events""")
def export_manifest(spark, sf):
    return tables.export_manifest(event_log(spark, sf), "backup", "2024-02-01 10:00:00")


_ISO = "strftime(make_timestamp(ms*1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') || 'Z'"


@query("s16_csv_export", _with(LOG) + f"""
SELECT id, {_ISO} AS timestamp, event_type AS "eventType", {_NUM.format('value')} AS value, coalesce(unit, '') AS unit,
  coalesce(source, '') AS source, '' AS device, CASE prick WHEN true THEN 'true' WHEN false THEN 'false' ELSE '' END AS "isFingerPrick",
  coalesce(itype, '') AS "insulinType", CASE WHEN coalesce(carbs, 0) = 0 THEN '' ELSE {_NUM.format('carbs')} END AS carbs,
  '' AS protein, '' AS fat, '' AS calories, coalesce(descr, '') AS description, {_ISO} AS "createdAt", {_ISO} AS "updatedAt" FROM log""")
def csv_export(spark, sf):
    return tables.export_columns(event_log(spark, sf))


def libre_docs(spark, sf):
    """One Libre payload per line item: three points, a current value, a sensor."""
    ship = F.col("l_shipdate")

    def point(minutes, value):
        at = F.date_format(ship + F.expr(f"INTERVAL {minutes} MINUTES"), "yyyy-MM-dd'T'HH:mm:ss")
        return F.struct(value.alias("Value"), at.alias("Timestamp"))

    q = F.col("l_quantity")
    current = F.struct(
        (q * 8).alias("Value"),
        F.date_format(ship, "yyyy-MM-dd'T'HH:mm:ss").alias("Timestamp"),
        F.pmod(F.col("l_linenumber"), F.lit(9)).alias("TrendArrow"),
        (q > 40).alias("isHigh"), (q < 5).alias("isLow"),
    )
    data = F.struct(
        F.array(point(10, q * 4), point(0, q * 5), point(5, q * 6)).alias("graphData"),
        current.alias("glucoseMeasurement"),
        F.struct(F.unix_timestamp(ship.cast("timestamp")).alias("a")).alias("sensor"),
    )
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.to_json(F.struct(data.alias("data"))).alias("body")
    )


@query("s20_libre_payload", f"""
SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) // 1000 + m*60000 AS ts, {r6('floor((l_quantity*f/18.0182)*10+0.5)/10')} AS value
FROM lineitem, (SELECT unnest([0, 5]) AS m, unnest([5, 6]) AS f)""")
def libre_payload(spark, sf):
    """The last two points as sent, whatever their times."""
    return payloads.libre_readings(libre_docs(spark, sf), "body", max_count=2).drop("unit", "source")


_TREND = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(values.TRENDS, start=1))


@query("s20_libre_current", f"""
SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) // 1000 AS ts, {r6('floor((l_quantity*8/18.0182)*10+0.5)/10')} AS value,
  CASE l_linenumber % 9 {_TREND} ELSE 'unknown' END AS trend, CAST(l_quantity > 40 AS BIGINT) AS is_high_alarm,
  CAST(l_quantity < 5 AS BIGINT) AS is_low_alarm FROM lineitem""")
def libre_current(spark, sf):
    return payloads.libre_current(libre_docs(spark, sf), "body")


@query("p17_sensor_expiry", """
SELECT l_orderkey, l_linenumber, epoch_us(l_shipdate) // 1000 + 14*86400000::BIGINT AS sensor_expiry FROM lineitem""")
def sensor_expiry(spark, sf):
    return payloads.sensor_expiry(libre_docs(spark, sf), "body")


@query("s20_dexcom_payload", _with(LOG, SPAN) + f"""
SELECT id, ms - m*60000 AS ts, {r6('floor((value*10*f/18.0182)*10+0.5)/10')} AS value,
  CASE k % 9 {_TREND} ELSE 'unknown' END AS trend, CAST(row_number() OVER (PARTITION BY id ORDER BY m) = 1 AS BIGINT) AS is_current
FROM log, span, (SELECT unnest([0, 5, 10]) AS m, unnest([2, 1, 3]) AS f)
WHERE event_type = 'bsl' AND ms - m*60000 >= lo + 86400000""")
def dexcom_payload(spark, sf):
    """Every reading as a payload of three entries; those before the second day drop out."""
    start, _ = log_span(spark, sf)
    rows = event_log(spark, sf, ["bsl"], keep=("k",))

    def entry(minutes, factor):
        ms = F.unix_millis("ts") - minutes * 60_000
        return F.struct(
            F.concat(F.lit("/Date("), ms, F.lit(")/")).alias("WT"),
            (F.col("value") * 10 * factor).alias("Value"),
            (F.col("k") % 9).cast("int").alias("Trend"),
        )

    docs = rows.select("id", F.to_json(F.array(entry(0, 2), entry(5, 1), entry(10, 3))).alias("body"))
    return payloads.dexcom_readings(
        docs, "body", start, start=start + timedelta(days=1)
    ).drop("unit", "source")


def reply_docs(spark, sf):
    """Model replies: fenced, bare or broken JSON around each customer balance."""
    n, bal = F.col("c_custkey"), F.col("c_acctbal")
    reading = F.concat(
        F.lit('{"readings":[{"value":'), F.floor(bal / 100).cast("string"), F.lit(',"confidence":'),
        (n % 14 / 10.0).cast("string"), F.lit(',"timestamp":"2024-01-05T00:00:00Z"},{"value":"'),
        (n % 40).cast("string"), F.lit('.5abc","unit":"mmol/L"},{"value":'), (n % 700).cast("string"),
        F.lit(',"unit":"MG/DL","timestamp":"soon"}],"source":"meter"}'),
    )
    text = (
        F.when(n % 5 == 0, F.concat(F.lit("Here:\n```json\n"), reading, F.lit("\n```\nDone.")))
        .when(n % 5 == 1, F.concat(F.lit("Result "), reading, F.lit(" end")))
        .when(n % 5 == 2, F.lit('{"source":"meter"}'))
        .when(n % 5 == 3, F.lit("{not json"))
        .otherwise(reading)
    )
    return table(spark, sf, "customer").select("c_custkey", text.alias("text"))


@query("s23_reply_parsing", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN 'unknown' ELSE 'meter' END AS image_source,
  CASE c_custkey % 5 WHEN 2 THEN 'NO_READINGS' WHEN 3 THEN 'NOT_JSON' END AS error,
  CASE WHEN c_custkey % 5 IN (2, 3) THEN 0 ELSE 3 END::BIGINT AS n_readings FROM customer""")
def reply_parsing(spark, sf):
    replies = payloads.reading_replies(reply_docs(spark, sf), "text")
    return replies.select(
        "c_custkey", "image_source", "error",
        F.coalesce(F.size("readings"), F.lit(0)).alias("n_readings"),
    )


@query("p5_reading_normalisation", _with(SPAN) + f"""
SELECT c_custkey, CAST(pos AS BIGINT) AS pos, {r6('v')} AS value, unit, ts, {r6('conf')} AS confidence FROM (
  SELECT c_custkey, 0 AS pos, floor(c_acctbal/100) AS v, CASE WHEN floor(c_acctbal/100) > 35 THEN 'mg/dL' ELSE 'mmol/L' END AS unit,
    epoch_ms(TIMESTAMP '2024-01-05') AS ts, least(1.0::DOUBLE, c_custkey % 14 / 10.0::DOUBLE) AS conf FROM customer
  UNION ALL SELECT c_custkey, 1, c_custkey % 40 + 0.5::DOUBLE, 'mmol/L', lo, 0.8 FROM customer, span
  UNION ALL SELECT c_custkey, 2, (c_custkey % 700)::DOUBLE, 'mg/dL', lo, 0.8 FROM customer, span)
WHERE c_custkey % 5 NOT IN (2, 3) AND v > 0 AND CASE unit WHEN 'mg/dL' THEN v BETWEEN 20 AND 600 ELSE v BETWEEN 1 AND 35 END""")
def reading_normalisation(spark, sf):
    start, _ = log_span(spark, sf)
    replies = payloads.reading_replies(reply_docs(spark, sf), "text")
    return payloads.normalised_readings(replies, start).select(
        "c_custkey", "pos", "value", "unit", "ts", "confidence"
    )


def food_docs(spark, sf):
    """Two items per part; one reply in four has no totals, one in five is no JSON."""
    n, price = F.col("p_partkey"), F.col("p_retailprice")

    def item(name, share, sure):
        macros_ = F.struct((price * share).alias("calories"), (F.col("p_size") * share).alias("carbs"))
        return F.struct(name.alias("name"), (n % 7).cast("double").alias("quantity"), F.lit("g").alias("unit"), macros_.alias("macros"), sure.alias("confidence"))

    items = F.array(item(F.col("p_name"), 0.25, n % 10 / 10.0), item(F.col("p_brand"), 0.5, F.lit(0.5)))
    total = F.when(n % 4 != 0, F.struct(price.alias("calories"), F.col("p_size").cast("double").alias("carbs")))
    body = F.to_json(F.struct(items.alias("items"), total.alias("totalMacros"), F.lit(0.9).alias("confidence")))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    text = F.when(n % 5 == 0, F.lit("Sorry, no food.")).when(n % 2 == 0, fenced).otherwise(body)
    return table(spark, sf, "part").select("p_partkey", text.alias("text"))


@query("s23_food_items", f"""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'NO_ITEMS' END AS error, CASE WHEN p_partkey % 5 <> 0 THEN i::BIGINT END AS pos,
  CASE WHEN p_partkey % 5 <> 0 THEN CASE i WHEN 0 THEN p_name ELSE p_brand END END AS name,
  {r6('CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice*(i + 1)/4 END::DOUBLE')} AS calories,
  {r6('CASE WHEN p_partkey % 5 <> 0 THEN p_size*(i + 1)/4.0 END::DOUBLE')} AS carbs,
  {r6('CASE WHEN p_partkey % 5 <> 0 THEN CASE i WHEN 0 THEN p_partkey % 10 / 10.0 ELSE 0.5 END END::DOUBLE')} AS confidence,
  {r6('CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 4 <> 0 THEN p_retailprice ELSE p_retailprice*0.75 END::DOUBLE')} AS total_calories,
  {r6('CASE WHEN p_partkey % 5 <> 0 THEN 0.0 END::DOUBLE')} AS total_fat
FROM part, (SELECT unnest([0, 1]) AS i) WHERE p_partkey % 5 <> 0 OR i = 0""")
def food_items(spark, sf):
    rows = payloads.food_replies(food_docs(spark, sf), "text")
    return rows.select(
        "p_partkey", "error", "pos", "name", "calories", "carbs", "confidence", "total_calories", "total_fat"
    )


@query("s23_label_replies", f"""
SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS serving_size,
  {r6('CASE WHEN p_partkey % 3 <> 0 THEN p_size END::DOUBLE')} AS servings, {r6('CASE WHEN p_partkey % 3 = 1 THEN p_retailprice END::DOUBLE')} AS calories,
  {r6('NULL::DOUBLE')} AS sodium, CASE WHEN p_partkey % 3 <> 1 THEN 'NO_MACROS' END AS error FROM part""")
def label_replies(spark, sf):
    n = F.col("p_partkey") % 3
    macros_ = F.when(n == 1, F.struct(F.col("p_retailprice").alias("calories")))
    body = F.to_json(F.struct(F.col("p_type").alias("servingSize"), F.col("p_size").alias("servingsPerContainer"), macros_.alias("macros")))
    docs = table(spark, sf, "part").select("p_partkey", F.when(n == 0, F.lit("unreadable")).otherwise(body).alias("text"))
    return payloads.label_replies(docs, "text").select("p_partkey", "serving_size", "servings", "calories", "sodium", "error")


@query("s21_food_composition", f"""
SELECT CAST(p_partkey AS VARCHAR) AS source_reference, p_name || ' rice' AS description,
  {groups_sql("(p_name || ' rice')", values.CATEGORY_KEYWORDS, 'other')} AS category,
  {r6('p_retailprice')} AS calories, {r6('p_size')} AS carbs, {r6('0.0')} AS protein, {r6('p_size/4.0')} AS fat FROM part""")
def food_composition(spark, sf):
    """The first energy entry counts, protein is missing."""

    def entry(name, amount):
        return F.struct(F.lit(name).alias("nutrientName"), amount.cast("double").alias("amount"))

    foods = table(spark, sf, "part").select(
        F.col("p_partkey").alias("fdc_id"),
        F.concat("p_name", F.lit(" rice")).alias("description"),
        F.array(
            entry("Energy (kcal)", F.col("p_retailprice")),
            entry("Energy (kJ)", F.col("p_retailprice") * 4),
            entry("Carbohydrate, by difference", F.col("p_size")),
            entry("Total lipid (fat)", F.col("p_size") / 4.0),
        ).alias("nutrients"),
    )
    return payloads.composition_entries(foods).drop("source")
