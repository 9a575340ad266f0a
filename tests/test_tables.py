"""Stored tables, backups and exports on real files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from conftest import at, event
from glycoflow.operators import log as log_ops
from glycoflow.sources import payloads, tables
from glycoflow.streaming import compact


def mini(make_log):
    return make_log([
        event("a", at(0), "bsl", 5.5, unit="mmol/L", source="manual", is_finger_prick=False),
        event("b", at(60), "meal", 0.0, carbs=0.0, description='Rice, "sticky"', alcohol_units=1.5, alcohol_type="wine"),
        event("c", at(60 * 30), "insulin", 4.0, type="bolus"),
    ])


def test_backup_round_trip_on_files(spark, make_log, tmp_path):
    log = mini(make_log)
    tables.write_backup(log, str(tmp_path / "b"))
    back = tables.restore_lines(spark.read.text(str(tmp_path / "b" / "events")))
    pick = ["id", "ts", "event_type", "value", "meta.description", "meta.is_finger_prick"]
    assert sorted(map(tuple, back.select(*pick).collect()), key=str) == sorted(
        map(tuple, log.select(*pick).collect()), key=str
    )
    manifest = spark.read.json(str(tmp_path / "b" / "manifest")).first()
    assert (manifest["version"], manifest["type"], manifest["count"]) == ("1.0", "backup", 3)


def test_restored_documents_get_new_ids(spark, tmp_path):
    doc = {"version": "1.0", "events": [
        {"id": "x", "subjectId": 1, "timestamp": "2025-01-01T00:00:00.000Z", "eventType": "bsl", "value": 5},
        {"id": "y", "subjectId": 1, "timestamp": "never", "eventType": "bsl", "value": 5},
    ]}
    (tmp_path / "b.json").write_text(json.dumps(doc, indent=2))
    rows = tables.read_backup(spark, str(tmp_path)).collect()
    assert {r.source_id: r.failed for r in rows} == {"x": False, "y": True}
    assert not {r.id for r in rows} & {"x", "y"}


def test_exported_metadata_comes_back_whole(spark):
    meta = {"alcoholUnits": 2.5, "alcoholType": "wine", "isFingerPrick": True, "items": [{"name": "rice"}], "heartRateAvg": 90}
    doc = {"version": "1.0", "events": [{"id": "m", "timestamp": "2025-01-01T00:00:00Z", "eventType": "meal", "value": 3, "metadata": meta}]}
    docs = spark.createDataFrame([(json.dumps(doc), 7), ("{broken", 8), ('{"version":"1.0"}', 9), (None, 10)], "body string, owner long")
    rows = tables.restore_documents(docs, "body", run="r", subject=F.col("owner"), carry=["owner"]).collect()
    assert {r.owner: r.error for r in rows} == {7: None, 8: "NOT_JSON", 9: "NO_EVENTS", 10: "NOT_JSON"}
    one = next(r for r in rows if r.owner == 7)
    assert (one.subject_id, one.meta.alcohol_units, one.meta.alcohol_type, one.meta.is_finger_prick) == (7, 2.5, "wine", True)
    assert json.loads(one.metadata_json) == meta
    again = tables.restore_documents(docs, "body", run="r").collect()
    assert one.id in {r.id for r in again}
    assert one.id not in {r.id for r in tables.restore_documents(docs, "body").collect()}
    out = json.loads(tables.export_documents(tables.restore_documents(docs, "body").filter("error IS NULL").withColumn("subject_id", F.lit(1))).first().metadata)
    assert out == meta


def test_missing_stamps_lose_and_do_not_erase(spark):
    base = spark.createDataFrame([("a", 1.0, 5), ("b", 2.0, None), ("c", 3.0, 5)], "id string, v double, seq int")
    changes = spark.createDataFrame([("a", 9.0, None), ("b", 8.0, None), ("c", 7.0, 4), ("d", 6.0, None), ("d", 6.0, None)], "id string, v double, seq int")
    got = tables.upsert(base, changes, ["id"], "seq")
    assert sorted(map(tuple, got.collect())) == [("a", 1.0, 5), ("b", 8.0, None), ("c", 3.0, 5), ("d", 6.0, None)]


def test_doses_at_once_keep_their_own_ids(spark, make_log):
    rows = make_log([event("x", at(0), "insulin", 5.0, type="bolus"), event("y", at(0), "insulin", 5.0, type="basal"), event("z", at(0), "insulin", 5.0, type="basal")])
    assert tables.stamped(rows, at(0)).select("id").distinct().count() == 3


def test_csv_export_quotes_only_where_needed(spark, make_log, tmp_path):
    path = tables.write_csv(mini(make_log).coalesce(1), str(tmp_path / "out"), dt.date(2025, 2, 1))
    assert path.endswith("out-2025-02-01.csv")
    lines = [r.value for r in spark.read.text(path).collect()]
    stamp = "2025-01-01T01:00:00.000Z"
    assert f'b,{stamp},meal,0,,,,,,,,,,"Rice, ""sticky""",{stamp},{stamp}' in lines
    assert any(line.startswith("a,") and ",false," in line for line in lines)


def test_append_read_and_compact(spark, make_log, tmp_path):
    path = str(tmp_path / "events")
    for _ in range(3):
        tables.append(mini(make_log), path)
    day = dt.date(2025, 1, 1)
    before = {r.event_date: (r.n_files, r.n_rows) for r in compact.file_counts(tables.read_events(spark, path)).collect()}
    compact.compact_day(spark, path, day)
    spark.catalog.refreshByPath(path)
    after = {r.event_date: (r.n_files, r.n_rows) for r in compact.file_counts(tables.read_events(spark, path)).collect()}
    assert before[day][0] > 1 and after[day] == (1, 6)
    assert after[dt.date(2025, 1, 2)] == before[dt.date(2025, 1, 2)]
    plan = log_ops.between(tables.read_events(spark, path), at(0), at(10))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_upsert_patch_delete(spark):
    base = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, v double")
    changes = spark.createDataFrame([("b", 3.0, 1), ("b", 4.0, 2), ("c", 5.0, 1)], "id string, v double, seq int")
    got = tables.upsert(base, changes, ["id"], "seq")
    assert sorted(map(tuple, got.collect())) == [("a", 1.0), ("b", 4.0), ("c", 5.0)]
    patched = tables.patch(base, changes.filter("seq = 2").select("id", F.lit(None).cast("double").alias("v")), "id", at(0))
    assert sorted(map(tuple, patched.collect())) == [("a", 1.0), ("b", 2.0)]
    assert [r.id for r in tables.missing_keys(base, changes, "id").collect()] == ["c"]
    assert [r.id for r in tables.delete(base, changes, "id").collect()] == ["a"]


def test_result_key_switch(spark):
    base = spark.createDataFrame([(1, "x", 1.0)], "test_entry_id int, provider string, score double")
    change = spark.createDataFrame([(1, "y", 2.0, 1)], "test_entry_id int, provider string, score double, seq int")
    assert tables.save_results(base, change, "seq").count() == 2
    assert [r.provider for r in tables.save_results(base, change, "seq", strict_key=False).collect()] == ["y"]


def test_loading_twice_makes_the_same_keys(spark, make_log):
    rows = tables.stamped(mini(make_log), at(0))
    assert rows.union(rows).select("id").distinct().count() == 3


def test_replies_and_labels(spark):
    docs = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("{\"a\": 2}",), ("no",)], "t string")
    got = [r[0] for r in docs.select(payloads.parse_reply(F.col("t"), "a int")["a"]).collect()]
    assert got == [1, 2, None]
