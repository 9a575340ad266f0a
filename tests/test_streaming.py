"""Streams give what the same functions give in batch."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import BASE, at, event, utc_ms
from glycoflow.operators.grid import Grid
from glycoflow.operators.log import day_summary as log_day_summary
from glycoflow.operators.log import recent_per_subject
from glycoflow.sources.tables import export_documents, restore_lines
from glycoflow.streaming import ingest, late, windows


def sample(n=400):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        kind = rnd.choice(["bsl", "bsl", "insulin", "meal"])
        meta = {"insulin": {"type": rnd.choice(["bolus", "basal"])},
                "meal": {"carbs": 20.0, "alcohol_units": rnd.choice([None, 1.0])}}.get(kind, {"unit": "mmol/L"})
        rows.append(event(f"e{i:04}", at(rnd.randint(0, 2000), i), kind, rnd.randint(2, 15), subject=rnd.choice([1, 1, 1, 2]), **meta))
    return sorted(rows, key=lambda r: r[2])


def land(make_log, rows, folder, parts):
    size = -(-len(rows) // parts)
    for i in range(parts):
        chunk = rows[i * size:(i + 1) * size]
        docs = export_documents(make_log(chunk)).toJSON().collect()
        (folder / f"{i:03}.json").write_text("\n".join(docs))


def drain(stream, name, mode):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.fixture()
def landed(spark, make_log, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    rows = sample()
    land(make_log, rows, folder, 4)
    return folder, rows


def test_glucose_windows_and_sessions(spark, make_log, landed):
    folder, rows = landed
    batch = make_log(rows)
    drain(windows.glucose_windows(ingest.event_files(spark, str(folder), 1)), "w5", "append")
    got = {tuple(r) for r in spark.table("w5").select("subject_id", "window_start", "n").collect()}
    want = {tuple(r) for r in windows.glucose_windows(batch).select("subject_id", "window_start", "n").collect()}
    assert got and got <= want  # windows still open at the end are not out yet
    newest = max(r[2] for r in rows if r[3] == "bsl")
    assert all(utc_ms(w[1]) >= utc_ms(newest) - 16 * 60000 for w in want - got)

    drain(windows.session_windows(ingest.event_files(spark, str(folder), 1), "30 minutes"), "sess", "append")
    closed = {tuple(r) for r in spark.table("sess").collect()}
    assert closed and closed <= {tuple(r) for r in windows.session_windows(batch, "30 minutes").collect()}


def test_decay_kept_across_batches(spark, make_log, landed):
    folder, rows = landed
    grid = Grid(BASE - timedelta(days=1), BASE + timedelta(days=4), 15)
    drain(windows.decay_totals(ingest.event_files(spark, str(folder), 1), grid), "decay", "append")
    got = {(r.subject_id, utc_ms(r.at_ts)): (r.iob, r.cob, r.sensitivity_modifier) for r in spark.table("decay").collect()}
    want = {(r.subject_id, utc_ms(r.at_ts)): (r.iob, r.cob, r.sensitivity_modifier)
            for r in windows.decay_totals(make_log(rows), grid).collect()}
    assert got and set(got) <= set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)


def test_ingest_is_incremental_and_repeatable(spark, make_log, landed, tmp_path):
    folder, rows = landed
    table, check, side = (str(tmp_path / n) for n in ("table", "check", "late"))

    def load():
        stream = ingest.event_files(spark, str(folder), 2)
        ingest.start_ingest(stream, table, check, side, ingest_ts=F.col("updated_at")).awaitTermination()
        spark.catalog.refreshByPath(table)
        return spark.read.parquet(table)

    assert load().count() == len(rows)
    changed = event(rows[0][0], rows[0][2], "bsl", 99.0)
    late_row = event("late", rows[5][2], "bsl", 5.0)
    late_row = (*late_row[:7], at(9000), False)
    changed = (*changed[:7], at(9000), False)
    land(make_log, [changed, late_row], _sub(folder), 1)
    (folder / "900.json").write_text((_sub(folder) / "000.json").read_text())
    after = load()
    assert after.count() == len(rows) + 1
    assert after.filter(F.col("id") == rows[0][0]).first().value == 99.0
    assert {r.id for r in spark.read.parquet(side).collect()} == {"late", rows[0][0]}
    ingest.merge_batch(spark, make_log([late_row]), table)
    spark.catalog.refreshByPath(table)
    assert spark.read.parquet(table).count() == len(rows) + 1


def test_merge_keeps_moves_and_sets_aside(spark, make_log, tmp_path):
    path = str(tmp_path / "t")

    def stored():
        spark.catalog.refreshByPath(path)
        return {r.id: (r.ts.day, r.value, str(r.event_date)[-2:]) for r in spark.read.parquet(path).collect()}

    def row(id, minutes, value, stamp):
        r = event(id, at(minutes), "bsl", value)
        return (*r[:7], None if stamp is None else at(stamp), False)

    ingest.merge_batch(spark, make_log([row("a", 0, 1, 10), row("b", 5, 2, 10), row("c", 1440 * 3, 3, None)]), path, "one")
    assert stored() == {"a": (1, 1.0, "01"), "b": (1, 2.0, "01"), "c": (4, 3.0, "04")}
    # b is older than what is stored, a and c move; c leaves its day empty; a missing stamp stays below all others.
    moved = make_log([row("a", 1440 * 4, 4, 20), row("b", 5, 9, 5), row("c", 1440 * 4, 5, 1)])
    for _ in range(2):
        ingest.merge_batch(spark, moved, path, "two")
        assert stored() == {"a": (5, 4.0, "05"), "b": (1, 2.0, "01"), "c": (5, 5.0, "05")}
    ingest.merge_batch(spark, make_log([row("a", 0, 8, None)]), path, "three")
    assert stored()["a"] == (5, 4.0, "05")
    broken = spark.read.text(str(_lines(tmp_path, ["{not json", '{"id":"n1","eventType":"bsl","timestamp":"never"}'])))
    for load in ("four", "five", "five"):
        ingest.merge_batch(spark, restore_lines(broken, keep_raw=True), path, load)
    aside = spark.read.parquet(path + "-rejected")
    assert sorted((r.load, r.raw[:4]) for r in aside.collect()) == [(x, y) for x in ("five", "four") for y in ('{"id', "{not")]
    assert len(stored()) == 3


def _lines(folder, lines):
    path = folder / "lines.json"
    path.write_text("\n".join(lines))
    return path


def test_delivered_again_counts_once(spark, make_log):
    rows = sample(60)
    once, twice = (windows.glucose_windows(make_log(r)) for r in (rows, rows + rows))
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()}


def _sub(folder):
    sub = folder.parent / "more"
    sub.mkdir(exist_ok=True)
    return sub


def test_live_recent_view(spark, make_log, landed, tmp_path):
    folder, rows = landed
    view, check = str(tmp_path / "view"), str(tmp_path / "check")
    ingest.start_recent_view(ingest.event_files(spark, str(folder), 1), view, check, 7).awaitTermination()
    versions = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "view").iterdir() if "=" in p.name)
    latest = spark.read.parquet(f"{view}/version={versions[-1]}")
    want = {r.id for r in recent_per_subject(make_log(rows), 7).collect()}
    assert {r.id for r in latest.collect()} == want and len(want) == 14


def test_day_totals_in_complete_mode(spark, make_log, landed):
    folder, rows = landed
    drain(windows.day_totals(ingest.event_files(spark, str(folder), 1)), "days", "complete")
    pick = ["subject_id", "day", "event_count", "total_carbs"]
    assert {tuple(r) for r in spark.table("days").select(*pick).collect()} == {
        tuple(r) for r in windows.day_totals(make_log(rows)).select(*pick).collect()
    }


def test_day_totals_leave_the_state(spark, make_log, tmp_path):
    """Forty days in ten files, the fifth delivered twice: few days are ever open, and stored rows are right."""
    folder, path = tmp_path / "in", str(tmp_path / "view")
    folder.mkdir()
    rows = [event(f"x{i:04}", at(i * 60), "insulin", 1.0 + i % 3, subject=1 + i % 2) for i in range(960)]
    land(make_log, rows, folder, 10)
    (folder / "004b.json").write_text((folder / "004.json").read_text())
    days = windows.day_totals(ingest.event_files(spark, str(folder), 1), "Australia/Sydney")
    query = (
        days.writeStream.outputMode("update").foreachBatch(lambda df, n: windows.upsert_days(df, path, n))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    totals = [max(o["numRowsTotal"] for o in p["stateOperators"] if o["operatorName"] == "stateStoreSave") for p in query.recentProgress if p["stateOperators"]]
    assert len(totals) >= 10 and max(totals[3:]) <= 2 * 7
    got = {(r.subject_id, r.day): (r.event_count, r.total_insulin) for r in windows.stored_days(spark, path).collect()}
    want = {(r.subject_id, r.day): (r.event_count, r.total_insulin) for r in log_day_summary(make_log(rows), "Australia/Sydney").collect()}
    assert got == want


def test_delivered_again_counts_once_everywhere(make_log):
    rows = sample(60)
    grid = Grid(BASE, BASE + timedelta(days=3), 60)
    for view in (windows.session_windows, windows.day_totals, lambda log: windows.decay_totals(log, grid)):
        one, two = (sorted(map(str, view(make_log(r)).collect())) for r in (rows, rows + rows))
        assert one == two


def test_late_rows_and_what_they_make_stale(spark):
    df = spark.createDataFrame(
        [(1, at(0), at(10)), (1, at(5), at(15, 1)), (1, at(50), at(100))], "subject_id long, ts timestamp, ingest_ts timestamp"
    )
    flagged = late.flag_late(df, 10)
    assert [r.is_late for r in flagged.orderBy("ts").collect()] == [False, True, True]
    stale = late.stale_ranges(flagged.filter("is_late")).first()
    assert (utc_ms(stale.stale_from), utc_ms(stale.stale_until)) == (utc_ms(at(5)), utc_ms(at(50 + 1440)))
