"""The table in versions: loads that stop half way, writers side by side, and what a batch reads."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import at, event
from glycoflow import schemas
from glycoflow.sources import versions
from glycoflow.sources.versions import Conflict, KeyIndex, VersionedTable
from glycoflow.streaming import ingest

DAY = 1440


@pytest.fixture()
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), schemas.EVENTS)


@pytest.fixture()
def index(spark, tmp_path):
    return KeyIndex(spark, str(tmp_path / "index"), 8)


def row(id, minutes, value, stamp=0):
    r = event(id, at(minutes), "bsl", value)
    return (*r[:7], None if stamp is None else at(stamp), False)


def stored(table, version=None):
    return {r.id: (str(r.event_date), r.value) for r in table.read(version).collect()}


def test_merge_moves_and_empties_days_and_keeps_versions(make_log, table, index):
    assert table.current().number == 0 and table.read().count() == 0
    one = ingest.merge_version(make_log([row("a", 0, 1, 10), row("b", 5, 2, 10), row("c", 3 * DAY, 3, None)]), table, index)
    assert stored(table) == {"a": ("2025-01-01", 1.0), "b": ("2025-01-01", 2.0), "c": ("2025-01-04", 3.0)}
    two = ingest.merge_version(make_log([row("a", 4 * DAY, 4, 20), row("b", 5, 9, 5), row("c", 4 * DAY, 5, 1)]), table, index)
    assert stored(table) == {"a": ("2025-01-05", 4.0), "b": ("2025-01-01", 2.0), "c": ("2025-01-05", 5.0)}
    assert sorted(two.days) == ["2025-01-01", "2025-01-05"]
    assert stored(table, one)["a"] == ("2025-01-01", 1.0)


def test_batch_reads_files_of_its_days_only(spark, make_log, table, index, monkeypatch):
    ingest.merge_version(make_log([row(f"e{d}-{i}", d * DAY + i, 1) for d in range(20) for i in range(5)]), table, index)
    read = []
    inner = VersionedTable.read

    def spied(self, version=None, days=None):
        out = inner(self, version, days)
        read.extend(out.inputFiles())
        return out

    monkeypatch.setattr(VersionedTable, "read", spied)
    # One event moves from day 7 to day 3, another is new on day 11.
    ingest.merge_version(make_log([row("e7-0", 3 * DAY, 2, 9), row("new", 11 * DAY, 2, 9)]), table, index)
    assert {f.split("event_date=")[1][:10] for f in read} == {"2025-01-04", "2025-01-08", "2025-01-12"}
    monkeypatch.undo()
    got = stored(table)
    assert len(got) == 101 and got["e7-0"] == ("2025-01-04", 2.0)
    asked = make_log([row("e7-0", 0, 1)]).withColumn("event_date", F.to_date("ts"))
    plan = index.known(asked)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert {r.event_date.isoformat() for r in index.known(asked).collect()} == {"2025-01-08", "2025-01-04"}


def test_load_that_stops_leaves_the_last_version(make_log, table, index, monkeypatch):
    ingest.merge_version(make_log([row("a", 0, 1), row("b", DAY, 1)]), table, index)
    before = stored(table)

    def lost(*_args, **_kwargs):
        raise RuntimeError("driver lost")

    for step in ("commit", "stage"):
        with monkeypatch.context() as m:
            m.setattr(VersionedTable, step, lost)
            with pytest.raises(RuntimeError, match="driver lost"):
                ingest.merge_version(make_log([row("a", 2 * DAY, 9, 9)]), table, index)
        assert stored(table) == before and table.current().number == 1
    ingest.merge_version(make_log([row("a", 2 * DAY, 9, 9)]), table, index)
    assert stored(table) == {"a": ("2025-01-03", 9.0), "b": before["b"]}


def test_batch_that_runs_again_changes_nothing(make_log, table, index):
    batch = make_log([row("a", 0, 1)])
    first = ingest.merge_version(batch, table, index, ("s", 0))
    assert ingest.merge_version(batch, table, index, ("s", 0)) == first
    assert ingest.merge_version(make_log([row("a", 0, 2, 5)]), table, index, ("s", 1)).loads == {"s": 1}
    assert ingest.merge_version(batch, table, index, ("s", 0)).number == 2


def test_two_writers_lose_no_rows(make_log, table, index, monkeypatch):
    ingest.merge_version(make_log([row("a", 0, 1), row("b", DAY, 1)]), table, index)
    inner, pending = VersionedTable.stage, [[row("c", 1, 3)], [row("d", DAY, 4)]]

    def raced(self, rows, day=None):
        out = inner(self, rows, day)
        if pending:
            # Another writer commits while this one has staged, first the same day, then another one.
            ingest.merge_version(make_log(pending.pop(0)), table, index)
        return out

    monkeypatch.setattr(VersionedTable, "stage", raced)
    ingest.merge_version(make_log([row("a", 2, 9, 9)]), table, index)
    assert stored(table) == {"a": ("2025-01-01", 9.0), "b": ("2025-01-02", 1.0), "c": ("2025-01-01", 3.0), "d": ("2025-01-02", 4.0)}
    base = table.version(1)
    with pytest.raises(Conflict):
        table.commit(base, {"2025-01-01": []})
    assert len(stored(table)) == 4


def test_version_appears_once(table):
    assert table._put(versions.Version(1, {"2025-01-01": ["x"]}))
    assert not table._put(versions.Version(1, {"2025-01-01": ["y"]}))
    assert table.current().days == {"2025-01-01": ["x"]}


def test_compaction_and_removal_of_unused_files(spark, make_log, table, index):
    for i in range(4):
        added = table.stage(make_log([row(f"{i}-{k}", k * 60, k) for k in range(6)]), F.to_date("ts"))
        table.commit(table.current(), {}, added)
    before = stored(table)
    assert len(before) == 24 and len(table.read().inputFiles()) >= 4
    old = table.current()
    versions.compact_days(table, ["2025-01-01", "2030-01-01"], rows_per_file=12)
    assert stored(table) == before and len(table.read().inputFiles()) == 2
    assert stored(table, old) == before
    table.remove_unused(keep=1)
    assert stored(table) == before
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        table.read(old).count()
    index.rebuild(table.read())
    assert index.known(table.read()).count() == 24


def test_stream_into_versions(spark, make_log, tmp_path, table, index):
    from test_streaming import land, sample

    folder = tmp_path / "in"
    folder.mkdir()
    rows = sample(120)
    land(make_log, rows, folder, 3)
    for _ in range(2):
        ingest.start_versioned_ingest(ingest.event_files(spark, str(folder), 1), table, index, str(tmp_path / "check"), "files").awaitTermination()
        assert set(stored(table)) == {r[0] for r in rows}
        assert table.current().loads == {"files": 2}
