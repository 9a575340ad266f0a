"""The open-ended stream of decay against the batch sums of the same events."""

import random

import pytest

from conftest import at, event, utc_ms
from glycoflow.operators.grid import Grid
from glycoflow.sources.tables import export_documents
from glycoflow.streaming import decay, ingest, windows

NAMES = ("iob", "cob", "alcohol_in_system", "sensitivity_modifier")


def land(make_log, folder, name, rows):
    (folder / name).write_text("\n".join(export_documents(make_log(rows)).toJSON().collect()))


def run(spark, folder, check, name, delay):
    out = []
    stream = decay.open_decay(ingest.event_files(spark, str(folder), 1), 15, delay)
    query = (
        stream.writeStream.outputMode("update").foreachBatch(lambda df, n: out.append((n, df.collect())))
        .option("checkpointLocation", check).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return [r for _, rows in sorted(out, key=lambda x: x[0]) for r in rows], query


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    decay.configured(spark)
    yield
    spark.conf.set(key, before)


def sample(rng, first, last, tag):
    rows = []
    for i in range(12):
        kind = rng.choice(["insulin", "insulin", "meal", "bsl"])
        meta = {"insulin": {"type": rng.choice(["bolus", "basal"])}, "meal": {"carbs": 20.0, "alcohol_units": rng.choice([None, 1.5])}}.get(kind, {})
        rows.append(event(f"{tag}{i}", at(rng.randint(first, last)), kind, rng.randint(1, 9), subject=rng.choice([1, 2]), **meta))
    return rows


def test_stream_without_end_late_doses_and_files_delivered_again(spark, make_log, tmp_path, rocks):
    rng = random.Random(8)
    folder = tmp_path / "in"
    folder.mkdir()
    first, second = sample(rng, 0, 600, "a"), sample(rng, 600, 1200, "b")
    late = [event("late", at(900), "insulin", 7.0, subject=1, type="bolus"), event("late2", at(910), "meal", 0.0, subject=2, carbs=40.0)]
    land(make_log, folder, "0.json", first)
    land(make_log, folder, "1.json", second + [event("c1", at(1250), "bsl", 5.0), event("c2", at(1250), "bsl", 5.0, subject=2)])
    land(make_log, folder, "2.json", late)
    (folder / "3.json").write_text((folder / "1.json").read_text())
    # Far past all effects: the watermark lets timers tell how they wear off.
    land(make_log, folder, "4.json", [event("end", at(1250 + 4 * 1440), "bsl", 5.0, subject=3)])
    land(make_log, folder, "5.json", [event("end2", at(1250 + 4 * 1440 + 1), "bsl", 5.0, subject=3)])
    (folder / "6.json").write_text((folder / "0.json").read_text())
    rows, query = run(spark, folder, str(tmp_path / "check"), "open", 720)
    assert any(r.revised for r in rows)
    got = {(r.subject_id, r.at_ms): tuple(r[n] for n in NAMES) for r in rows}
    grid = Grid(at(-60), at(1250 + 2 * 1440), 15)
    batch = windows.decay_totals(make_log(first + second + late), grid)
    want = {(r.subject_id, utc_ms(r.at_ts)): tuple(r[n] for n in NAMES) for r in batch.collect()}
    assert want.keys() <= got.keys()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-9)
    # Beyond the effects each subject is told once more, that nothing acts.
    assert all(got[k] == pytest.approx((0, 0, 0, 1)) for k in got.keys() - want.keys())
    # Neither file that came again told anything: instants come twice only where a late event changed them.
    seen = [(r.subject_id, r.at_ms) for r in rows if not r.revised]
    assert len(seen) == len(set(seen))
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 2


def test_effects_of_late_events_beyond_the_delay_are_dropped(spark, make_log, tmp_path, rocks):
    folder = tmp_path / "in"
    folder.mkdir()
    land(make_log, folder, "0.json", [event("a", at(0), "insulin", 2.0, type="bolus")])
    land(make_log, folder, "1.json", [event("b", at(200), "bsl", 5.0)])
    land(make_log, folder, "2.json", [event("c", at(210), "bsl", 5.0)])
    land(make_log, folder, "3.json", [event("old", at(10), "insulin", 50.0, type="bolus")])
    rows, _ = run(spark, folder, str(tmp_path / "check"), "drop", 30)
    assert max(r.iob for r in rows) <= 2.0 and not any(r.revised for r in rows)
