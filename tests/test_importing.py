"""CSV files, validation and duplicates on the edge rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import at, event
from glycoflow.operators import importing
from glycoflow.sources import csvfiles

LIBRE = """
Device,Serial Number,Device Timestamp,Record Type,Historic Glucose mmol/L,Scan Glucose mmol/L
FreeStyle Libre 3,ABC,01-15-2026 08:30,0,5.6,

FreeStyle Libre 3,ABC,01-15-2026 08:35,6,7.0,
FreeStyle Libre 3,ABC,15-01-2026 08:30,1,6.1abc,
FreeStyle Libre 3,ABC,01-15-2026 08:40,0,,9.9
FreeStyle Libre 3,ABC,01-15-2026
"""
DEXCOM = """Index,Timestamp (YYYY-MM-DDThh:mm:ss),Event Type,Event Subtype,Glucose Value (mg/dL),Transmitter ID
1,2026-01-15T08:30:00,EGV,,112,8XYZ
2,2026-01-15T08:35:00,EGV,,Low,8XYZ
3,2026-01-15T08:40:00,Calibration,,180.182,8XYZ
4,2026-01-15T08:45:00,Insulin,,5,8XYZ
"""
GENERIC = '''"Meter, ""big""",When date,Reading,Unit
" A ""q"", b ",2026-01-15 08:30:00, 99 ,mg/dl
x,2026-01-15T09:00:00,5.5,
y,,5.5,mmol
'''


@pytest.fixture()
def folder(tmp_path):
    for name, body in (("l.csv", LIBRE), ("d.csv", DEXCOM.replace("\n", "\r\n")), ("g.csv", GENERIC)):
        (tmp_path / name).write_text(body, newline="")
    return str(tmp_path)


def test_files_of_three_formats_in_one_folder(spark, folder):
    rows = csvfiles.parsed_rows(csvfiles.text_lines(spark, folder)).collect()
    got = sorted((r.file[-5:], r.line_number, r.ts, round(r.value, 4), r.device, r.format) for r in rows)
    assert got == [
        ("d.csv", 2, datetime(2026, 1, 15, 8, 30), 6.2159, "Dexcom 8XYZ", "dexcom"),
        ("d.csv", 4, datetime(2026, 1, 15, 8, 40), 10.0, "Dexcom 8XYZ", "dexcom"),
        ("g.csv", 2, datetime(2026, 1, 15, 8, 30), 5.4944, 'A "q", b', "generic"),
        ("g.csv", 3, datetime(2026, 1, 15, 9, 0), 5.5, "x", "generic"),
        ("l.csv", 2, datetime(2026, 1, 15, 8, 30), 5.6, "FreeStyle Libre 3", "freestyle-libre"),
        ("l.csv", 4, datetime(2027, 3, 1, 8, 30), 6.1, "FreeStyle Libre 3", "freestyle-libre"),
    ]


def test_columns_beyond_the_64th_are_read(spark, tmp_path):
    fill = ",".join(f"h{i}" for i in range(70))
    (tmp_path / "w.csv").write_text(f"{fill},Timestamp,Glucose,Unit,Device\n{fill},2026-01-15 08:30:00,5.5,mmol,far\n")
    (tmp_path / "n.csv").write_text("Timestamp,Glucose\n2026-01-15 09:00:00,6.5\n")
    lines = csvfiles.text_lines(spark, str(tmp_path))
    got = sorted((r.file[-5:], r.ts, r.value, r.device) for r in csvfiles.parsed_rows(lines).collect())
    assert got == [("n.csv", datetime(2026, 1, 15, 9, 0), 6.5, None), ("w.csv", datetime(2026, 1, 15, 8, 30), 5.5, "far")]
    assert {r.file[-5:]: len(r.cells) for r in csvfiles.records(lines).collect()} == {"n.csv": 2, "w.csv": 74}
    named = {r.file[-5:]: r.timestamp_column for r in csvfiles.suggest_mapping(csvfiles.file_heads(lines)).collect()}
    assert named == {"n.csv": "Timestamp", "w.csv": "Timestamp"}


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h\n" + "".join(f"{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        lines = csvfiles.text_lines(spark, str(tmp_path))
        got = {r.line_no: r.value for r in lines.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {1: "h", **{i + 2: str(i) for i in range(5000)}}


def test_unreadable_file_is_reported(spark):
    lines = spark.createDataFrame([("f", 1, "a,b"), ("f", 2, "1,2")], "file string, line_no long, value string")
    columns = csvfiles.file_columns(csvfiles.file_heads(lines), csvfiles.file_formats(lines))
    assert [r.problem for r in csvfiles.unreadable_files(columns).collect()] == ["COLUMNS_NOT_FOUND"]


def test_validation_codes(spark):
    values = [0.9, 1.0, 2.0, 30.0, 35.0, 35.1, float("nan"), None]
    rows = [(v, at(0)) for v in values] + [(5.0, None), (5.0, at(10)), (5.0, at(-60 * 24 * 365 * 6))]
    df = spark.createDataFrame(rows, "value double, ts timestamp")
    got = [(r.errors, r.warnings) for r in importing.validate(df, at(0)).collect()]
    assert got == [
        (["VALUE_OUT_OF_RANGE"], []), ([], ["VALUE_UNUSUAL"]), ([], []), ([], []),
        ([], ["VALUE_UNUSUAL"]), (["VALUE_OUT_OF_RANGE"], []), (["VALUE_INVALID"], []),
        (["VALUE_INVALID"], []), (["TIMESTAMP_INVALID"], []), ([], ["TIMESTAMP_FUTURE"]),
        ([], ["TIMESTAMP_OLD"]),
    ]


def test_duplicates_first_near_one_beats_a_later_exact_one(spark, make_log):
    log = make_log([
        event("e1", at(0), "bsl", 5.0), event("e2", at(60), "bsl", 5.0), event("e3", at(120), "bsl", 5.0),
        event("e4", at(177), "bsl", 5.3), event("e5", at(180), "bsl", 5.0),
        event("e6", at(300), "meal", 5.0), event("o", at(0), "bsl", 5.0, subject=2),
        event("c1", at(400), "bsl", 7.0), event("c2", at(400), "bsl", 7.0),
    ])
    rows = spark.createDataFrame(
        [
            ("exact", 1, at(0), 5.009), ("near", 1, at(60), 5.02), ("edge", 1, at(115), 5.49),
            ("early", 1, at(115, -1), 5.0), ("half", 1, at(60), 5.5), ("order", 1, at(180), 5.0),
            ("meal", 1, at(300), 5.0), ("copies", 1, at(400), 7.0), ("copies2", 1, at(400), 7.0),
        ],
        "row_id string, subject_id long, ts timestamp, value double",
    )
    got = {r.row_id: (r.existing_id, r.match_type, r.time_difference_ms)
           for r in importing.find_duplicates(rows, log).collect()}
    assert got == {
        "exact": ("e1", "exact", 0), "near": ("e2", "near", 0), "edge": ("e3", "near", 300000),
        "order": ("e4", "near", 180000), "copies": ("c1", "exact", 0), "copies2": ("c1", "exact", 0),
    }


def test_skip_makes_an_import_idempotent(spark, make_log):
    log = make_log([event("e", at(0), "bsl", 5.0)])
    rows = spark.createDataFrame(
        [("a", 1, at(0), 5.0), ("b", 1, at(60), 6.0)], "row_id string, subject_id long, ts timestamp, value double"
    )
    once = importing.apply_import(log, rows, importing.find_duplicates(rows, log), "skip")
    again = importing.apply_import(once, rows, importing.find_duplicates(rows, once), "skip")
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in once.collect()) == ["b", "e"]
    with pytest.raises(ValueError):
        importing.rows_to_import(rows, rows, "other")
