"""Kernel values worked out by an independent plain calculation."""

import pytest
from pyspark.sql import functions as F

from glycoflow.functions import alcohol, carbs, circadian, glucose, insulin, jsmath, macros, text
from glycoflow.functions import dates, volume


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    "kind, minutes, activity, left",
    [
        ("bolus", 0, 0, 1), ("bolus", 15, 0.925167, 0.915102), ("bolus", 60, 0.722355, 0.530679),
        ("bolus", 120, 0.333773, 0.243693), ("bolus", 239, 0.071169, 0.051959), ("bolus", 240, 0, 0),
        ("bolus", -1, 0, 1), ("basal", 90, 0.933076, 0.907259), ("basal", 360, 0.692366, 0.498680),
        ("basal", 1439, 0.053457, 0.038248),
    ],
)
def test_insulin(spark, kind, minutes, activity, left):
    m, k = F.lit(float(minutes)), F.lit(kind)
    assert one(spark, insulin.activity(m, k), insulin.on_board(m, k)) == pytest.approx(
        (activity, left), abs=1e-6
    )


@pytest.mark.parametrize(
    "gi, minutes, rate, left",
    [
        (60, 0, 0, 50), (60, 30, 13.858832, 48.294298), (60, 66, 31.25, 30),
        (60, 120, 13.440458, 12.902839), (60, 191, 4.432192, 4.254905), (60, 192, 0, 0),
        (100, 30, 50, 30), (60, -5, 0, 50),
    ],
)
def test_carbs_jump_at_the_peak(spark, gi, minutes, rate, left):
    args = F.lit(float(minutes)), F.lit(50.0), F.lit(float(gi))
    assert one(spark, carbs.absorption_rate(*args), carbs.on_board(*args)) == pytest.approx(
        (rate, left), abs=1e-6
    )


@pytest.mark.parametrize(
    "kind, units, minutes, expected",
    [
        ("beer", 2.0, 30.0, (4.462603, 11.537397, 2.746999, 0.925)),
        ("spirit", 2.0, 60.0, (0.366313, 11.633687, 2.769926, 0.75)),
        ("beer", 2.0, 390.0, (0.0, 0.0, 0.0, 0.925)),
    ],
)
def test_alcohol(spark, kind, units, minutes, expected):
    m, u, k, kg = F.lit(minutes), F.lit(units), F.lit(kind), F.lit(70.0)
    system = alcohol.in_system(m, u, k, kg)
    got = one(
        spark, alcohol.absorbing(m, u, k), system, alcohol.blood_level(system, kg),
        alcohol.sensitivity(m, k),
    )
    assert got == pytest.approx(expected, abs=1e-5)


def test_numbers_follow_the_data_model(spark):
    got = one(
        spark,
        jsmath.half_up(F.lit(1.005), 2), jsmath.half_up(F.lit(-2.5)),
        jsmath.parse_number(F.lit("5.6abc")), jsmath.parse_number(F.lit("Low")),
        jsmath.or_default(F.lit(0.0), 7.0), jsmath.or_default(F.lit(float("nan")), 7.0),
        jsmath.text_or_default(F.lit(""), "x"),
    )
    assert list(got) == [1.0, -2.0, 5.6, None, 7.0, 7.0, "x"]


def test_first_keyword_in_listed_order_wins(spark):
    words = ["whole grain bread", "Pineapple", "Wholegrain wrap", "white plate", "default", "", None]
    rows = spark.createDataFrame([(w,) for w in words], "d string")
    got = [r[0] for r in rows.select(text.glycemic_index(F.col("d"))).collect()]
    assert got == [75.0, 38.0, 50.0, 70.0, 60.0, 60.0, 60.0]
    names = spark.createDataFrame([("eggplant",), ("licorice",), ("Steak",)], "d string")
    assert [r[0] for r in names.select(text.food_category(F.col("d"))).collect()] == [
        "protein", "grain", "beverage",  # s-tea-k
    ]


def test_dates_roll_over_and_are_bounded(spark):
    def shown(column):
        return dates.display(column)

    got = one(
        spark,
        shown(dates.parse_libre(F.lit("15-01-2026 08:30"))),
        shown(dates.parse_libre(F.lit("15-01-2026 08:30"), us_format=False)),
        shown(dates.parse_any(F.lit("01-15-1999 08:30"))),
        shown(dates.parse_any(F.lit(" 2026-01-15T08:30:00 "))),
        shown(dates.parse_any(F.lit("2026-01-15T08:30:00+02:00"))),
        shown(dates.parse_any(F.lit("2026-01-15 08:30:00"))),
        shown(dates.parse_any(F.lit("1999-05-05"))),
        shown(dates.parse_any(F.lit("soon"))),
        dates.date_format(F.lit("2026-01-15 08:30:00")),
    )
    assert list(got) == [
        "2027-03-01 08:30:00", "2026-01-15 08:30:00", None, "2026-01-15 08:30:00",
        "2026-01-15 06:30:00", "2026-01-15 08:30:00", "1999-05-05 00:00:00", None, "DEXCOM",
    ]


def test_hour_of_day_is_local(spark):
    ts = F.lit("2025-01-01 20:30:00").cast("timestamp")
    local = circadian.local_time(ts, "Australia/Sydney")  # 07:30 there
    got = one(spark, *circadian.interpolated(local).values())
    assert got == pytest.approx((7, 1.175, 0.6, 1.235))
    spans = spark.sql(
        "SELECT t AS a, t + INTERVAL 1 HOUR AS b FROM VALUES "
        "(TIMESTAMP '2025-01-01 20:30:00'), (TIMESTAMP '2025-01-01 07:30:00') AS v(t)"
    )
    zone = "'Australia/Sydney'"
    there = spans.select(circadian.drift("a", "b", zone)).collect()[0][0]
    here = spans.select(circadian.drift("a", "b")).collect()[1][0]
    # 12 samples from 07:30: 0.6 down to 0.4 at 08:00, then to 0.25
    want = sum(0.8 - 0.4 * m / 60 if m < 60 else 0.4 - 0.3 * (m - 60) / 60 for m in range(30, 90, 5)) / 12 * 1.5
    assert there == pytest.approx(want) and here == pytest.approx(want)


def test_own_circadian_adjustments(spark):
    adjust = F.create_map(F.lit(7), F.lit(1.5))
    got = one(spark, circadian.base_sensitivity(F.lit(7), adjust), circadian.base_sensitivity(F.lit(8), adjust))
    assert got == pytest.approx((1.8, 1.15))


def test_units_bands_and_errors(spark):
    got = one(
        spark,
        glucose.normalised(F.lit(180.182), F.lit("mg/dL")),
        glucose.normalised(F.lit(6.2), F.lit("mg/dL")),
        glucose.unit_suspect(F.lit(6.2), F.lit("mg/dL")),
        glucose.mmol_to_mgdl(F.lit(5.5)),
        macros.percent_error(F.lit(0.0), F.lit(0.0)), macros.percent_error(F.lit(5.0), F.lit(0.0)),
        glucose.premeal_minutes(F.lit(None).cast("double")), glucose.premeal_minutes(F.lit(3.9)),
    )
    assert list(got) == pytest.approx([10.0, 6.2, True, 99.0, 0.0, 100.0, 0, -15])


def test_polygon(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
                       for x, y in ((0, 0), (60, 0), (60, 60), (0, 60))])
    line = F.slice(square, 1, 2)
    got = one(spark, volume.polygon_area(square), volume.polygon_area(line),
              volume.area_mm2(volume.polygon_area(square), F.lit(None).cast("double")))
    assert list(got) == [3600.0, 0.0, 400.0]
