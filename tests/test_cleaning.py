from datetime import datetime

from pyspark.sql import functions as F

from panelmill.functions.columns import bucket, calendar, parse_wall_clock, ratio_or
from panelmill.operators.cleaning import clean_load, clean_price, drop_incomplete, first_in_bucket, keep

PRICE = "timestamp timestamp_ntz, Name string, LBMP double, Marginal_Cost_Losses double, Marginal_Cost_Congestion double"
T0 = datetime(2024, 1, 1, 5, 10)


def price_rows(spark, prices):
    return spark.createDataFrame([(T0, "A", p, None, 1.0) for p in prices], PRICE)


def test_wall_clock_parsing(spark):
    texts = ["01/02/2024 03:05:09", "bad", "01/02/2024 03:05", "13/45/2024 03:05:00", "02/30/2024 01:00:00", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(parse_wall_clock(F.col("t"))).collect()]
    assert got == [datetime(2024, 1, 2, 3, 5, 9), None, None, None, None, None]


def test_parsing_and_bucketing_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 does not exist in New York on that day
        df = spark.createDataFrame([("03/10/2024 02:30:00",)], "t string")
        stamp = parse_wall_clock(F.col("t"))
        row = df.select(stamp.alias("s"), bucket(stamp, "hour").alias("h"), bucket(stamp, "day").alias("d")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row == (datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 2), datetime(2024, 3, 10))


def test_price_flags_on_both_thresholds(spark):
    rows = clean_price(price_rows(spark, [-500.0, -500.01, 2000.0, 2000.01])).collect()
    assert {r.LBMP: r.is_extreme_price for r in rows} == {-500.0: False, -500.01: True, 2000.0: False, 2000.01: True}


def test_price_nulls_are_filled_and_unstamped_rows_dropped(spark):
    df = price_rows(spark, [None, float("nan")]).union(
        spark.createDataFrame([(None, "A", 1.0, 1.0, 1.0)], PRICE)
    )
    rows = clean_price(df).collect()
    assert [(r.LBMP, r.Marginal_Cost_Losses, r.is_extreme_price) for r in rows] == [(0.0, 0.0, False)] * 2


def test_load_fill_and_flag(spark):
    df = spark.createDataFrame([(T0, None), (T0, -1.0), (T0, 2.0), (None, 3.0)], "timestamp timestamp_ntz, Load double")
    assert sorted((r.Load, r.is_negative_load) for r in clean_load(df).collect()) == [
        (-1.0, True),
        (0.0, False),
        (2.0, False),
    ]


def test_first_in_bucket_is_earliest_then_smallest(spark):
    rows = [
        (datetime(2024, 1, 1, 5, 30), "A", 1, 9.0, "EST"),
        (datetime(2024, 1, 1, 5, 10), "A", 2, 7.0, "EST"),
        (datetime(2024, 1, 1, 5, 10), "A", 2, 4.0, "EDT"),
        (datetime(2024, 1, 1, 6, 0), "A", 1, 1.0, "EST"),
    ]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, Name string, PTID int, Load double, `Time Zone` string")
    got = sorted(tuple(r) for r in first_in_bucket(df).collect())
    assert got == [
        (datetime(2024, 1, 1, 5), "A", 2, 4.0, "EDT"),
        (datetime(2024, 1, 1, 6), "A", 1, 1.0, "EST"),
    ]


def test_drop_incomplete_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(1.0, "x"), (float("nan"), "y"), (None, "z"), (2.0, None)], "v double, s string")
    assert [r.v for r in drop_incomplete(df).collect()] == [1.0]
    assert sorted(r.v for r in drop_incomplete(df, subset=["v"]).collect()) == [1.0, 2.0]


def test_optional_filters(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "Name string, month int")
    assert keep(df, Name=None, month=None).count() == 3
    assert keep(df, Name="A", month=None).count() == 2
    assert keep(df, Name="A", month=1).count() == 1


def test_ratio_or_default_for_zero_and_null(spark):
    df = spark.createDataFrame([(1, 2.0, 4.0), (2, 2.0, 0.0), (3, 2.0, None)], "i int, n double, d double")
    got = [r[0] for r in df.orderBy("i").select(ratio_or(F.col("n"), F.col("d"), 1)).collect()]
    assert got == [0.5, 1.0, 1.0]


def test_calendar_parts(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 10, 22),), (datetime(2024, 3, 11, 6),)], "ts timestamp_ntz")
    sunday, monday = df.orderBy("ts").withColumns(calendar(F.col("ts"), ("peak", "week"))).collect()
    assert (sunday.hour, sunday.day_of_week, sunday.day_of_month, sunday.month, sunday.year) == (22, 1, 10, 3, 2024)
    assert (sunday.is_weekend, sunday.is_peak_hour, sunday.week_of_year, sunday.day_name) == (1, 1, 10, "Sunday")
    assert (monday.is_weekend, monday.is_peak_hour, monday.week_of_year) == (0, 0, 11)
    assert abs(monday.hour_sin - 1.0) < 1e-12 and abs(monday.month_sin - 1.0) < 1e-12
