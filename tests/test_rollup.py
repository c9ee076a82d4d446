from datetime import datetime

import pytest

from panelmill.operators.cleaning import clean_price
from panelmill.operators.rollup import join_feeds, join_predictions, rollup_load, rollup_price
from panelmill.plans.panels import processed_panel

PRICE = (
    "timestamp timestamp_ntz, Name string, PTID int, LBMP double, "
    "Marginal_Cost_Losses double, Marginal_Cost_Congestion double"
)
LOAD = "timestamp timestamp_ntz, `Time Zone` string, Name string, PTID int, Load double"


def at(hour, minute=0):
    return datetime(2024, 11, 3, hour, minute)


def test_null_price_pulls_the_mean_only_when_cleaned(spark):
    df = spark.createDataFrame([(at(1, 5), "A", 1, 10.0, 0.0, 0.0), (at(1, 10), "A", 1, None, 0.0, 0.0)], PRICE)
    assert rollup_price(df).first().LBMP_avg == 10.0
    assert rollup_price(clean_price(df)).first().LBMP_avg == 5.0
    assert rollup_price(df).first().price_count == 2


def test_single_reading_has_no_deviation(spark):
    df = spark.createDataFrame([(at(1), "A", 1, 10.0, 0.0, 0.0)], PRICE)
    assert rollup_price(df, stats="std").first().LBMP_std is None
    full = rollup_price(df, stats="full").first()
    assert (full.LBMP_min, full.LBMP_max, full.price_readings) == (10.0, 10.0, 1)


def test_repeated_clock_hour_is_one_bucket_with_the_first_label(spark):
    rows = [(at(1, 0), "EDT", "A", 1, 1.0), (at(1, 30), "EDT", "A", 1, 2.0), (at(1, 0), "EST", "A", 1, 3.0)]
    df = spark.createDataFrame(rows, LOAD)
    (row,) = rollup_load(df, zone_label="Time Zone").collect()
    assert (row.Load_MW, row.Time_Zone) == (2.0, "EDT")


def test_join_keeps_one_ptid_and_fans_out_over_two(spark):
    price = rollup_price(
        spark.createDataFrame([(at(1), "A", p, 10.0, 0.0, 0.0) for p in (1, 2)] + [(at(9), "A", 1, 1.0, 0.0, 0.0)], PRICE)
    )
    load = rollup_load(spark.createDataFrame([(at(1), "EST", "A", 1, 5.0), (at(2), "EST", "A", 1, 6.0)], LOAD))
    rows = join_feeds(price, load).collect()
    assert sorted((r.PTID, r.Load_MW) for r in rows) == [(1, 5.0), (2, 5.0)]
    assert rows[0].asDict().keys() >= {"timestamp", "Name", "PTID", "price_count", "Load_MW"}


def test_load_rollup_variants(spark):
    price = spark.createDataFrame([(at(1), "A", 1, 10.0, 0.0, 0.0)], PRICE)
    load = spark.createDataFrame([(at(1, 5), "EST", "A", 1, 5.0), (at(1, 10), "EST", "A", 1, 7.0)], LOAD)
    assert processed_panel(price, load).first().Load_MW == 6.0
    first = processed_panel(price, load, load_rollup="first").first()
    assert (first.Load_MW, first["Time Zone"]) == (5.0, "EST")
    with pytest.raises(ValueError):
        processed_panel(price, load, load_rollup="median")


def test_unknown_grain_is_refused(spark):
    df = spark.createDataFrame([(at(1), "A", 1, 10.0, 0.0, 0.0)], PRICE)
    with pytest.raises(ValueError):
        rollup_price(df, grain="fortnight")


def test_join_predictions(spark):
    keys = "timestamp timestamp_ntz, Name string, "
    price = spark.createDataFrame([(at(1), "A", 1.0), (at(2), "A", 2.0)], keys + "predicted_price double")
    demand = spark.createDataFrame([(at(1), "A", 10.0), (at(3), "A", 9.0)], keys + "predicted_load double")
    spike = spark.createDataFrame([(at(1), "A", 1)], keys + "predicted_spike int")
    (row,) = join_predictions(price, demand, spike).collect()
    assert (row.predicted_price, row.predicted_load, row.predicted_spike) == (1.0, 10.0, 1)
