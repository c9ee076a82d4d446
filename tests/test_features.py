from datetime import datetime, timedelta

from pyspark.sql import functions as F

from panelmill.operators import features as feat
from panelmill.plans.panels import featured_panel, flat_panel

PANEL = (
    "timestamp timestamp_ntz, Name string, PTID int, LBMP_avg double, Marginal_Cost_Losses_avg double, "
    "Marginal_Cost_Congestion_avg double, Load_MW double"
)
STATS = "LBMP_avg double, LBMP_avg_ma_24 double, LBMP_avg_std_24 double, Load_MW double, Load_MW_ma_24 double, Load_MW_std_24 double, Marginal_Cost_Congestion_avg double"


def hours(n):
    return [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(n)]


def labelled(spark, *rows):
    return feat.add_spike_labels(feat.add_load_features(spark.createDataFrame(list(rows), STATS)))


def test_first_24_rows_are_dropped(spark):
    rows = [(t, "A", 1, float(i % 7), 0.0, 0.0, float(i % 5)) for i, t in enumerate(hours(200))]
    assert featured_panel(spark.createDataFrame(rows, PANEL)).count() == 176


def test_zero_series_takes_the_defaults(spark):
    rows = [(t, "A", 1, 0.0, 0.0, 0.0, 0.0) for t in hours(30)]
    out = featured_panel(spark.createDataFrame(rows, PANEL)).select(
        "price_volatility_ratio", "price_deviation_24h", "congestion_impact", "load_ratio_24h", "is_price_spike"
    )
    assert {tuple(r) for r in out.collect()} == {(0.0, 0.0, 0.0, 1.0, 0)}


def test_price_at_the_threshold_is_no_spike(spark):
    tie, above = labelled(
        spark, (16.0, 10.0, 2.0, 0.0, 0.0, 0.0, 0.0), (16.1, 10.0, 2.0, 0.0, 0.0, 0.0, 0.0)
    ).orderBy("LBMP_avg").collect()
    assert (tie.spike_threshold, tie.is_price_spike, above.is_price_spike) == (16.0, 0, 1)


def test_unknown_threshold_is_no_spike(spark):
    row = labelled(spark, (16.0, None, None, 1.0, None, None, 50.0)).first()
    assert (row.is_price_spike, row.spike_cause, row.is_peak_load) == (0, "none", 0)


def test_spike_cause_order(spark):
    rows = labelled(
        spark,
        (100.0, 1.0, 1.0, 9.0, 1.0, 1.0, -60.0),  # congested and peak load
        (101.0, 1.0, 1.0, 9.0, 1.0, 1.0, 50.5),  # exactly half the price is not congested
        (102.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0),
        (1.0, 1.0, 1.0, 9.0, 1.0, 1.0, 90.0),
    ).orderBy("LBMP_avg")
    assert [r.spike_cause for r in rows.collect()] == ["none", "congestion", "high_demand", "other"]


def test_feature_sets(spark):
    assert [len(feat.feature_columns(t)) for t in ("price", "demand", "spike", "none")] == [43, 43, 43, 42]
    assert [len(feat.FLAT_FEATURES[t]) for t in ("price", "demand", "spike")] == [16, 15, 12]
    assert len(feat.EXTENDED_PRICE_FEATURES) == 21
    safe = set(feat.feature_columns("price", leak_free=True))
    assert "price_momentum_24h" not in safe and "LBMP_avg_lag_24" in safe


def test_momentum_and_lag_give_the_price_back(spark):
    rows = [(t, "A", 1, float(i * i % 11), 0.0, 0.0, float(i % 5)) for i, t in enumerate(hours(60))]
    out = featured_panel(spark.createDataFrame(rows, PANEL))
    assert out.where(F.col("price_momentum_24h") + F.col("LBMP_avg_lag_24") != F.col("LBMP_avg")).isEmpty()


def test_flat_variant_drops_hours_with_one_reading(spark):
    price = "timestamp timestamp_ntz, Name string, PTID int, LBMP double, Marginal_Cost_Losses double, Marginal_Cost_Congestion double"
    rows = [(t + timedelta(minutes=m), "A", 1, float(i + m), 0.0, 0.0) for i, t in enumerate(hours(40)) for m in (0, 5)]
    rows = [r for r in rows if r[0] != datetime(2024, 1, 2, 12, 5)]
    load = spark.createDataFrame([(t, "A", float(i % 3)) for i, t in enumerate(hours(40))], "timestamp timestamp_ntz, Name string, Load double")
    out = flat_panel(spark.createDataFrame(rows, price), load)
    assert out.count() == 15
    assert out.where(F.col("hour_timestamp") == datetime(2024, 1, 2, 12)).isEmpty()
