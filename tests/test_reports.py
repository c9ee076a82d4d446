from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import reports


def test_empty_panel_has_zero_kpis_and_rate(spark):
    df = spark.createDataFrame([], "LBMP_avg double, Load_MW double, is_price_spike int")
    assert tuple(reports.kpi_summary(df).first()) == (0.0, 0.0, 0, 0)
    assert tuple(reports.label_rate(df).first()) == (0, 0, 0.0)


def test_no_predicted_spikes_gives_totals_only(spark):
    df = spark.createDataFrame(
        [(1, 5.0, 2.0, 0.1, 0)], "hour int, LBMP_avg double, Load_MW double, congestion_impact double, predicted_spike int"
    )
    assert tuple(reports.spike_profile(df).first()) == (1, 0, None, None, None, None, None)


def test_spike_profile_hours(spark):
    rows = [(h, float(p), 1.0, 0.5, s) for h, p, s in [(3, 10, 1), (1, 20, 1), (3, 60, 1), (5, 99, 0)]]
    df = spark.createDataFrame(
        rows, "hour int, LBMP_avg double, Load_MW double, congestion_impact double, predicted_spike int"
    )
    row = reports.spike_profile(df).first()
    assert (row.total_predictions, row.predicted_spikes, row.avg_spike_price, row.max_spike_price) == (4, 3, 30.0, 60.0)
    assert [tuple(e) for e in row.hourly_distribution] == [(1, 1), (3, 2)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double")
    counts = {r.bin: r["count"] for r in reports.histogram(df, "v", 50).collect()}
    assert sum(counts.values()) == 101 and counts[49] == 3 and counts[0] == 2
    constant = spark.createDataFrame([(4.0,), (4.0,), (None,)], "v double")
    assert [tuple(r) for r in reports.histogram(constant, "v").collect()] == [(0, 2)]
    clipped = {r.bin: r["count"] for r in reports.histogram(df, "v", 2, limits=(0.0, 2.0)).collect()}
    assert clipped == {0: 1, 1: 100}


def test_correlation_of_constants_and_single_rows_is_null(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("c", 1.0, 2.0), ("c", 2.0, 4.0)],
                               "k string, x double, y double")
    got = {r.k: r.correlation for r in reports.corr_by(df, "k", "x", "y").collect()}
    assert got["a"] is None and got["b"] is None and got["c"] == pytest.approx(1.0)


@pytest.mark.parametrize("with_null", [False, True])
def test_correlation_matrix(spark, with_null):
    import pandas as pd

    data = pd.DataFrame({"a": [1.0, 2.0, 4.0, 8.0], "b": [3.0, 1.0, 5.0, 2.0], "c": [7.0] * 4})
    if with_null:
        data.loc[1, "b"] = None
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in data.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = data.corr()
    for r in reports.corr_matrix(df, ["a", "b", "c"]).collect():
        expected = want.loc[r.x, r.y]
        assert (r.r is None) if pd.isna(expected) else r.r == pytest.approx(expected)


def test_pivot_fills_missing_cells(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 0, 4.0), (2, 1, 5.0)], "d int, h int, v double")
    filled = reports.pivot_mean(df, "d", "h", range(2), "v", fill=0.0).orderBy("d")
    assert [tuple(r) for r in filled.collect()] == [(1, 3.0, 0.0), (2, 0.0, 5.0)]
    assert reports.pivot_mean(df, "d", "h", range(2), "v").orderBy("d").first().h_1 is None


def test_daily_trend_by_entity_keeps_the_first_names(spark):
    rows = [(datetime(2024, 1, 1, h), n, 1.0, 2.0) for h in range(2) for n in "CABD"]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, Name string, LBMP_avg double, Load_MW double")
    out = reports.daily_trend_by_entity(df, entities=2)
    assert [r.Name for r in out.collect()] == ["A", "B"]


def test_profile(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    assert tuple(reports.profile_table(df, "t").first()) == ("t", 1, 2, "i,s")


def test_sql_reports_see_registered_feeds(spark):
    price = spark.createDataFrame(
        [(datetime(2024, 1, 1), "A", 1.0), (datetime(2024, 1, 3, 1), "A", 2.0), (None, "B", 9.0)],
        "timestamp timestamp_ntz, Name string, LBMP double",
    )
    load = price.select("timestamp", "Name", F.col("LBMP").alias("Load"))
    reports.register_feeds(price, load)
    stats = reports.price_stats(spark).collect()
    assert [(r.Zone, r.Records, r.Avg_Price, r.Median_Price) for r in stats] == [("B", 1, 9.0, 9.0), ("A", 2, 1.5, 1.5)]
    assert [r.Days_Covered for r in reports.time_range(spark).collect()] == [2, 2]
    assert [r.Zone for r in reports.load_stats(spark).collect()] == ["B", "A"]


def test_correlations_by_pair_without_nulls_and_far_from_zero(spark):
    nan, far = float("nan"), 1e9
    rows = [(1.0, 2.0, far + 1, 5.0, None), (2.0, None, far + 2, 5.0, None), (3.0, 7.0, far + 4, 5.0, None), (4.0, nan, far + 3, 5.0, None), (5.0, 6.0, far + 9, 5.0, None)]
    df = spark.createDataFrame(rows, "`a.b` double, b double, c double, d double, e double").repartition(3)
    got = {(r.x, r.y): r.r for r in reports.corr_matrix(df, ["a.b", "b", "c", "d", "e"]).collect()}
    assert len(got) == 25
    for x, y, left, right in [
        ("a.b", "b", [1, 3, 5], [2, 7, 6]), ("a.b", "c", [1, 2, 3, 4, 5], [1, 2, 4, 3, 9]), ("c", "b", [1, 4, 9], [2, 7, 6])
    ]:
        assert got[x, y] == got[y, x] == pytest.approx(np.corrcoef(left, right)[0, 1], abs=1e-9)
    assert got["b", "b"] == pytest.approx(1) and got["c", "c"] == pytest.approx(1)
    assert all(r is None for (x, y), r in got.items() if {x, y} & {"d", "e"})
    empty = reports.corr_matrix(df.limit(0), ["b", "c"]).collect()
    assert len(empty) == 4 and all(r.r is None for r in empty)
