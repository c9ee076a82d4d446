"""Cases that tables without gaps cannot show: missing sides, reordered headers, clock changes, labels behind the cut."""

import math

import pytest
from pyspark.sql import functions as F

from panelmill.functions.columns import parse_wall_clock
from panelmill.operators import metrics, models
from panelmill.sources import feeds
from workload.queries import QUERIES


def test_metrics_use_complete_pairs(spark):
    rows = [("a", 0.0, 1.0), ("a", 10.0, 9.0), ("b", 1000.0, None), ("b", None, 5.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    got = metrics.regression_metrics(df, "y", "p").first()
    assert math.isclose(got.r2, 0.96) and math.isclose(got.mape, 5.0) and math.isclose(got.rmse, 1.0)
    assert {r.g: r["count"] for r in metrics.error_by(df, "g", "y", "p").collect()} == {"a": 2, "b": 0}
    info = metrics.model_report(df, "m", "y", "p", 1).first()["data_info"]
    assert (info["test_size"], info["left_out"]) == (2, 2)


def write(path, header, row):
    path.mkdir()
    (path / "a.csv").write_text(f"{header}\n{row}\n")
    return str(path / "*.csv")


def test_csv_by_header(spark, tmp_path):
    price, losses, congestion = (feeds.VENDOR_HEADERS[n] for n in ("LBMP", "Marginal_Cost_Losses", "Marginal_Cost_Congestion"))
    usual = write(tmp_path / "u", f"Time Stamp,Name,PTID,{price},{losses},{congestion}", "01/02/2024 03:00:00,N,1,30,0.5,2")
    other = write(tmp_path / "o", f"Time Stamp,Name,PTID,{losses},{price},{congestion},x", "01/02/2024 04:00:00,N,1,0.5,30,2,y")
    got = feeds.read_feed(spark, [usual, other], feeds.PRICE_SCHEMA).select("LBMP", "Marginal_Cost_Losses").collect()
    assert [tuple(r) for r in got] == [(30.0, 0.5)] * 2
    short = write(tmp_path / "s", f"Time Stamp,Name,PTID,{losses}", "01/02/2024 04:00:00,N,1,0.5")
    with pytest.raises(ValueError, match="LBMP"):
        feeds.read_feed(spark, short, feeds.PRICE_SCHEMA)


def test_wall_clock_over_a_clock_change(spark, tmp_path):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        stamps = ["03/10/2024 02:30:00", "11/03/2024 01:30:00", "12/31/2024 23:59:59"]
        df = spark.createDataFrame([(s, "N", 1, 1.0, 2.0, 3.0) for s in stamps], "t string, Name string, PTID int, LBMP double, Marginal_Cost_Losses double, Marginal_Cost_Congestion double")
        df = df.withColumn("timestamp", parse_wall_clock(F.col("t")))
        feeds.write_feed(df, f"{tmp_path}/2024_realtime_zone_csv", ["Name", "PTID", "LBMP", "Marginal_Cost_Losses", "Marginal_Cost_Congestion"])
        back = feeds.read_price_feed(spark, str(tmp_path))
        assert sorted(r["Time Stamp"] for r in back.collect()) == sorted(stamps)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_no_training_label_behind_the_cut(spark, monkeypatch):
    panel = spark.range(300).select(
        F.expr("timestampadd(HOUR, CAST(id AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("timestamp"),
        F.lit("N").alias("Name"),
        F.col("id").cast("double").alias("Load_MW"),
    )
    seen, fit = [], models.fit

    def watched(train, features, estimator):
        seen.append(train.agg(F.max("_ahead_6"), F.max("Load_MW")).first())
        return fit(train, features, estimator)

    monkeypatch.setattr(models, "fit", watched)
    out = models.forecast_horizon(panel, ["Load_MW"], horizons=(6,), rounds=1, depth=2)
    first = out.agg(F.min("timestamp")).first()[0]
    (label, _), = seen
    assert label < panel.where(F.col("timestamp") < F.lit(first).cast("timestamp_ntz")).count()


def test_registered_forecast_has_every_horizon(spark, small, monkeypatch):
    monkeypatch.setattr(models, "DEMAND_MODEL", {**models.DEMAND_MODEL, "depth": 1, "rounds": 1})
    found = QUERIES["forecast_horizon"](spark, small).groupBy("horizon").count().collect()
    assert sorted(r.horizon for r in found) == list(range(1, 25))
    assert len({r["count"] for r in found}) == 1
