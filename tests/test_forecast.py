"""Recursive forecasts against a plain recursion, and fits that run at once."""

import math
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from panelmill.operators import forecast, models
from panelmill.operators.series import lags, rolling, with_series_columns

START = datetime(2024, 1, 1)


def hourly(spark, n=260, gaps=(), entities=("A", "B")):
    rows = [
        (START + timedelta(hours=i), name, 1, float((i * 7 + k) % 24 + (i % 5)))
        for k, name in enumerate(entities)
        for i in range(n)
        if i not in gaps
    ]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, Name string, PTID int, Load_MW double")


def test_features_of_the_next_row_are_its_window_columns(spark):
    panel = hourly(spark, 200, entities=("A",)).withColumn("Load_MW", F.when(F.col("Load_MW") != 5, F.col("Load_MW")))
    specs = [rolling("Load_MW"), lags("Load_MW"), forecast.history("Load_MW", 168, "past")]
    wide = with_series_columns(panel, specs, reach=168)
    names = [c for c in wide.columns if c.startswith("Load_MW_")]
    built = wide.select("timestamp", *[c.alias(n) for n, c in forecast.next_row_features(F.col("past"), "Load_MW").items()])
    want = {r.timestamp: r for r in wide.select("timestamp", *names).collect()}
    rows = built.collect()
    assert set(names) == set(built.columns) - {"timestamp"}
    for row in rows:
        target = want.get(row.timestamp + timedelta(hours=1))
        for n in names if target else ():
            close = row[n] is None if target[n] is None else math.isclose(row[n], target[n], abs_tol=1e-9)
            assert close, (row.timestamp, n)


def test_recursion_against_plain_steps(spark):
    gap = (251,)
    panel = hourly(spark, 260, gaps=gap, entities=("A",))
    features = forecast.forecast_features("Load_MW")
    specs = [rolling("Load_MW"), lags("Load_MW")]
    wide = with_series_columns(panel, specs, reach=168)
    wide = wide.withColumns(forecast._calendar_features(F.col("timestamp")))
    model = models.fit(wide, features, models.demand_regressor(prediction="predicted", depth=3, rounds=4))
    scaler, trees = model.stages[1], model.stages[2]
    mean, std = scaler.mean.toArray(), scaler.std.toArray()

    def predict(past, when):
        def rolled(n):
            last = past[-n:]
            m = sum(last) / len(last)
            return [m, math.sqrt(sum((x - m) ** 2 for x in last) / (len(last) - 1)), min(last), max(last)]

        turn, moon = 2 * math.pi * when.hour / 24, 2 * math.pi * when.month / 12
        weekday = when.isoweekday() % 7 + 1
        known = [when.hour, weekday, when.day, when.month, int(weekday in (1, 7))]
        known += [math.sin(turn), math.cos(turn), math.sin(moon), math.cos(moon)]
        known += rolled(24) + rolled(168) + [past[-k] for k in (1, 2, 3, 6, 12, 24)]
        return trees.predict(Vectors.dense([(x - m) / s if s else 0.0 for x, m, s in zip(known, mean, std)]))

    out = forecast.recursive_forecast(panel, horizons=6, model=model)
    got = {(r.timestamp, r.horizon): r for r in out.collect()}
    held = {r.timestamp: r.Load_MW for r in panel.collect()}
    origins = sorted({t for t, _ in got})
    assert origins == [t for t in sorted(held) if t >= START + timedelta(hours=208)]
    for origin in (*origins[:3], *origins[-12:]):
        past = [held[t] for t in sorted(held) if t <= origin][-168:]
        for h in range(1, 7):
            when = origin + timedelta(hours=h)
            past = [*past, predict(past, when)][-168:]
            row = got[origin, h]
            assert row.predicted == pytest.approx(past[-1], abs=1e-6)
            assert (row.target_time, row.actual) == (when, held.get(when))


def test_recursion_learns_a_daily_shape(spark):
    """Over a repeating day the recursion is far better than the last value, a day ahead too."""
    out = forecast.recursive_forecast(
        hourly(spark, 480, entities=("A",)).withColumn("Load_MW", F.hour("timestamp") * 10.0),
        estimator=models.demand_regressor(prediction="predicted", depth=6, rounds=5),
    )
    error = out.groupBy("horizon").agg(F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("e")).collect()
    assert len(error) == 24 and all(r.e < 5 for r in error)


def test_days_and_unknown_grain(spark):
    days = hourly(spark, 120).withColumn("timestamp", F.expr("timestampadd(DAY, datediff(HOUR, TIMESTAMP_NTZ '2024-01-01', timestamp), TIMESTAMP_NTZ '2020-01-01')"))
    out = forecast.recursive_forecast(
        days, horizons=2, grain="day", estimator=models.demand_regressor(prediction="predicted", depth=2, rounds=1)
    )
    row = out.where("horizon = 2").orderBy("timestamp").first()
    assert row.target_time - row.timestamp == timedelta(days=2) and row.actual is not None
    with pytest.raises(ValueError):
        forecast.recursive_forecast(days, grain="week")


def test_work_overlaps_and_results_keep_their_names(spark):
    together = threading.Barrier(3, timeout=60)
    spark.sparkContext.setLocalProperty("panelmill.test", "mine")
    pools = {}

    def piece(name):
        together.wait()
        pools[name] = tuple(spark.sparkContext.getLocalProperty(p) for p in ("spark.scheduler.pool", "panelmill.test"))
        return spark.range(len(name)).count()

    got = models.run_together(spark, {n: lambda n=n: piece(n) for n in ("a", "bb", "ccc")}, at_once=3)
    assert got == {"a": 1, "bb": 2, "ccc": 3}
    assert pools == {n: (n, "mine") for n in got}
    assert models.run_together(spark, {}) == {}
    with pytest.raises(ZeroDivisionError):
        models.run_together(spark, {"a": lambda: 1, "b": lambda: 1 / 0})


def test_fits_at_once_give_the_models_of_fits_in_turn(spark):
    panel = hourly(spark, 120).withColumns({"hour": F.hour("timestamp"), "double": F.col("Load_MW") * 2})
    jobs = {
        "load": (["hour"], models.demand_regressor(depth=3, rounds=2)),
        "double": (["hour", "Load_MW"], models.price_regressor(label="double", depth=3, rounds=2)),
    }
    fitted = models.fit_together(panel, jobs)
    for name, (features, estimator) in jobs.items():
        alone = models.fit(panel, features, estimator)
        assert models.score(alone, panel).collect() == models.score(fitted[name], panel).collect()
