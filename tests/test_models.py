from datetime import datetime, timedelta

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import functions as F

from panelmill.operators import metrics, models, sampling
from panelmill.sources import feeds, tables


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i % 24, "AB"[i % 2], float(i % 13), float((i * 5) % 11), int(i % 7 == 0), int(i % 5 == 0), (i * 37 % 50) / 50)
            for i in range(400)]
    return spark.createDataFrame(rows, "hour int, Name string, y double, p double, label int, pred int, score double")


def test_regression_metrics_match_mllib(scored):
    ours = metrics.regression_metrics(scored, "y", "p").first()
    for name in ("rmse", "mae", "r2"):
        theirs = RegressionEvaluator(labelCol="y", predictionCol="p", metricName=name).evaluate(scored)
        assert ours[name] == pytest.approx(theirs, abs=1e-9)


def test_classification_metrics_match_mllib(scored):
    ours = metrics.classification_metrics(scored, "label", "pred").first()
    df = scored.withColumns({"label": F.col("label").cast("double"), "pred": F.col("pred").cast("double")})
    for name, theirs in {
        "accuracy": "accuracy",
        "precision": "weightedPrecision",
        "recall": "weightedRecall",
        "f1": "f1",
    }.items():
        value = MulticlassClassificationEvaluator(labelCol="label", predictionCol="pred", metricName=theirs).evaluate(df)
        assert ours[name] == pytest.approx(value, abs=1e-9)


def test_auc_matches_pair_counting(scored):
    rows = scored.select("label", "score").collect()
    positive = [r.score for r in rows if r.label == 1]
    negative = [r.score for r in rows if r.label == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in positive for b in negative)
    auc = metrics.roc_auc(scored, "label", "score").first().auc_roc
    assert auc == pytest.approx(wins / len(positive) / len(negative), abs=1e-9)


def test_auc_edge_cases(spark):
    def area(rows):
        return metrics.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first().auc_roc

    nan, inf = float("nan"), float("inf")
    assert area([(1, 0.5), (1, 0.7)]) is None and area([(0, 0.5)]) is None
    assert metrics.roc_auc(spark.createDataFrame([], "y int, s double"), "y", "s").first().auc_roc is None
    assert area([(1, 0.5), (0, 0.5)]) == 0.5 and area([(1, 0.0), (0, -0.0)]) == 0.5
    assert area([(1, 2.0), (0, 1.0), (None, 9.0), (0, None)]) == 1.0
    assert area([(1, -1e-300), (0, -1e300), (0, -inf), (1, inf), (0, 5e-324)]) == pytest.approx(5 / 6)
    assert area([(1, nan), (0, inf)]) == 1.0
    close = [(i % 2, 1.0 + i * 2.0**-52) for i in range(100)]
    assert area(close) == pytest.approx(sum(i // 2 + 1 for i in range(1, 100, 2)) / 2500)


def test_auc_is_planned_without_a_job(spark, scored):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("auc-plan", "planning only")
    try:
        plan = metrics.roc_auc(scored, "label", "score")._jdf.queryExecution().executedPlan().toString()
        assert not tracker.getJobIdsForGroup("auc-plan")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "Window" in plan and "CartesianProduct" not in plan and "Python" not in plan


def test_zero_actual_counts_as_zero_percent(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0)], "y double, p double")
    assert metrics.regression_metrics(df, "y", "p").first().mape == 25.0
    empty = metrics.regression_metrics(df.limit(0), "y", "p").first()
    assert (empty.mape, empty.rmse) == (0.0, None)


@pytest.mark.parametrize("group", ["hour", "Name"])
def test_group_errors_weighted_by_count_give_the_total(scored, group):
    rows = metrics.error_by(scored, group, "y", "p").collect()
    total = sum(r["count"] for r in rows)
    assert total == scored.count()
    mean = sum(r.mae * r["count"] for r in rows) / total
    assert mean == pytest.approx(metrics.regression_metrics(scored, "y", "p").first().mae)


def test_history_and_comparison(spark, scored, tmp_path):
    history = metrics.append_history(
        [
            metrics.model_report(scored, "b", "y", "p", 3),
            metrics.model_report(scored, "a", "y", "y", 2),
            metrics.classifier_report(scored, "c", "label", "pred", "score", 4),
        ]
    )
    path = tables.write_history(history, str(tmp_path))
    assert path.split("/")[-1].startswith("results_") and path.endswith(".json")
    back = tables.read_history(spark, path)
    assert back.count() == 3
    ranked = metrics.compare_models(back, "rmse").collect()
    assert [r.model for r in ranked] == ["a", "b"]
    assert [r.model for r in metrics.compare_models(back, "r2", ascending=False).collect()] == ["a", "b"]
    record = back.where("model_name = 'c'").first()
    assert record.metrics.keys() == {"auc_roc", "accuracy", "precision", "recall", "f1", "spike_rate"}
    assert record.data_info == {"test_size": 400, "features": 4}


def test_one_array_history(spark, tmp_path):
    path = tmp_path / "old.json"
    path.write_text('[{"model_name": "m", "metrics": {"rmse": 1.5}, "timestamp": "t", "data_info": {"test_size": 2, "features": 1}}]')
    assert tables.read_history(spark, str(path), one_array=True).first().metrics == {"rmse": 1.5}


def test_splits_are_disjoint_complete_and_stable(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(hours=h), n) for h in range(200) for n in "AB"],
                               "timestamp timestamp_ntz, Name string")
    for split in (
        lambda d: sampling.split_by_hash(d, keys=["timestamp", "Name"]),
        lambda d: sampling.split_by_time(d),
    ):
        train, test = split(df)
        assert train.unionByName(test).exceptAll(df).isEmpty() and train.count() + test.count() == 400
        again, _ = split(df.repartition(7))
        assert again.exceptAll(train).isEmpty() and again.count() == train.count()
    train, test = sampling.split_by_time(df)
    assert train.count() == 320
    assert train.agg(F.max("timestamp")).first()[0] < test.agg(F.min("timestamp")).first()[0]


def test_sample_is_repeatable_and_ordered(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(500)], "i int, Name string")
    pick = [tuple(r) for r in sampling.sample_rows(df, 20, keys=["i", "Name"], order=["i"]).collect()]
    assert pick == sorted(pick) and len(pick) == 20
    assert pick == [tuple(r) for r in sampling.sample_rows(df.repartition(5), 20, keys=["i", "Name"], order=["i"]).collect()]
    assert sampling.sample_rows(df, 9999, keys=["i"], order=["i"]).count() == 500


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(datetime(2024, 1, 1) + timedelta(hours=i), "A", float(i % 24), float((i % 24) * 3 + i % 2), int(i % 24 > 20))
            for i in range(300)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, Name string, hour double, Load_MW double, is_price_spike int")


def test_fit_score_save_load(spark, panel, tmp_path):
    estimator = models.spike_classifier(trees=5, depth=3)
    model = models.fit(panel, ["hour", "Load_MW"], estimator)
    scored = models.score(model, panel)
    assert {"predicted_spike", "spike_probability"} <= set(scored.columns) and "features" not in scored.columns
    models.save_model(model, str(tmp_path / "m"))
    back = models.score(models.load_model(str(tmp_path / "m")), panel)
    assert scored.select("predicted_spike").collect() == back.select("predicted_spike").collect()
    importance = models.feature_importance(panel, model, ["hour", "Load_MW"])
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert models.top_features(importance, 1).count() == 1


def test_same_seed_same_predictions(panel):
    fit = lambda: models.score(
        models.fit(panel, ["hour"], models.demand_regressor(depth=3, rounds=3)), panel
    ).select("predicted_demand").collect()
    assert fit() == fit()


def test_untrained_models_are_refused(panel):
    with pytest.raises(ValueError):
        models.score(None, panel)
    with pytest.raises(ValueError):
        models.save_model(None, "nowhere")


def test_default_hyper_parameters():
    price, spike = models.price_regressor(), models.spike_classifier()
    assert (price.getMaxDepth(), price.getMaxIter(), price.getStepSize(), price.getSeed()) == (8, 100, 0.1, 42)
    assert (spike.getNumTrees(), spike.getMaxDepth(), spike.getLabelCol()) == (100, 10, "is_price_spike")
    assert models.demand_regressor().getPredictionCol() == "predicted_demand"


def test_intervals(spark):
    df = spark.createDataFrame([(100.0,)], "predicted_price double")
    assert tuple(models.with_interval(df).first()) == pytest.approx((100.0, 60.8, 139.2))
    assert tuple(models.with_interval(df, confidence=0.9).first()) == pytest.approx((100.0, 67.1, 132.9))


def test_standardize_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = models.standardize(df, ["a", "b"]).orderBy("a").collect()
    assert [r.b_scaled for r in rows] == [0.0, 0.0]
    assert rows[1].a_scaled == pytest.approx(2**-0.5)


def test_forecast_horizon(panel):
    out = models.forecast_horizon(panel, ["hour", "Load_MW"], horizons=(1, 3), depth=3, rounds=3)
    assert out.groupBy("horizon").count().count() == 2
    assert out.where("actual IS NULL").count() == 4
    first = out.where("horizon = 3").orderBy("timestamp").first()
    want = panel.where(F.col("timestamp") == first.timestamp + timedelta(hours=3)).first().Load_MW
    assert first.actual == want


def test_csv_round_trip_and_missing_files(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 5, 10, 3), "A.B.C.", 61761, 1.5, 0.1, -0.2), (None, "NORTH EAST", 61758, None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp_ntz, Name string, PTID int, LBMP double, Marginal_Cost_Losses double, Marginal_Cost_Congestion double")
    feeds.write_feed(df, str(tmp_path / "20240101realtime_zone_csv"),
                     ["Name", "PTID", "LBMP", "Marginal_Cost_Losses", "Marginal_Cost_Congestion"])
    back = feeds.read_price_feed(spark, str(tmp_path))
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    assert back.where("timestamp IS NULL").first()["Time Stamp"] == "bad"
    header = spark.read.csv(str(tmp_path / "20240101realtime_zone_csv"), header=True)
    assert "LBMP ($/MWHr)" in header.columns
    assert "Marginal_Cost_Congestion" in feeds.rename_vendor_columns(header).columns
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        feeds.read_load_feed(spark, str(tmp_path))


def test_partitioned_panel_prunes(spark, tmp_path):
    df = spark.createDataFrame([(2024, m, "A", float(m)) for m in (1, 2, 3)], "year int, month int, Name string, v double")
    tables.write_panel(df, str(tmp_path / "p"))
    back = tables.read_table(spark, str(tmp_path / "p")).where("month = 2")
    assert back.count() == 1
    assert "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().toString()


def test_calibrated_intervals_cover_fresh_rows(spark):
    rows = [(name, float(i), float(i) + ((i * 37) % 101 - 50) * scale) for name, scale in (("calm", 0.1), ("wild", 3.0)) for i in range(505)]
    df = spark.createDataFrame(rows, "Name string, y double, predicted_price double")
    few = spark.createDataFrame([("few", 1.0, 2.0)] * 5 + [("few", None, 2.0)], df.schema)
    held, fresh = df.where("y % 2 = 0").unionByName(few), df.where("y % 2 = 1").unionByName(few)
    widths = models.calibrated_half_widths(held, "y", "predicted_price", by="Name", confidence=0.9)
    got = {r.Name: r.half_width for r in widths.collect()}
    for name, scale in (("calm", 0.1), ("wild", 3.0)):
        errors = sorted(abs((i * 37) % 101 - 50) * scale for i in range(0, 505, 2))
        assert got[name] == pytest.approx(errors[-(-254 * 9 // 10) - 1])
    assert got["few"] is None
    out = models.with_calibrated_interval(fresh, widths, by="Name")
    inside = F.col("y").between(F.col("price_lower"), F.col("price_upper"))
    shares = {r.Name: r.s for r in out.where("y IS NOT NULL").groupBy("Name").agg(F.avg(inside.cast("int")).alias("s")).collect()}
    assert shares["few"] == 1.0 and all(s >= 0.88 for s in shares.values())
