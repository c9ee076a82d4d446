"""Feature assembly, tree models and forecasts on MLlib."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from contextvars import copy_context
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.base import Estimator
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.quantiles import exact_percentiles
from panelmill.operators.sampling import split_by_time
from panelmill.operators.series import lags, with_series_columns
from panelmill.runtime import attach, materialize, shared_dir

# Hyper-parameters, seed, and the half-width parts of the interval.
SEED = 42
PRICE_MODEL = {"label": "LBMP_avg", "prediction": "predicted_price", "depth": 8, "rounds": 100, "step": 0.1}
DEMAND_MODEL = {"label": "Load_MW", "prediction": "predicted_demand", "depth": 8, "rounds": 100, "step": 0.1}
SPIKE_MODEL = {"label": "is_price_spike", "prediction": "predicted_spike", "depth": 10, "trees": 100}
Z_95, Z_OTHER, BASE_ERROR = 1.96, 1.645, 20.0
# Fits that run at once: each keeps the cluster busy only between its jobs, one per tree level.
FITS_AT_ONCE = 4

T = TypeVar("T")


def assembler(features: Sequence[str], output: str = "features_raw") -> VectorAssembler:
    """Columns to one vector; rows with a null or NaN feature are skipped."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid="skip")


def feature_stages(features: Sequence[str]) -> list:
    scaler = StandardScaler(inputCol="features_raw", outputCol="features", withStd=True, withMean=True)
    return [assembler(features), scaler]


def boosted_regressor(
    label: str, prediction: str, *, depth: int = 8, rounds: int = 100, step: float = 0.1
) -> GBTRegressor:
    return GBTRegressor(
        labelCol=label,
        featuresCol="features",
        predictionCol=prediction,
        maxDepth=depth,
        maxIter=rounds,
        stepSize=step,
        seed=SEED,
    )


def price_regressor(**overrides: object) -> GBTRegressor:
    return boosted_regressor(**{**PRICE_MODEL, **overrides})


def demand_regressor(**overrides: object) -> GBTRegressor:
    return boosted_regressor(**{**DEMAND_MODEL, **overrides})


def spike_classifier(**overrides: object) -> RandomForestClassifier:
    p = {**SPIKE_MODEL, **overrides}
    return RandomForestClassifier(
        labelCol=p["label"],
        featuresCol="features",
        predictionCol=p["prediction"],
        probabilityCol="spike_probability",
        maxDepth=p["depth"],
        numTrees=p["trees"],
        seed=SEED,
    )


def fit(train: DataFrame, features: Sequence[str], estimator: Estimator) -> PipelineModel:
    """Fit assembler, scaler and estimator on the needed columns, cached for the iterations.

    The shared checkpoint folder is set up first: boosting checkpoints its node
    assignments there every few rounds, which keeps lineage short.  Rows that
    come with their assembled vector (``features_raw``) are not assembled again.
    """
    shared_dir(train.sparkSession)
    label = estimator.getLabelCol()
    stages = feature_stages(features)
    if "features_raw" in train.columns:
        features, stages = ["features_raw"], stages[1:]
    columns = list(dict.fromkeys([*features, label]))
    cached = train.select(*columns).cache()
    try:
        return Pipeline(stages=[*stages, estimator]).fit(cached)
    finally:
        cached.unpersist()


def run_together(
    spark: SparkSession, work: Mapping[str, Callable[[], T]], *, at_once: int = FITS_AT_ONCE
) -> dict[str, T]:
    """Results of independent pieces of work, run from several threads.

    Threads inherit the caller's local properties (job group, tags); each piece
    has a scheduler pool of its own name, so that under ``spark.scheduler.mode``
    FAIR none waits for all jobs of another.  The first error is raised once the
    others have ended.
    """
    context = spark.sparkContext

    def pooled(name: str) -> T:
        context.setLocalProperty("spark.scheduler.pool", name)
        try:
            return work[name]()
        finally:
            context.setLocalProperty("spark.scheduler.pool", None)

    if not work:
        return {}
    # Each piece gets a copy of the local properties and of the scope of its own.
    pieces = [partial(copy_context().run, inheritable_thread_target(spark)(partial(pooled, name))) for name in work]
    with ThreadPool(min(at_once, len(pieces))) as threads:
        return dict(zip(work, threads.map(lambda piece: piece(), pieces, chunksize=1), strict=True))


def fit_together(
    train: DataFrame, jobs: Mapping[str, tuple[Sequence[str], Estimator]], *, at_once: int = FITS_AT_ONCE
) -> dict[str, PipelineModel]:
    """One fitted model per name in ``jobs`` (features, estimator), several at once over one stored table."""
    columns = [c for features, estimator in jobs.values() for c in (*features, estimator.getLabelCol())]
    shared = materialize(train.select(*dict.fromkeys(columns)), "training")
    work = {name: lambda f=features, e=estimator: fit(shared, f, e) for name, (features, estimator) in jobs.items()}
    return run_together(train.sparkSession, work, at_once=at_once)


def score(model: PipelineModel | None, df: DataFrame) -> DataFrame:
    """Predictions next to the input columns, without the intermediate vectors."""
    if model is None:
        raise ValueError("no trained model: call fit first")
    return model.transform(df).drop("features_raw", "features")


def score_all(models: Sequence[PipelineModel], df: DataFrame) -> DataFrame:
    """Several models over one frame: each adds its columns, no join is needed."""
    for model in models:
        df = score(model, df).drop("rawPrediction")
    return df


def save_model(model: PipelineModel | None, path: str) -> None:
    if model is None:
        raise ValueError("no trained model to save: call fit first")
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importance(df: DataFrame, model: PipelineModel, features: Sequence[str]) -> DataFrame | None:
    """Rows (feature, importance), or None for a model without importances."""
    weights = getattr(model.stages[-1], "featureImportances", None)
    if weights is None:
        return None
    rows = [(name, float(w)) for name, w in zip(features, weights.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / sample deviation per column; 0 for a constant column.

    The moments come from one scalar subquery shared by all columns.
    """
    moments = df.select(
        F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev(c).alias("std")).alias(c) for c in columns]).alias("m")
    ).scalar()

    def scaled(c: str):
        mean, std = moments.getField(c).getField("mean"), moments.getField(c).getField("std")
        return F.when(std != 0, (F.col(c) - mean) / std).otherwise(F.lit(0.0))

    return df.withColumns({f"{c}_scaled": scaled(c) for c in columns})


def with_interval(
    df: DataFrame,
    *,
    predicted: str = "predicted_price",
    prefix: str = "price",
    confidence: float = 0.95,
    base_error: float = BASE_ERROR,
) -> DataFrame:
    """Lower and upper bound at a fixed half-width; hand in a validation RMSE to calibrate it."""
    half = (Z_95 if confidence == 0.95 else Z_OTHER) * base_error
    return df.withColumns(
        {f"{prefix}_lower": F.col(predicted) - F.lit(half), f"{prefix}_upper": F.col(predicted) + F.lit(half)}
    )


def calibrated_half_widths(
    held: DataFrame, actual: str, predicted: str, *, by: str, confidence: float = 0.95
) -> DataFrame:
    """``by, half_width``: split-conformal interval half-widths from rows that the model was not fitted to.

    The k-th smallest absolute error of a group's n rows, k the whole number
    from ``(n + 1) * confidence`` up: a fresh row of the group is covered with at
    least that chance.  NULL, that is unbounded, for a group with too few rows.
    Rows without both sides are left out.
    """
    error = F.abs(F.col(actual) - F.col(predicted))
    # Whole millionths, so that a product such as 19 * 0.9 is not rounded up to the next rank.
    share, ones = F.lit(round(confidence * 1_000_000)), F.lit(1_000_000)
    place = lambda n: F.ceil((n + 1) * share / ones) - 1
    found = exact_percentiles(
        held.select(by, error.alias("_error")),
        [by],
        "_error",
        {"half_width": lambda n: F.least(place(n), n - 1)},
        alongside={"_rows": F.count("_error")},
    )
    enough = place(F.col("_rows")) < F.col("_rows")
    return found.select(by, F.when(enough, F.col("half_width")).alias("half_width"))


def with_calibrated_interval(
    df: DataFrame, half_widths: DataFrame, *, by: str, predicted: str = "predicted_price", prefix: str = "price"
) -> DataFrame:
    """Bounds at each group's half-width; an unbounded or unknown one gives infinite bounds."""
    out = attach(df, half_widths, [by], "left")
    half = F.coalesce("half_width", F.lit(float("inf")))
    return out.withColumns({f"{prefix}_lower": F.col(predicted) - half, f"{prefix}_upper": F.col(predicted) + half})


def forecast_horizon(
    panel: DataFrame,
    features: Sequence[str],
    *,
    horizons: Sequence[int] = tuple(range(1, 25)),
    target: str = "Load_MW",
    entity: str = "Name",
    ts: str = "timestamp",
    ties: Sequence[str] = (),
    grain: str = "hour",
    train_share: float = 0.8,
    at_once: int = FITS_AT_ONCE,
    **hyper: object,
) -> DataFrame:
    """Direct multi-step forecasts: one model per horizon, trained on the value h rows ahead.

    Returns (ts, entity, horizon, actual, predicted) for the rows after the
    training span; ``actual`` is NULL where the future is not in the panel.  A
    row is trained on only if its label lies in the training span, too.  The
    features are assembled and stored once for all horizons; ``at_once`` of them
    are fitted at the same time.  Rows of equal ``ts`` need ``ties`` to have an
    order.  ``forecast.recursive_forecast`` does with one model.
    """
    panel = materialize(panel, "panel")
    ahead = lags(target, horizons, name=lambda h: f"_ahead_{h}")
    when = lags(ts, horizons, name=lambda h: f"_when_{h}")
    labelled = with_series_columns(
        panel, [ahead, when], reach=max(horizons), entity=entity, ts=ts, ties=ties, grain=grain, backwards=True
    )
    train, test = split_by_time(materialize(labelled, "horizons"), ts=ts, train_share=train_share)
    last = train.agg(F.max(ts)).scalar()
    train, test = (materialize(assembler(features).transform(part), "assembled") for part in (train, test))

    def one(h: int) -> DataFrame:
        label = f"_ahead_{h}"
        known = F.col(label).isNotNull() & (F.col(f"_when_{h}") <= last)
        estimator = demand_regressor(label=label, prediction="predicted", **hyper)
        scored = score(fit(train.where(known), features, estimator), test)
        return scored.select(ts, entity, F.lit(h).alias("horizon"), F.col(label).alias("actual"), "predicted")

    work = {f"horizon-{h}": lambda h=h: one(h) for h in horizons}
    parts = list(run_together(panel.sparkSession, work, at_once=at_once).values())
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
