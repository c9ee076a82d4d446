"""Training the price, demand and spike models together and scoring them in one frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from panelmill.operators import metrics, models
from panelmill.runtime import materialize


def fit_models(
    train: DataFrame,
    features: Mapping[str, Sequence[str]],
    *,
    boost: Mapping[str, object] | None = None,
    forest: Mapping[str, object] | None = None,
) -> dict[str, PipelineModel]:
    """One fitted model per target in ``features`` (price, demand, spike), all fitted at once over one stored table.

    ``boost`` and ``forest`` override the default hyper-parameters.  The demand
    column is named ``predicted_load``, as in the combined predictions table.
    """
    boost, forest = dict(boost or {}), dict(forest or {})
    estimators = {
        "price": lambda: models.price_regressor(**boost),
        "demand": lambda: models.demand_regressor(prediction="predicted_load", **boost),
        "spike": lambda: models.spike_classifier(**forest),
    }
    jobs = {target: (names, estimators[target]()) for target, names in features.items()}
    return models.fit_together(train, jobs)


def predictions_table(fitted: Mapping[str, PipelineModel], df: DataFrame) -> DataFrame:
    """All predictions next to the panel columns; each model adds its own, so nothing is joined."""
    return models.score_all(list(fitted.values()), df)


def evaluate_models(
    fitted: Mapping[str, PipelineModel], test: DataFrame, features: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Evaluation history of the fitted models: one record per target, in the order of ``fitted``.

    The test rows are scored once by all models and stored; every record reads that table.
    """
    measured = ["LBMP_avg", "Load_MW", "is_price_spike"]
    predicted = ["predicted_price", "predicted_load", "predicted_spike", "spike_probability"]
    table = predictions_table(fitted, test)
    table = materialize(table.select(*[c for c in (*measured, *predicted) if c in table.columns]), "predictions")
    sizes = {target: len(names) for target, names in features.items()}
    reports = {
        "price": lambda: metrics.model_report(
            table, "price_predictor", "LBMP_avg", "predicted_price", sizes["price"]
        ),
        "demand": lambda: metrics.model_report(
            table, "demand_forecaster", "Load_MW", "predicted_load", sizes["demand"]
        ),
        "spike": lambda: metrics.classifier_report(
            table, "spike_detector", "is_price_spike", "predicted_spike", "spike_probability", sizes["spike"]
        ),
    }
    return metrics.append_history([reports[target]() for target in fitted])
