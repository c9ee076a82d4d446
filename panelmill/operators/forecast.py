"""Recursive multi-step forecasts: one fitted model, fed with its own predictions.

Each origin row carries its last values as an array.  A step rebuilds the lags,
rolling statistics and calendar of the next hour or day from that array, scores
the model, and moves the array on by the prediction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.base import Estimator
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelmill.functions.columns import calendar
from panelmill.operators import models
from panelmill.operators.features import CALENDAR_FEATURES
from panelmill.operators.sampling import split_by_time
from panelmill.operators.series import STATISTICS, Spec, lags, rolling, with_series_columns
from panelmill.runtime import materialize

STEPS = (1, 2, 3, 6, 12, 24)
WINDOWS = (24, 168)
# Steps that run as one plan; behind them the origins are stored.
STEPS_PER_TABLE = 4


def history(value: str, rows: int, name: str) -> Spec:
    """The last ``rows`` values up to the current row, oldest first, nulls included."""

    def build(w: WindowSpec) -> dict[str, Column]:
        kept = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(1 - rows, 0))
        return {name: F.transform(kept, lambda x: x["v"])}

    return build


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(total, F.size(values))


def _deviation(values: Column) -> Column:
    """Sample deviation in two passes, as stable as the window function; NULL for fewer than two values."""
    around = F.transform(F.array(_mean(values)), lambda m: F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)))
    return F.sqrt(F.try_divide(F.get(around, F.lit(0)), F.nullif(F.size(values) - 1, F.lit(0))))


_OF_ARRAY = {"ma": _mean, "std": _deviation, "min": F.array_min, "max": F.array_max}


def next_row_features(
    past: Column, value: str, *, windows: Sequence[int] = WINDOWS, steps: Sequence[int] = STEPS
) -> dict[str, Column]:
    """Lags and rolling statistics of the row behind ``past``, named and computed as the window columns are.

    Rolling statistics skip missing values, lags do not; a lag beyond the array
    is NULL.
    """
    found = {}
    for n in windows:
        last = F.filter(F.slice(past, -F.least(F.size(past), F.lit(n)), F.lit(n)), lambda x: x.isNotNull())
        found |= {f"{value}_{stat}_{n}": _OF_ARRAY[stat](last) for stat in STATISTICS}
    return found | {f"{value}_lag_{k}": F.get(past, F.size(past) - F.lit(k)) for k in steps}


def forecast_features(target: str) -> list[str]:
    """Features of a row that are known before its own hour: calendar, lags and rolling statistics of the target."""
    rolled = [f"{target}_{stat}_{n}" for n in WINDOWS for stat in STATISTICS]
    return [*CALENDAR_FEATURES, *rolled, *[f"{target}_lag_{k}" for k in STEPS]]


def recursive_forecast(
    panel: DataFrame,
    *,
    horizons: int = 24,
    target: str = "Load_MW",
    entity: str = "Name",
    ts: str = "timestamp",
    ties: Sequence[str] = ("PTID",),
    grain: str = "hour",
    train_share: float = 0.8,
    estimator: Estimator | None = None,
    model: PipelineModel | None = None,
) -> DataFrame:
    """Forecasts 1 to ``horizons`` hours (or days) ahead of each row behind the training span.

    One model is fitted to the rows of the training span, whose features and
    labels all lie in it, unless a fitted ``model`` over ``forecast_features``
    is handed in.  Returns ``ts, entity, *ties, horizon, target_time, actual,
    predicted``: ``target_time`` is ``horizon`` hours (days) on, ``actual`` what
    the panel holds there for the same entity and ties, NULL if nothing.

    ``panel`` has one row per (ts, entity, ties).  An origin needs as many values
    as the longest lag asks for; a row with fewer, or with a gap where a lag
    looks, is no origin.
    """
    if grain not in ("hour", "day"):
        raise ValueError(f"unknown grain {grain!r}: expected 'hour' or 'day'")
    keys = [ts, entity, *ties]
    features = forecast_features(target)
    panel = materialize(panel.select(*keys, F.col(target).cast("double").alias(target)), "panel")
    specs = [rolling(target), lags(target), history(target, max(WINDOWS), "_past")]
    wide = with_series_columns(
        panel, specs, reach=max(WINDOWS), entity=entity, ts=ts, ties=ties, grain=grain
    )
    wide = materialize(wide.withColumns(calendar(F.col(ts))), "histories")
    train, test = split_by_time(wide, ts=ts, train_share=train_share)
    if model is None:
        estimator = estimator or models.demand_regressor(label=target, prediction="predicted")
        model = models.fit(train.drop("_past"), features, estimator)
    predicted = model.stages[-1].getPredictionCol()

    origins = test.select(*keys, "_past", F.array().cast("array<double>").alias("_made"))
    origins = origins.where(F.size("_past") >= max(STEPS))
    for step in range(1, horizons + 1):
        origins = _advanced(origins, model, target, predicted, ts, grain, step)
        if step % STEPS_PER_TABLE == 0 or step == horizons:
            origins = materialize(origins, "forecasts")

    made = origins.select(*keys, F.posexplode("_made").alias("_at", "predicted"))
    made = made.select(*keys, (F.col("_at") + 1).alias("horizon"), "predicted")
    made = made.withColumn("target_time", F.col(ts) + _ahead(F.col("horizon"), grain))
    later = panel.select(F.col(ts).alias("target_time"), entity, *ties, F.col(target).alias("actual"))
    measured = [made[c].eqNullSafe(later[c]) for c in ("target_time", entity, *ties)]
    rows = made.join(later, measured, "left")
    return rows.select(*[made[c] for c in (*keys, "horizon", "target_time")], "actual", "predicted")


def _ahead(steps: Column, grain: str) -> Column:
    zero = F.lit(0)
    return F.make_dt_interval(zero, steps) if grain == "hour" else F.make_dt_interval(steps)


def _advanced(
    origins: DataFrame, model: PipelineModel, target: str, predicted: str, ts: str, grain: str, step: int
) -> DataFrame:
    """One more prediction behind ``_made``, and ``_past`` moved on by it."""
    when = F.col(ts) + _ahead(F.lit(step), grain)
    own = origins.columns
    known = origins.withColumns({**next_row_features(F.col("_past"), target), **_calendar_features(when)})
    scored = model.transform(known).withColumn("_next", F.col(predicted))
    moved = F.concat(F.slice("_past", F.greatest(F.size("_past") - max(WINDOWS) + 2, F.lit(1)), max(WINDOWS)), F.array("_next"))
    return scored.withColumns({"_past": moved, "_made": F.concat("_made", F.array("_next"))}).select(*own)


def _calendar_features(when: Column) -> dict[str, Column]:
    return {name: part for name, part in calendar(when).items() if name in CALENDAR_FEATURES}
