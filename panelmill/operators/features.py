"""Ratios, deviations, labels and named feature sets on top of the window columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.functions.columns import flag, ratio_or


def volatility(mean: str, std: str) -> Column:
    """Rolling deviation relative to the rolling mean; 0 for a zero mean."""
    return ratio_or(F.col(std), F.abs(F.col(mean)), 0)


def congestion_impact(congestion: str = "Marginal_Cost_Congestion_avg", price: str = "LBMP_avg") -> Column:
    """Congestion part of the price in absolute terms; 0 for a zero price."""
    return ratio_or(F.abs(F.col(congestion)), F.abs(F.col(price)), 0)


def deviation(value: str, mean: str, std: str) -> Column:
    """Distance from the rolling mean in rolling deviations; 0 for a zero deviation."""
    return ratio_or(F.col(value) - F.col(mean), F.col(std), 0)


def load_ratio(load: str, mean: str) -> Column:
    """Load relative to its rolling mean; 1 for a zero mean."""
    return ratio_or(F.col(load), F.col(mean), 1)


def peak_load(load: str, mean: str, std: str) -> Column:
    """1 where load exceeds its rolling mean by more than one rolling deviation."""
    return flag(F.col(load) > F.col(mean) + F.col(std))


def spike_threshold(mean: str, std: str, k: float = 3.0) -> Column:
    return F.col(mean) + F.lit(float(k)) * F.col(std)


def spike_cause(
    spike: str = "is_price_spike",
    congestion: str = "Marginal_Cost_Congestion_avg",
    price: str = "LBMP_avg",
    peak: str = "is_peak_load",
    share: float = 0.5,
) -> Column:
    """Why a row is a spike: congestion before high demand before other; none otherwise."""
    congested = F.abs(F.col(congestion)) > F.abs(F.col(price)) * share
    return (
        F.when(F.coalesce(F.col(spike) != 1, F.lit(True)), "none")
        .when(congested, "congestion")
        .when(F.col(peak) == 1, "high_demand")
        .otherwise("other")
    )


def add_price_features(df: DataFrame, price: str = "LBMP_avg") -> DataFrame:
    mean, std = f"{price}_ma_24", f"{price}_std_24"
    return df.withColumns(
        {
            "price_volatility_ratio": volatility(mean, std),
            "congestion_impact": congestion_impact(price=price),
            "price_deviation_24h": deviation(price, mean, std),
        }
    )


def add_load_features(df: DataFrame, load: str = "Load_MW") -> DataFrame:
    mean, std = f"{load}_ma_24", f"{load}_std_24"
    return df.withColumns({"load_ratio_24h": load_ratio(load, mean), "is_peak_load": peak_load(load, mean, std)})


def add_spike_labels(
    df: DataFrame, *, k: float = 3.0, price: str = "LBMP_avg", mean: str | None = None, std: str | None = None
) -> DataFrame:
    """Threshold, 0/1 label (strictly above it) and cause; needs ``is_peak_load``."""
    threshold = spike_threshold(mean or f"{price}_ma_24", std or f"{price}_std_24", k)
    return (
        df.withColumn("spike_threshold", threshold)
        .withColumn("is_price_spike", flag(F.col(price) > F.col("spike_threshold")))
        .withColumn("spike_cause", spike_cause(price=price))
    )


# Column names of the feature sets.
CALENDAR_FEATURES = [
    "hour",
    "day_of_week",
    "day_of_month",
    "month",
    "is_weekend",
    "hour_sin",
    "hour_cos",
    "month_sin",
    "month_cos",
]
ENGINEERED_FEATURES = [
    "price_momentum_24h",
    "price_volatility_ratio",
    "congestion_impact",
    "price_deviation_24h",
    "load_change_1h",
    "load_ratio_24h",
    "is_peak_load",
]
GRID_FEATURES = ["Marginal_Cost_Losses_avg", "Marginal_Cost_Congestion_avg"]

# The value the target must not be rebuilt from, per target: these columns are
# computed from the row's own target (momentum + lag gives the price back).
LEAKS = {
    "price": {"price_momentum_24h", "congestion_impact", "price_deviation_24h"},
    "demand": {"load_change_1h", "load_ratio_24h", "is_peak_load"},
    "spike": {"price_momentum_24h", "congestion_impact", "price_deviation_24h"},
}
COMPANION = {"price": ["Load_MW"], "demand": ["LBMP_avg"], "spike": ["Load_MW"]}

# The shorter feature sets of the flat variant.
FLAT_SHARED = ["hour", "day_of_week", "month", "is_weekend", "is_peak_hour"]
FLAT_CYCLES = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
FLAT_FEATURES = {
    "price": [
        *FLAT_SHARED,
        *FLAT_CYCLES,
        "Load_MW",
        "load_ma_24h",
        "price_lag_1h",
        "price_lag_24h",
        "price_ma_24h",
        "Marginal_Cost_Losses_avg",
        "Marginal_Cost_Congestion_avg",
    ],
    "demand": [
        *FLAT_SHARED,
        *FLAT_CYCLES,
        "LBMP_avg",
        "price_ma_24h",
        "load_lag_1h",
        "load_lag_24h",
        "load_ma_24h",
        "Marginal_Cost_Congestion_avg",
    ],
    "spike": [
        *FLAT_SHARED,
        "Load_MW",
        "load_ma_24h",
        "load_ratio_24h",
        "price_lag_1h",
        "price_ma_24h",
        "price_volatility",
        "congestion_impact",
    ],
}
EXTENDED_PRICE_FEATURES = [
    *FLAT_SHARED,
    *FLAT_CYCLES,
    "Load_MW",
    "load_ma_24h",
    "load_std_24h",
    "load_ratio_24h",
    "price_lag_1h",
    "price_lag_24h",
    "price_ma_24h",
    "price_std_24h",
    "Marginal_Cost_Losses_avg",
    "Marginal_Cost_Congestion_avg",
    "price_volatility",
    "congestion_impact",
]


def feature_columns(target: str = "price", *, leak_free: bool = False) -> list[str]:
    """Feature names for a target: 43 for price, demand and spike, 42 otherwise.

    The full sets contain columns from which the target can be rebuilt;
    ``leak_free=True`` leaves those out.
    """
    rolled = []
    for value in ("LBMP_avg", "Load_MW"):
        rolled += [f"{value}_{stat}_24" for stat in ("ma", "std", "min", "max")]
        rolled += [f"{value}_{stat}_168" for stat in ("ma", "std")]
    lagged = [f"{value}_lag_{k}" for value in ("LBMP_avg", "Load_MW") for k in (1, 2, 3, 6, 12, 24)]
    names = CALENDAR_FEATURES + rolled + lagged + ENGINEERED_FEATURES + GRID_FEATURES + COMPANION.get(target, [])
    if leak_free:
        names = [n for n in names if n not in LEAKS.get(target, ())]
    return names


def project_features(df: DataFrame, features: Sequence[str], *keys: str) -> DataFrame:
    """Keys and features only."""
    return df.select(*keys, *[c for c in features if c not in keys])
