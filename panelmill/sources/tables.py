"""Parquet panels and JSON evaluation history."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

HISTORY_SCHEMA = (
    "model_name string, metrics map<string,double>, timestamp string, data_info map<string,bigint>"
)

# Columns of the combined predictions table.
PREDICTION_COLUMNS = [
    "LBMP_avg",
    "predicted_price",
    "Load_MW",
    "predicted_load",
    "is_price_spike",
    "predicted_spike",
    "hour",
    "day_of_week",
    "month",
    "is_weekend",
    "price_ma_24h",
    "load_ma_24h",
    "Marginal_Cost_Congestion_avg",
]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_panel(df: DataFrame, path: str, *, partition_by: Sequence[str] = ("year", "month")) -> None:
    """Overwrite a Parquet panel, partitioned so that readers prune by calendar.

    Rows are first hashed by partition value and entity: that bounds the number
    of files per calendar partition by the entities, without sending a whole
    month through one task.
    """
    spread = [c for c in (*partition_by, "Name") if c in df.columns]
    df.repartition(*spread).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_predictions(df: DataFrame, path: str, *, ts: str = "hour_timestamp", entity: str = "Name") -> None:
    """Overwrite the combined predictions table from the executors."""
    df.select(ts, entity, *PREDICTION_COLUMNS).write.mode("overwrite").parquet(path)


def write_history(history: DataFrame, folder: str, name: str | None = None) -> str:
    """Overwrite an evaluation history as JSON, one record per line; returns its path.

    The default name is ``results_{yyyymmdd_hhmmss}.json``.
    """
    path = f"{folder}/{name or datetime.now().strftime('results_%Y%m%d_%H%M%S.json')}"
    history.write.mode("overwrite").json(path)
    return path


def read_history(spark: SparkSession, path: str, *, one_array: bool = False) -> DataFrame:
    """Read an evaluation history; ``one_array`` for a file holding a single JSON array."""
    return spark.read.schema(HISTORY_SCHEMA).json(path, multiLine=one_array)
