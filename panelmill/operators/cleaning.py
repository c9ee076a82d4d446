"""Filters, fills, flags and deduplication on the raw feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.columns import bucket

# Plausible price range in $/MWh.
PRICE_FLOOR, PRICE_CEILING = -500.0, 2000.0

PRICE_MEASURES = ("LBMP", "Marginal_Cost_Losses", "Marginal_Cost_Congestion")


def clean_price(
    df: DataFrame,
    *,
    ts: str = "timestamp",
    measures: Sequence[str] = PRICE_MEASURES,
    floor: float = PRICE_FLOOR,
    ceiling: float = PRICE_CEILING,
) -> DataFrame:
    """Drop rows without a timestamp, fill missing measures with 0, flag extreme prices.

    Extreme rows are flagged, not removed.  The first measure is the price.
    """
    price = F.col(measures[0])
    outside = (price < floor) | (price > ceiling)
    return (
        df.where(F.col(ts).isNotNull())
        .fillna(0.0, subset=list(measures))
        .withColumn("is_extreme_price", F.coalesce(outside, F.lit(False)))
    )


def clean_load(df: DataFrame, *, ts: str = "timestamp", load: str = "Load") -> DataFrame:
    """Drop rows without a timestamp, fill missing load with 0, flag negative load."""
    return (
        df.where(F.col(ts).isNotNull())
        .fillna(0.0, subset=[load])
        .withColumn("is_negative_load", F.coalesce(F.col(load) < 0, F.lit(False)))
    )


def first_in_bucket(
    df: DataFrame,
    *,
    ts: str = "timestamp",
    entity: str = "Name",
    grain: str = "hour",
    carry: Sequence[str] = ("PTID", "Load", "Time Zone"),
) -> DataFrame:
    """One row per (bucket, entity): the earliest, ties broken by the carried columns.

    Written as the minimum of a struct, which combines before the shuffle; a
    ranking window would ship every raw row of a hot bucket to one task.
    """
    earliest = F.min(F.struct(F.col(ts), *[F.col(f"`{c}`") for c in carry])).alias("pick")
    picked = df.groupBy(bucket(F.col(ts), grain).alias("slot"), F.col(entity)).agg(earliest)
    kept = [F.col("pick").getField(c).alias(c) for c in carry]
    return picked.select(F.col("slot").alias(ts), entity, *kept)


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any column (or in any of ``subset``)."""
    return df.na.drop(how="any", subset=list(subset) if subset else None)


def keep(df: DataFrame, **equal: object) -> DataFrame:
    """Equality filters; an argument that is None filters nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df
