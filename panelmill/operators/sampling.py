"""Deterministic previews, samples and train/test splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.columns import hash_share, key_token


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in key order (a top-n, never a full sort)."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, *, keys: Sequence[str], order: Sequence[str], seed: int = 42) -> DataFrame:
    """A fixed-size random-looking sample, in time order.

    Chosen by a hash of the keys, so it repeats for the same rows whatever the
    partitioning.  Each task keeps n candidates, the merge keeps n.
    """
    ranked = df.withColumn("_draw", F.md5(key_token(keys, seed)))
    return ranked.orderBy("_draw", *keys).limit(n).drop("_draw").orderBy(*order)


def split_by_hash(
    df: DataFrame, *, keys: Sequence[str], train_share: float = 0.8, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Disjoint, complete split decided per row by its keys."""
    held_in = hash_share(keys, seed) < round(train_share * 100)
    return df.where(held_in), df.where(~held_in)


def split_by_time(
    df: DataFrame, *, ts: str = "timestamp", train_share: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """Split at the point where ``train_share`` of the covered time has passed.

    Keeps neighbours of a test row out of training, which a row-wise split of a
    time series does not.  The cut is a scalar subquery over min and max.
    """
    day_number = F.unix_date(F.to_date(ts)) * 24 + F.hour(ts)
    stamped = df.withColumn("_hours", day_number)
    first, last = F.min("_hours"), F.max("_hours")
    cut = stamped.select((first + F.floor((last - first + 1) * train_share)).alias("cut")).scalar()
    before = F.col("_hours") < cut
    return stamped.where(before).drop("_hours"), stamped.where(~before).drop("_hours")
