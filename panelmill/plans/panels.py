"""The three panel variants, from raw feeds to featured panel.

``modular``  cleaned feeds, price count, 24 and 168 row statistics, six lags
``flat``     no cleaning, price deviation, 24 row mean and deviation, two lags
``extended`` no cleaning, full price measures, 24 row statistics plus 168 means
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.columns import calendar, flag
from panelmill.operators import features as feat
from panelmill.operators.cleaning import clean_load, clean_price, drop_incomplete, first_in_bucket
from panelmill.operators.rollup import join_feeds, rollup_load, rollup_price
from panelmill.operators.series import BLOCK_ROWS, change, lags, rolling, with_series_columns
from panelmill.runtime import materialize


def processed_panel(
    price: DataFrame, load: DataFrame, *, load_rollup: str = "avg", grain: str = "hour", ts: str = "timestamp"
) -> DataFrame:
    """Clean, roll up, join and add calendar columns (modular variant).

    ``load_rollup="first"`` keeps the earliest load row of a bucket instead of
    the average, together with its time-zone label.
    """
    hourly_price = rollup_price(clean_price(price, ts=ts), stats="count", grain=grain, ts=ts)
    cleaned = clean_load(load, ts=ts)
    if load_rollup == "first":
        hourly_load = first_in_bucket(cleaned, ts=ts, grain=grain).withColumnRenamed("Load", "Load_MW")
        joined = join_feeds(hourly_price, hourly_load, ts=ts, extra=["Time Zone"])
    elif load_rollup == "avg":
        joined = join_feeds(hourly_price, rollup_load(cleaned, grain=grain, ts=ts), ts=ts)
    else:
        raise ValueError(f"unknown load_rollup {load_rollup!r}: expected 'avg' or 'first'")
    return joined.withColumns(calendar(F.col(ts)))


def featured_panel(
    panel: DataFrame,
    *,
    k: float = 3.0,
    grain: str = "hour",
    ts: str = "timestamp",
    entity: str = "Name",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rolling, lag, price, load and label columns; incomplete rows dropped (modular variant)."""
    specs = [
        rolling("LBMP_avg"),
        rolling("Load_MW"),
        lags("LBMP_avg"),
        lags("Load_MW"),
        change("LBMP_avg", 24, "price_momentum_24h"),
        change("Load_MW", 1, "load_change_1h"),
    ]
    wide = with_series_columns(
        materialize(panel, "panel"),
        specs,
        reach=168,
        entity=entity,
        ts=ts,
        ties=["PTID"],
        grain=grain,
        block_rows=block_rows,
    )
    wide = feat.add_spike_labels(feat.add_load_features(feat.add_price_features(wide)), k=k)
    return drop_incomplete(wide)


def flat_panel(
    price: DataFrame, load: DataFrame, *, k: float = 3.0, grain: str = "hour", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Featured panel of the flat variant, keyed by ``hour_timestamp``."""
    out = "hour_timestamp"
    joined = join_feeds(
        rollup_price(price, stats="std", grain=grain, out=out), rollup_load(load, grain=grain, out=out), ts=out
    )
    panel = joined.withColumns(calendar(F.col(out), extras=("peak",)))
    specs = [
        _short_rolling("LBMP_avg", "price", 24, ("ma", "std")),
        _short_rolling("Load_MW", "load", 24, ("ma", "std")),
        _short_lags("LBMP_avg", "price", (1, 24)),
        _short_lags("Load_MW", "load", (1, 24)),
    ]
    wide = with_series_columns(
        materialize(panel, "panel"), specs, reach=24, ts=out, ties=["PTID"], grain=grain, block_rows=block_rows
    )
    return drop_incomplete(_short_derived(wide, k))


def extended_panel(
    price: DataFrame, load: DataFrame, *, k: float = 3.0, grain: str = "hour", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Featured panel of the extended (exploratory) variant, keyed by ``hour_timestamp``.

    The load roll-up is keyed by (bucket, Name, PTID) but joined on (bucket,
    Name): several PTIDs under one name multiply rows, as defined.
    """
    out = "hour_timestamp"
    hourly_load = rollup_load(load, grain=grain, out=out, keys=("Name", "PTID"), zone_label="Time Zone")
    joined = join_feeds(
        rollup_price(price, stats="full", grain=grain, out=out), hourly_load, ts=out, extra=["Time_Zone"]
    )
    panel = joined.withColumns(calendar(F.col(out), extras=("peak", "week")))
    four = ("ma", "std", "min", "max")
    specs = [
        _short_rolling("LBMP_avg", "price", 24, four),
        _short_rolling("LBMP_avg", "price", 168, ("ma",)),
        _short_rolling("Load_MW", "load", 24, four),
        _short_rolling("Load_MW", "load", 168, ("ma",)),
        _short_lags("LBMP_avg", "price", (1, 2, 6, 12, 24)),
        _short_lags("Load_MW", "load", (1, 24)),
        change("LBMP_avg", 1, "price_change_1h"),
        change("Load_MW", 1, "load_change_1h"),
    ]
    wide = with_series_columns(
        materialize(panel, "panel"),
        specs,
        reach=168,
        ts=out,
        ties=["PTID", "Load_MW"],
        grain=grain,
        block_rows=block_rows,
    )
    wide = wide.withColumn("price_deviation", feat.deviation("LBMP_avg", "price_ma_24h", "price_std_24h"))
    return drop_incomplete(_short_derived(wide, k))


def _short_rolling(value: str, prefix: str, n: int, stats: tuple[str, ...]):
    return rolling(value, (n,), stats, name=lambda stat, rows: f"{prefix}_{stat}_{rows}h")


def _short_lags(value: str, prefix: str, steps: tuple[int, ...]):
    return lags(value, steps, name=lambda k: f"{prefix}_lag_{k}h")


def _short_derived(df: DataFrame, k: float) -> DataFrame:
    threshold = feat.spike_threshold("price_ma_24h", "price_std_24h", k)
    return df.withColumns(
        {
            "price_volatility": feat.volatility("price_ma_24h", "price_std_24h"),
            "load_ratio_24h": feat.load_ratio("Load_MW", "load_ma_24h"),
            "congestion_impact": feat.congestion_impact(),
            "is_price_spike": flag(F.col("LBMP_avg") > threshold),
        }
    )
