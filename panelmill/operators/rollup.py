"""Roll-ups to a common grain and the joins between feeds.

All aggregates here combine before the shuffle, so a hot entity costs its
number of buckets, not its number of raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.functions.columns import bucket

COMPONENTS = ("Marginal_Cost_Losses", "Marginal_Cost_Congestion")


def rollup_price(
    df: DataFrame,
    *,
    stats: str = "count",
    grain: str = "hour",
    ts: str = "timestamp",
    out: str | None = None,
    keys: Sequence[str] = ("Name", "PTID"),
    price: str = "LBMP",
    components: Sequence[str] = COMPONENTS,
) -> DataFrame:
    """Average price and components per bucket and key.

    ``stats`` picks the measures beside the averages: ``count`` (number of
    readings), ``std`` (sample deviation) or ``full`` (min, max, deviation, count).
    """
    spread = F.stddev(price).alias(f"{price}_std")
    extras = {
        "count": [F.count(F.lit(1)).alias("price_count")],
        "std": [spread],
        "full": [
            F.min(price).alias(f"{price}_min"),
            F.max(price).alias(f"{price}_max"),
            spread,
            F.count(F.lit(1)).alias("price_readings"),
        ],
    }[stats]
    averages = [F.avg(c).alias(f"{c}_avg") for c in (price, *components)]
    slot = bucket(F.col(ts), grain).alias(out or ts)
    return df.groupBy(slot, *keys).agg(*averages, *extras)


def rollup_load(
    df: DataFrame,
    *,
    grain: str = "hour",
    ts: str = "timestamp",
    out: str | None = None,
    keys: Sequence[str] = ("Name",),
    load: str = "Load",
    zone_label: str | None = None,
) -> DataFrame:
    """Average load per bucket and key, optionally with the earliest time-zone label.

    With a label, raw rows are first grouped by it as well, with fixed-width
    measures only, so they are hashed and not sorted; what is compared as
    (timestamp, label) is one row per label of a bucket.  Of labels at the same
    earliest timestamp a null is first, then the smallest.
    """
    slot = bucket(F.col(ts), grain).alias(out or ts)
    if not zone_label:
        return df.groupBy(slot, *keys).agg(F.avg(load).alias("Load_MW"))
    by_label = df.groupBy(slot, *keys, F.col(_quoted(zone_label)).alias("_label")).agg(
        F.min(ts).alias("_first"), F.sum(F.col(load).cast("double")).alias("_sum"), F.count(load).alias("_count")
    )
    earliest = F.min(F.struct("_first", "_label")).getField("_label")
    mean = F.try_divide(F.sum("_sum"), F.sum("_count"))
    return by_label.groupBy(out or ts, *keys).agg(mean.alias("Load_MW"), earliest.alias("Time_Zone"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def join_feeds(
    price: DataFrame, load: DataFrame, *, ts: str = "timestamp", entity: str = "Name", extra: Sequence[str] = ()
) -> DataFrame:
    """Inner join of both roll-ups on (bucket, entity).

    Only the load columns that survive are projected, so no duplicate key column
    ever exists.  No broadcast hint: both sides grow with the data, and the join
    keys spread a hot entity over its buckets.
    """
    return price.join(load.select(ts, entity, "Load_MW", *[F.col(f"`{c}`") for c in extra]), [ts, entity], "inner")


def join_predictions(
    price: DataFrame,
    demand: DataFrame,
    spike: DataFrame,
    *,
    ts: str = "timestamp",
    entity: str = "Name",
    demand_col: str = "predicted_load",
    spike_col: str = "predicted_spike",
) -> DataFrame:
    """Price predictions with the demand and spike predictions of the same (bucket, entity)."""
    keys = [ts, entity]
    return price.join(demand.select(*keys, demand_col), keys).join(spike.select(*keys, spike_col), keys)
