"""Summaries, pivots, histograms, correlations and SQL reports over feeds and panels."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.quantiles import exact_percentiles

PRICE, LOAD, ENTITY = "LBMP_avg", "Load_MW", "Name"


# --- reports on the raw feeds -------------------------------------------------


def register_feeds(price: DataFrame, load: DataFrame) -> None:
    """Expose both feeds to SQL text as ``prices`` and ``loads``."""
    price.createOrReplaceTempView("prices")
    load.createOrReplaceTempView("loads")


def price_stats(spark: SparkSession) -> DataFrame:
    """Per-zone price statistics of the ``prices`` view, highest average first.

    The median is exact, but found by counting ranks: SQL ``percentile`` would
    hold all values of a zone in one buffer.  The plain statistics ride along
    with its first pass.
    """
    plain = {
        "Records": F.count(F.lit(1)),
        "Avg_Price": F.round(F.avg("LBMP"), 2),
        "Min_Price": F.round(F.min("LBMP"), 2),
        "Max_Price": F.round(F.max("LBMP"), 2),
        "Std_Dev": F.round(F.stddev("LBMP"), 2),
    }
    zones = exact_percentiles(spark.table("prices"), ["Name"], "LBMP", {"median": 0.5}, alongside=plain)
    return zones.select(
        F.col("Name").alias("Zone"), *plain, F.round("median", 2).alias("Median_Price")
    ).orderBy(F.desc("Avg_Price"), "Zone")


def load_stats(spark: SparkSession) -> DataFrame:
    """Per-zone statistics of the ``loads`` view, highest average first."""
    measures = {"Avg_Load_MW": F.avg, "Min_Load_MW": F.min, "Max_Load_MW": F.max, "Std_Dev": F.stddev}
    rounded = [F.round(measure("Load"), 2).alias(name) for name, measure in measures.items()]
    zones = spark.table("loads").where("Load IS NOT NULL").groupBy(F.col("Name").alias("Zone"))
    return zones.agg(F.count(F.lit(1)).alias("Records"), *rounded).orderBy(F.desc("Avg_Load_MW"), "Zone")


def time_range(spark: SparkSession) -> DataFrame:
    """First and last timestamp and the days between, for each feed; nulls for a feed without any."""

    def span(dataset: str, view: str) -> DataFrame:
        ends = spark.table(view).agg(F.min("timestamp").alias("Start_Date"), F.max("timestamp").alias("End_Date"))
        days = F.datediff("End_Date", "Start_Date").alias("Days_Covered")
        return ends.select(F.lit(dataset).alias("Dataset"), "Start_Date", "End_Date", days)

    return span("Prices", "prices").union(span("Loads", "loads"))


def profile_table(df: DataFrame, name: str) -> DataFrame:
    """Name, row count, column count and column list of a frame, as one row."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(",".join(df.columns)).alias("columns"),
    )


def distinct_values(df: DataFrame, column: str = ENTITY) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


# --- labels -------------------------------------------------------------------


def class_balance(df: DataFrame, label: str = "is_price_spike") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def label_profile(df: DataFrame, label: str = "is_price_spike") -> DataFrame:
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(PRICE).alias("avg_price"),
        F.avg(LOAD).alias("avg_load"),
        F.avg("Marginal_Cost_Congestion_avg").alias("avg_congestion"),
    )


def label_rate(df: DataFrame, label: str = "is_price_spike") -> DataFrame:
    """Rows, labelled rows and their share (0 when there are no rows), in one pass."""
    hits = F.count_if(F.col(label) == 1)
    total = F.count(F.lit(1))
    return df.agg(
        total.alias("total"),
        hits.alias("spikes"),
        F.coalesce(F.try_divide(hits.cast("double"), total), F.lit(0.0)).alias("spike_rate"),
    )


def label_by_hour(df: DataFrame, label: str = "is_price_spike") -> DataFrame:
    return df.where(F.col(label) == 1).groupBy("hour").agg(F.count(F.lit(1)).alias("count")).orderBy("hour")


def spike_profile(df: DataFrame, predicted: str = "predicted_spike") -> DataFrame:
    """Totals and characteristics of predicted spikes; the latter NULL when there are none.

    ``hourly_distribution`` is an array of (hour, count), in hour order, NULL
    when there are none.
    """
    hit = F.col(predicted) == 1
    # One partial aggregate per hour of day; the second level merges 24 rows.
    hourly = df.groupBy("hour").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(hit).alias("hits"),
        *[F.sum(F.when(hit, F.col(c))).alias(f"sum_{c}") for c in (PRICE, LOAD, "congestion_impact")],
        *[F.count(F.when(hit, F.col(c))).alias(f"n_{c}") for c in (PRICE, LOAD, "congestion_impact")],
        F.max(F.when(hit, F.col(PRICE))).alias("top"),
    )

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(f"sum_{c}"), F.sum(f"n_{c}"))

    spread = F.array_sort(F.collect_list(F.when(F.col("hits") > 0, F.struct("hour", F.col("hits").alias("count")))))
    return hourly.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_predictions"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("predicted_spikes"),
        mean(PRICE).alias("avg_spike_price"),
        F.max("top").alias("max_spike_price"),
        mean(LOAD).alias("avg_spike_load"),
        mean("congestion_impact").alias("avg_congestion_impact"),
        F.when(F.sum("hits") > 0, spread).alias("hourly_distribution"),
    )


# --- panel summaries ----------------------------------------------------------


def pivot_mean(
    df: DataFrame, rows: str, across: str, values: Sequence[int], measure: str, *, fill: float | None = None
) -> DataFrame:
    """Mean of a measure as a matrix; the columns are named ``{across}_{value}``.

    The column values are given, so no extra job looks them up.
    """
    wide = df.groupBy(rows).pivot(across, list(values)).agg(F.avg(measure))
    wide = wide.withColumnsRenamed({str(v): f"{across}_{v}" for v in values})
    return wide if fill is None else wide.fillna(fill, subset=[f"{across}_{v}" for v in values])


def mean_by(df: DataFrame, *keys: str | Column, measures: Sequence[str] = (PRICE, LOAD)) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in measures])


def entity_comparison(df: DataFrame) -> DataFrame:
    """Average price and load per entity, cheapest first."""
    return mean_by(df, ENTITY).orderBy(PRICE, ENTITY)


def daily_trend(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    return mean_by(df, F.to_date(ts).alias("date")).orderBy("date")


def daily_trend_by_entity(df: DataFrame, ts: str = "timestamp", entities: int = 6) -> DataFrame:
    """Daily averages of the first entities in name order."""
    first = df.select(ENTITY).distinct().orderBy(ENTITY).limit(entities)
    chosen = df.join(F.broadcast(first), ENTITY, "left_semi")  # at most `entities` rows
    return mean_by(chosen, F.to_date(ts).alias("date"), ENTITY).orderBy("date", ENTITY)


def hourly_pattern(df: DataFrame, measures: Sequence[str] = (PRICE, LOAD)) -> DataFrame:
    return mean_by(df, "hour", measures=measures).orderBy("hour")


def kpi_summary(df: DataFrame, label: str = "is_price_spike") -> DataFrame:
    """Mean price, highest load, spike count and record count; all 0 for an empty panel."""
    zero = F.lit(0.0)
    return df.agg(
        F.coalesce(F.avg(PRICE), zero).alias("avg_price"),
        F.coalesce(F.max(LOAD), zero).alias("max_load"),
        F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("spike_count"),
        F.count(F.lit(1)).alias("total_records"),
    )


def histogram(df: DataFrame, value: str | Column, bins: int = 50, *, limits: tuple[float, float] | None = None) -> DataFrame:
    """Row counts of equal-width bins; values beyond ``limits`` count in the outer bins.

    Without limits the edges are the column's extremes (a scalar subquery), and
    a constant column falls into bin 0.  Empty bins are absent.
    """
    x = df.select((F.col(value) if isinstance(value, str) else value).cast("double").alias("x"))
    x = x.where(F.col("x").isNotNull())
    if limits:
        low, high = F.lit(float(limits[0])), F.lit(float(limits[1]))
    else:
        edges = x.select(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("edges")).scalar()
        low, high = edges.getField("low"), edges.getField("high")
    clipped = F.greatest(F.least(F.col("x"), high), low)
    place = F.floor((clipped - low) / ((high - low) / bins))
    index = F.when(high > low, F.least(place, F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return x.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("count")).orderBy("bin")


def global_threshold(df: DataFrame, mean: str = "LBMP_avg_ma_24", k: float = 3.0) -> DataFrame:
    """Chart threshold: mean of the rolling mean plus k overall deviations of the price."""
    return df.agg((F.avg(mean) + F.lit(float(k)) * F.stddev(PRICE)).alias("threshold"))


def median_of(df: DataFrame, value: str) -> DataFrame:
    return exact_percentiles(df, [], value, {"median": 0.5})


def box_stats(df: DataFrame, by: str, measures: Sequence[str] = (LOAD, PRICE)) -> DataFrame:
    """Minimum, quartiles and maximum of each measure per group, in long form."""
    names = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    cells = [F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    return exact_percentiles(df.select(by, F.inline(F.array(*cells))), [by, "measure"], "value", names)


def pearson(x: str, y: str) -> Column:
    """Correlation over complete pairs; NULL for constant input, where ``corr`` raises under ANSI."""
    paired_x, paired_y = (F.when(F.col(b).isNotNull(), F.col(a)) for a, b in ((x, y), (y, x)))
    spread = F.stddev_pop(paired_x) * F.stddev_pop(paired_y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0)))


def corr_by(df: DataFrame, key: str, x: str = LOAD, y: str = PRICE) -> DataFrame:
    return df.groupBy(key).agg(pearson(x, y).alias("correlation")).orderBy(key)


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise correlations over complete pairs, as rows (x, y, r); NULL for constant columns.

    One aggregate of mergeable co-moments (counts, means and centred products),
    grouped by pair and stable whatever the distance of the values from 0.  Null
    and NaN are missing; a pair leaves out only the rows in which one of its own
    two is.
    """
    upper = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    usable = df.select(*[F.nullif(F.col(f"`{c}`").cast("double"), F.lit(float("nan"))).alias(f"_{i}") for i, c in enumerate(columns)])
    pairs = [F.struct(F.lit(i * len(columns) + j).alias("pair"), F.col(f"_{i}").alias("a"), F.col(f"_{j}").alias("b")) for i, j in upper]
    found = usable.select(F.inline(F.array(*pairs))).where("a IS NOT NULL AND b IS NOT NULL").groupBy("pair").agg(pearson("a", "b").alias("r"))
    # One entry per pair.
    row = found.agg(F.map_from_entries(F.collect_list(F.struct("pair", "r"))).alias("r"))

    def cell(i: int, j: int) -> Column:
        value = F.try_element_at("r", F.lit(min(i, j) * len(columns) + max(i, j)))
        return F.struct(F.lit(columns[i]).alias("x"), F.lit(columns[j]).alias("y"), value.alias("r"))

    return row.select(F.inline(F.array(*[cell(i, j) for i, j in product(range(len(columns)), repeat=2)])))
