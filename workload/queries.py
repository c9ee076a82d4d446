"""One query per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.columns import calendar, parse_wall_clock, wall_clock_text
from panelmill.operators import cleaning, forecast, increments, metrics, models, reports, rollup, sampling
from panelmill.operators import features as feat
from panelmill.operators.series import change, lags, rolling, with_series_columns
from panelmill.plans.modelling import evaluate_models, fit_models, predictions_table
from panelmill.plans.panels import extended_panel, featured_panel, flat_panel, processed_panel
from panelmill.runtime import materialize, scratch_path
from panelmill.sources import feeds as vendor
from panelmill.sources import layouts, tables
from workload import feeds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYS = ["timestamp", "Name"]
CORR_COLUMNS = [
    "LBMP_avg",
    "Load_MW",
    "Marginal_Cost_Losses_avg",
    "Marginal_Cost_Congestion_avg",
    "price_ma_24h",
    "load_ma_24h",
    "price_volatility",
    "hour",
    "month",
    "is_weekend",
]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def settled(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that last-bit differences between engines cannot show.

    The daily loads are of order 1e5, where 4 digits leave the same slack as 6
    do for the hourly values.
    """
    shift = 10.0 ** -(digits + 2)
    doubles = {n: F.round(F.col(f"`{n}`") + shift, digits) for n, t in df.dtypes if t == "double"}
    return df.withColumns(doubles) if doubles else df


# --- shared inputs ------------------------------------------------------------


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed_panel(feeds.hourly_price(spark, sf_dir), feeds.hourly_load(spark, sf_dir))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed_panel(feeds.daily_price(spark, sf_dir), feeds.daily_load(spark, sf_dir), grain="day")


def hourly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured_panel(hourly_panel(spark, sf_dir))


def flat_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat_panel(feeds.hourly_price(spark, sf_dir), feeds.hourly_load(spark, sf_dir))


def naive_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value 24 rows ago as prediction; a two-deviation rule as predicted class."""
    df = hourly_features(spark, sf_dir)
    loose = F.col("LBMP_avg") > feat.spike_threshold("LBMP_avg_ma_24", "LBMP_avg_std_24", 2.0)
    return df.withColumns(
        {
            "predicted_price": F.col("LBMP_avg_lag_24"),
            "predicted_load": F.col("Load_MW_lag_24"),
            "predicted_spike": F.when(loose, 1).otherwise(0),
        }
    )


def series(spark: SparkSession, sf_dir: str, *specs, reach: int) -> DataFrame:
    panel = materialize(hourly_panel(spark, sf_dir).select(*KEYS, "PTID", "LBMP_avg", "Load_MW"), "panel")
    return with_series_columns(panel, specs, reach=reach, ties=["PTID"])


# --- sources and sinks --------------------------------------------------------


def _written_price_csv(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "csv")
    price = feeds.hourly_price(spark, sf_dir)
    vendor.write_feed(price, f"{root}/2024_realtime_zone_csv", feeds.PRICE_FEED)
    return root


@query
def scan_price_csv(spark, sf_dir):
    df = vendor.read_price_feed(spark, _written_price_csv(spark, sf_dir))
    return settled(df.select("timestamp", *feeds.PRICE_FEED))


@query
def scan_load_csv(spark, sf_dir):
    root = scratch_path(spark, "csv")
    vendor.write_feed(feeds.hourly_load(spark, sf_dir), f"{root}/2024_pal_csv", feeds.LOAD_FEED)
    df = vendor.read_load_feed(spark, root)
    return settled(df.select("timestamp", *feeds.LOAD_FEED)).withColumnRenamed("Time Zone", "time_zone")


@query
def scan_csv_glob(spark, sf_dir):
    root = scratch_path(spark, "csv")
    price = feeds.hourly_price(spark, sf_dir)
    known = F.col("timestamp").isNotNull()
    vendor.write_feed(price.where(known), f"{root}/2024_realtime_zone_csv", feeds.PRICE_FEED)
    vendor.write_feed(price.where(~known), f"{root}/2025_realtime_zone_csv", feeds.PRICE_FEED)
    df = vendor.read_price_feed(spark, root)
    return settled(
        df.groupBy("Name").agg(
            F.count(F.lit(1)).alias("rows"), F.count("timestamp").alias("stamped"), F.avg("LBMP").alias("avg_price")
        )
    )


@query
def scan_reordered_csv(spark, sf_dir):
    """Two folders of vendor files whose columns stand in different orders."""
    root = scratch_path(spark, "csv")
    price = feeds.hourly_price(spark, sf_dir)
    known = F.col("timestamp").isNotNull()
    vendor.write_feed(price.where(known), f"{root}/2024_realtime_zone_csv", feeds.PRICE_FEED)
    vendor.write_feed(price.where(~known), f"{root}/2025_realtime_zone_csv", feeds.PRICE_FEED[::-1])
    df = vendor.read_feed(spark, [f"{root}/{y}_realtime_zone_csv/*.csv" for y in (2024, 2025)], vendor.PRICE_SCHEMA)
    return settled(
        df.groupBy("Name").agg(
            F.count(F.lit(1)).alias("rows"), F.count("timestamp").alias("stamped"), F.avg("LBMP").alias("avg_price")
        )
    )


def _mixed_price_csv(spark: SparkSession, sf_dir: str) -> str:
    """One folder of vendor files in two column orders, with lines that are no rows: bad stamps, numbers and fields."""
    root = scratch_path(spark, "csv")
    price = feeds.hourly_price(spark, sf_dir)
    late = F.hour("timestamp") >= 12
    text = price.withColumn("LBMP", F.when(F.col("Marginal_Cost_Losses") == 0.3, "n/a").otherwise(F.col("LBMP").cast("string")))
    short = F.col("Marginal_Cost_Losses") == 0.7
    text = text.withColumn("Name", F.when(short, F.concat_ws(",", "Name", "Name")).otherwise(F.col("Name")))
    vendor.write_feed(text.where(late), f"{root}/a", feeds.PRICE_FEED, quoted=False)
    vendor.write_feed(text.where(~late | F.col("timestamp").isNull()), f"{root}/b", feeds.PRICE_FEED[::-1], quoted=False)
    return f"{root}/{{a,b}}/*.csv"


@query
def scan_mixed_csv(spark, sf_dir):
    """Good rows of a folder whose files differ in column order."""
    rows, _ = layouts.read_checked_feed(spark, _mixed_price_csv(spark, sf_dir), vendor.PRICE_SCHEMA)
    return settled(rows.select("timestamp", *feeds.PRICE_FEED))


@query
def rejected_lines(spark, sf_dir):
    """Lines by reason next to the good rows: together all lines but the headers."""
    rows, rejects = layouts.read_checked_feed(spark, _mixed_price_csv(spark, sf_dir), vendor.PRICE_SCHEMA)
    counted = rejects.groupBy(F.array_join("reasons", "+").alias("reason")).agg(F.count(F.lit(1)).alias("lines"))
    return counted.unionByName(rows.agg(F.lit("none").alias("reason"), F.count(F.lit(1)).alias("lines")))


@query
def parse_timestamp(spark, sf_dir):
    stamp = F.when(F.col("timestamp").isNotNull(), wall_clock_text("timestamp")).otherwise("bad").alias("stamp")
    df = feeds.hourly_price(spark, sf_dir).select("Name", stamp)
    return df.select("Name", "stamp", parse_wall_clock(F.col("stamp")).alias("timestamp"))


@query
def sink_parquet_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "sink")
    tables.write_panel(hourly_panel(spark, sf_dir), path)
    back = tables.read_table(spark, path)
    return settled(back.select(*KEYS, "PTID", "LBMP_avg", "Load_MW", "price_count", "year", "month"))


@query
def sink_predictions(spark, sf_dir):
    path = scratch_path(spark, "sink")
    df = flat_features(spark, sf_dir)
    named = df.withColumns(
        {
            "predicted_price": F.col("price_lag_24h"),
            "predicted_load": F.col("load_lag_24h"),
            "predicted_spike": F.when(F.col("price_lag_1h") > F.col("price_ma_24h"), 1).otherwise(0),
        }
    )
    tables.write_predictions(named, path)
    return settled(tables.read_table(spark, path))


@query
def profile_table(spark, sf_dir):
    return reports.profile_table(feeds.table(spark, sf_dir, "orders"), "orders")


# --- cleaning -----------------------------------------------------------------


@query
def clean_price(spark, sf_dir):
    return settled(cleaning.clean_price(feeds.hourly_price(spark, sf_dir)))


@query
def clean_load(spark, sf_dir):
    cleaned = cleaning.clean_load(feeds.hourly_load(spark, sf_dir))
    return settled(cleaned).withColumnRenamed("Time Zone", "time_zone")


@query
def dedup_first_in_bucket(spark, sf_dir):
    first = cleaning.first_in_bucket(cleaning.clean_load(feeds.hourly_load(spark, sf_dir)))
    return settled(first.withColumnsRenamed({"Load": "Load_MW", "Time Zone": "time_zone"}))


@query
def drop_incomplete(spark, sf_dir):
    hourly = rollup.rollup_price(feeds.hourly_price(spark, sf_dir), stats="std")
    return settled(cleaning.drop_incomplete(hourly))


@query
def slice_entity_month(spark, sf_dir):
    panel = hourly_panel(spark, sf_dir).select(*KEYS, "month", "LBMP_avg", "Load_MW")
    return settled(cleaning.keep(panel, Name="click", month=1))


@query
def distinct_entities(spark, sf_dir):
    return reports.distinct_values(feeds.daily_load(spark, sf_dir))


# --- roll-ups and joins -------------------------------------------------------


@query
def rollup_price_hourly(spark, sf_dir):
    return settled(rollup.rollup_price(cleaning.clean_price(feeds.hourly_price(spark, sf_dir))))


@query
def rollup_price_hourly_std(spark, sf_dir):
    return settled(rollup.rollup_price(feeds.hourly_price(spark, sf_dir), stats="std"))


@query
def rollup_price_hourly_full(spark, sf_dir):
    return settled(rollup.rollup_price(feeds.hourly_price(spark, sf_dir), stats="full"))


@query
def rollup_load_hourly(spark, sf_dir):
    return settled(rollup.rollup_load(feeds.hourly_load(spark, sf_dir)))


@query
def rollup_load_hourly_tz(spark, sf_dir):
    load = feeds.hourly_load(spark, sf_dir)
    return settled(rollup.rollup_load(load, keys=("Name", "PTID"), zone_label="Time Zone"))


@query
def rollup_price_daily_full(spark, sf_dir):
    return settled(rollup.rollup_price(feeds.daily_price(spark, sf_dir), stats="full", grain="day"))


@query
def join_feeds(spark, sf_dir):
    price = rollup.rollup_price(cleaning.clean_price(feeds.hourly_price(spark, sf_dir)))
    load = rollup.rollup_load(cleaning.clean_load(feeds.hourly_load(spark, sf_dir)))
    return settled(rollup.join_feeds(price, load))


@query
def join_predictions(spark, sf_dir):
    df = materialize(naive_predictions(spark, sf_dir), "predictions")
    joined = rollup.join_predictions(
        df.select(*KEYS, "LBMP_avg", "predicted_price"),
        df.select(*KEYS, "predicted_load"),
        df.select(*KEYS, "predicted_spike"),
    )
    return settled(joined)


@query
def processed_panel_first_load(spark, sf_dir):
    panel = processed_panel(
        feeds.hourly_price(spark, sf_dir), feeds.hourly_load(spark, sf_dir), load_rollup="first"
    )
    return settled(panel).withColumnRenamed("Time Zone", "time_zone")


@query
def processed_panel_avg_load(spark, sf_dir):
    return settled(hourly_panel(spark, sf_dir))


QUERIES["processed_panel"] = QUERIES.pop("processed_panel_avg_load")


# --- featured panels ----------------------------------------------------------


def featured_hourly(spark, sf_dir):
    return settled(hourly_features(spark, sf_dir))


def featured_daily(spark, sf_dir):
    return settled(featured_panel(daily_panel(spark, sf_dir), grain="day"), 4)


def featured_flat(spark, sf_dir):
    return settled(flat_features(spark, sf_dir))


def featured_extended(spark, sf_dir):
    return settled(extended_panel(feeds.hourly_price(spark, sf_dir), feeds.hourly_load(spark, sf_dir)))


QUERIES["featured_panel"] = featured_hourly
QUERIES["featured_panel_daily"] = featured_daily
QUERIES["featured_panel_flat"] = featured_flat
QUERIES["featured_panel_extended"] = featured_extended


@query
def feature_projection(spark, sf_dir):
    names = feat.feature_columns("price", leak_free=True)
    return settled(feat.project_features(hourly_features(spark, sf_dir), names, *KEYS, "LBMP_avg"))


@query
def feature_sets(spark, sf_dir):
    """Every named feature set: its features in order, and the mean of each over the panel that it is taken from."""
    modular = {t: feat.feature_columns(t) for t in ("price", "demand", "spike", "other")}
    flat = {f"flat_{t}": names for t, names in feat.FLAT_FEATURES.items()}
    sources = [
        (hourly_features(spark, sf_dir), modular),
        (flat_features(spark, sf_dir), flat),
        (extended_panel(feeds.hourly_price(spark, sf_dir), feeds.hourly_load(spark, sf_dir)), {"extended_price": feat.EXTENDED_PRICE_FEATURES}),
    ]
    parts = []
    for panel, sets in sources:
        used = list(dict.fromkeys(n for names in sets.values() for n in names))
        means = feat.project_features(panel, used).agg(*[F.avg(n).alias(n) for n in used])
        rows = [
            F.struct(F.lit(name).alias("feature_set"), F.lit(i).alias("place"), F.lit(n).alias("feature"), F.col(n).alias("mean"))
            for name, names in sets.items()
            for i, n in enumerate(names)
        ]
        parts.append(means.select(F.inline(F.array(*rows))))
    return settled(parts[0].unionByName(parts[1]).unionByName(parts[2]), 4)


@query
def featured_panel_first_load(spark, sf_dir):
    """The modular chain on the earliest load row of each hour instead of the hour's average."""
    panel = processed_panel(feeds.hourly_price(spark, sf_dir), feeds.hourly_load(spark, sf_dir), load_rollup="first")
    return settled(featured_panel(panel)).withColumnRenamed("Time Zone", "time_zone")


@query
def calendar_features(spark, sf_dir):
    panel = hourly_panel(spark, sf_dir).select(*KEYS)
    parts = calendar(F.col("timestamp"), extras=("peak", "week"))
    plain = {n: c for n, c in parts.items() if not n.endswith(("_sin", "_cos"))}
    return panel.withColumns(plain)


@query
def cyclical_features(spark, sf_dir):
    return settled(hourly_panel(spark, sf_dir).select(*KEYS, "hour_sin", "hour_cos", "month_sin", "month_cos"))


# --- window columns -----------------------------------------------------------


@query
def lag_features(spark, sf_dir):
    return settled(series(spark, sf_dir, lags("LBMP_avg"), lags("Load_MW"), reach=24))


@query
def rolling_mean(spark, sf_dir):
    specs = [rolling(v, stats=("ma",)) for v in ("LBMP_avg", "Load_MW")]
    return settled(series(spark, sf_dir, *specs, reach=168))


@query
def rolling_std(spark, sf_dir):
    specs = [rolling(v, stats=("std",)) for v in ("LBMP_avg", "Load_MW")]
    return settled(series(spark, sf_dir, *specs, reach=168))


@query
def rolling_min_max(spark, sf_dir):
    specs = [rolling(v, stats=("min", "max")) for v in ("LBMP_avg", "Load_MW")]
    return settled(series(spark, sf_dir, *specs, reach=168))


@query
def momentum(spark, sf_dir):
    specs = [
        change("LBMP_avg", 24, "price_momentum_24h"),
        change("LBMP_avg", 1, "price_change_1h"),
        change("Load_MW", 1, "load_change_1h"),
    ]
    return settled(series(spark, sf_dir, *specs, reach=24))


@query
def rolling_blocks(spark, sf_dir):
    """The daily series cut into blocks: same values as whole-series windows."""
    panel = materialize(daily_panel(spark, sf_dir).select(*KEYS, "PTID", "LBMP_avg", "Load_MW"), "panel")
    specs = [rolling("LBMP_avg"), lags("Load_MW")]
    return settled(
        with_series_columns(panel, specs, reach=168, ties=["PTID"], grain="day", block_rows=200), 4
    )


# --- derived columns and labels -----------------------------------------------


def _day_stats(spark, sf_dir) -> DataFrame:
    """Panel with the 24-row mean and deviation of both measures, early rows kept."""
    panel = materialize(hourly_panel(spark, sf_dir), "panel")
    specs = [rolling(v, (24,), ("ma", "std")) for v in ("LBMP_avg", "Load_MW")]
    return with_series_columns(panel, specs, reach=24, ties=["PTID"])


@query
def volatility_ratio(spark, sf_dir):
    value = feat.volatility("LBMP_avg_ma_24", "LBMP_avg_std_24")
    return settled(_day_stats(spark, sf_dir).select(*KEYS, value.alias("price_volatility_ratio")))


@query
def congestion_impact(spark, sf_dir):
    return settled(hourly_panel(spark, sf_dir).select(*KEYS, feat.congestion_impact().alias("congestion_impact")))


@query
def price_zscore(spark, sf_dir):
    value = feat.deviation("LBMP_avg", "LBMP_avg_ma_24", "LBMP_avg_std_24")
    return settled(_day_stats(spark, sf_dir).select(*KEYS, value.alias("price_deviation_24h")))


@query
def load_ratio(spark, sf_dir):
    value = feat.load_ratio("Load_MW", "Load_MW_ma_24")
    return settled(_day_stats(spark, sf_dir).select(*KEYS, value.alias("load_ratio_24h")))


@query
def peak_load_flag(spark, sf_dir):
    value = feat.peak_load("Load_MW", "Load_MW_ma_24", "Load_MW_std_24")
    return _day_stats(spark, sf_dir).select(*KEYS, value.alias("is_peak_load"))


@query
def spike_labels(spark, sf_dir):
    labelled = feat.add_spike_labels(feat.add_load_features(_day_stats(spark, sf_dir)))
    return settled(labelled.select(*KEYS, "spike_threshold", "is_price_spike"))


@query
def spike_cause(spark, sf_dir):
    labelled = feat.add_spike_labels(feat.add_load_features(_day_stats(spark, sf_dir)), k=2.0)
    return labelled.select(*KEYS, "is_price_spike", "is_peak_load", "spike_cause")


# --- SQL reports and summaries ------------------------------------------------


def _registered(spark: SparkSession, sf_dir: str) -> SparkSession:
    reports.register_feeds(feeds.hourly_price(spark, sf_dir), feeds.hourly_load(spark, sf_dir))
    return spark


@query
def sql_price_stats(spark, sf_dir):
    return reports.price_stats(_registered(spark, sf_dir))


@query
def sql_load_stats(spark, sf_dir):
    return reports.load_stats(_registered(spark, sf_dir))


@query
def sql_time_range(spark, sf_dir):
    return reports.time_range(_registered(spark, sf_dir))


@query
def class_balance(spark, sf_dir):
    return reports.class_balance(hourly_features(spark, sf_dir))


@query
def spike_label_profile(spark, sf_dir):
    return settled(reports.label_profile(hourly_features(spark, sf_dir)))


@query
def spike_rate(spark, sf_dir):
    return settled(reports.label_rate(hourly_features(spark, sf_dir)))


@query
def spike_by_hour(spark, sf_dir):
    return reports.label_by_hour(hourly_features(spark, sf_dir))


@query
def spike_profile(spark, sf_dir):
    profile = settled(reports.spike_profile(naive_predictions(spark, sf_dir)))
    entry = F.transform("hourly_distribution", lambda e: F.concat_ws(":", e["hour"], e["count"]))
    return profile.withColumn("hourly_distribution", F.array_join(entry, ","))


@query
def pivot_dow_hour(spark, sf_dir):
    panel = hourly_panel(spark, sf_dir)
    return settled(reports.pivot_mean(panel, "day_of_week", "hour", range(24), "LBMP_avg", fill=0.0))


@query
def pivot_hour_month_load(spark, sf_dir):
    return settled(reports.pivot_mean(hourly_panel(spark, sf_dir), "hour", "month", range(1, 13), "Load_MW"))


@query
def pivot_hour_month_price(spark, sf_dir):
    return settled(reports.pivot_mean(hourly_panel(spark, sf_dir), "hour", "month", range(1, 13), "LBMP_avg"))


@query
def entity_comparison(spark, sf_dir):
    return settled(reports.entity_comparison(cleaning.keep(daily_panel(spark, sf_dir), month=6)))


@query
def daily_trend(spark, sf_dir):
    return settled(reports.daily_trend(hourly_panel(spark, sf_dir)))


@query
def daily_trend_by_entity(spark, sf_dir):
    return settled(reports.daily_trend_by_entity(materialize(daily_panel(spark, sf_dir), "panel")))


@query
def hourly_pattern(spark, sf_dir):
    return settled(reports.hourly_pattern(hourly_panel(spark, sf_dir)))


@query
def hourly_volatility(spark, sf_dir):
    return settled(reports.hourly_pattern(flat_features(spark, sf_dir), ["price_volatility"]))


@query
def kpi_summary(spark, sf_dir):
    return settled(reports.kpi_summary(hourly_features(spark, sf_dir)))


@query
def histogram_price(spark, sf_dir):
    return reports.histogram(materialize(daily_panel(spark, sf_dir), "panel"), F.round("LBMP_avg", 6))


@query
def histogram_volatility(spark, sf_dir):
    df = materialize(flat_features(spark, sf_dir), "features")
    bins = reports.histogram(df, F.round("price_volatility", 6), limits=(0.0, 2.0))
    median = reports.median_of(df, "price_volatility").select(F.struct("median").alias("m")).scalar()
    return settled(bins.withColumn("median", median.getField("median")))


@query
def histogram_residuals(spark, sf_dir):
    df = materialize(naive_predictions(spark, sf_dir).select("LBMP_avg", "predicted_price"), "residuals")
    return reports.histogram(df, F.round(metrics.residual("LBMP_avg", "predicted_price"), 6))


@query
def global_threshold(spark, sf_dir):
    return settled(reports.global_threshold(hourly_features(spark, sf_dir)))


@query
def box_stats_by_day(spark, sf_dir):
    df = materialize(hourly_panel(spark, sf_dir), "panel")
    return settled(reports.box_stats(df.withColumn("day_name", F.date_format("timestamp", "EEEE")), "day_name"))


@query
def corr_by_month(spark, sf_dir):
    return settled(reports.corr_by(daily_panel(spark, sf_dir), "month"))


@query
def corr_matrix(spark, sf_dir):
    return settled(reports.corr_matrix(flat_features(spark, sf_dir), CORR_COLUMNS))


# --- previews, samples, splits ------------------------------------------------


@query
def preview_rows(spark, sf_dir):
    panel = hourly_panel(spark, sf_dir).select(*KEYS, "LBMP_avg", "Load_MW")
    return settled(sampling.preview(panel, 10, *KEYS))


@query
def sample_n(spark, sf_dir):
    panel = hourly_panel(spark, sf_dir).select(*KEYS, "LBMP_avg", "Load_MW")
    return settled(sampling.sample_rows(panel, 2000, keys=KEYS, order=KEYS))


@query
def split_hash(spark, sf_dir):
    train, test = sampling.split_by_hash(hourly_panel(spark, sf_dir).select(*KEYS), keys=KEYS)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query
def split_time(spark, sf_dir):
    train, test = sampling.split_by_time(materialize(hourly_panel(spark, sf_dir).select(*KEYS), "panel"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


# --- quality metrics on the naive predictor -----------------------------------


@query
def regression_metrics(spark, sf_dir):
    return settled(metrics.regression_metrics(naive_predictions(spark, sf_dir), "LBMP_avg", "predicted_price"))


@query
def regression_metrics_gaps(spark, sf_dir):
    """Predictions missing at one hour and actuals at another: only rows with both count."""
    df = naive_predictions(spark, sf_dir).select(
        F.when(F.col("hour") != 3, F.col("LBMP_avg")).alias("LBMP_avg"),
        F.when(F.col("hour") != 5, F.col("predicted_price")).alias("predicted_price"),
    )
    return settled(metrics.regression_metrics(df, "LBMP_avg", "predicted_price"))


@query
def classification_metrics(spark, sf_dir):
    return settled(
        metrics.classification_metrics(naive_predictions(spark, sf_dir), "is_price_spike", "predicted_spike")
    )


@query
def roc_auc(spark, sf_dir):
    df = naive_predictions(spark, sf_dir).select("is_price_spike", F.round("LBMP_avg_lag_1", 4).alias("score"))
    return settled(metrics.roc_auc(df, "is_price_spike", "score"))


@query
def error_by_hour(spark, sf_dir):
    return settled(metrics.error_by(naive_predictions(spark, sf_dir), "hour", "LBMP_avg", "predicted_price"))


@query
def error_by_entity(spark, sf_dir):
    return settled(metrics.error_by(naive_predictions(spark, sf_dir), "Name", "Load_MW", "predicted_load"))


@query
def actual_vs_predicted(spark, sf_dir):
    df = naive_predictions(spark, sf_dir).select(*KEYS, "LBMP_avg", "predicted_price")
    return settled(sampling.sample_rows(df, 2000, keys=KEYS, order=KEYS))


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = materialize(
        naive_predictions(spark, sf_dir).select("LBMP_avg", "LBMP_avg_lag_1", "LBMP_avg_lag_24"), "predictions"
    )
    records = [
        metrics.model_report(df, name, "LBMP_avg", name, 1)
        for name in ("LBMP_avg_lag_1", "LBMP_avg_lag_24")
    ]
    return metrics.append_history(records)


def _history_rows(history: DataFrame) -> DataFrame:
    info = F.col("data_info")
    return settled(
        history.select(
            "model_name",
            info["test_size"].alias("test_size"),
            info["features"].alias("features"),
            F.explode("metrics").alias("metric", "value"),
        )
    )


@query
def model_report(spark, sf_dir):
    return _history_rows(_history(spark, sf_dir))


@query
def compare_models(spark, sf_dir):
    return settled(metrics.compare_models(_history(spark, sf_dir), "rmse").drop("timestamp"))


@query
def sink_metrics_json(spark, sf_dir):
    path = tables.write_history(_history(spark, sf_dir), scratch_path(spark, "history"))
    return spark.read.json(path).select("model_name", F.col("data_info.test_size").alias("test_size"))


@query
def scan_metrics_json(spark, sf_dir):
    path = tables.write_history(_history(spark, sf_dir), scratch_path(spark, "history"))
    return _history_rows(tables.read_history(spark, path))


# --- models -------------------------------------------------------------------


@query
def ml_assemble(spark, sf_dir):
    names = feat.FLAT_FEATURES["spike"]
    df = models.assembler(names).transform(flat_features(spark, sf_dir))
    items = vector_to_array("features_raw")
    return settled(df.select("hour_timestamp", "Name", *[items[i].alias(n) for i, n in enumerate(names)]))


@query
def standardize(spark, sf_dir):
    panel = materialize(daily_panel(spark, sf_dir).select(*KEYS, "LBMP_avg", "Load_MW", "price_count"), "panel")
    scaled = models.standardize(panel, ["LBMP_avg", "Load_MW", "price_count"])
    return settled(scaled.select(*KEYS, "LBMP_avg_scaled", "Load_MW_scaled", "price_count_scaled"))


def _split_features(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sampling.split_by_hash(materialize(hourly_features(spark, sf_dir), "features"), keys=KEYS)


@query
def ml_price_predict(spark, sf_dir):
    train, test = _split_features(spark, sf_dir)
    model = models.fit(train, feat.feature_columns("price"), models.price_regressor())
    return models.score(model, test).select(*KEYS, "LBMP_avg", "predicted_price")


@query
def ml_demand_predict(spark, sf_dir):
    train, test = _split_features(spark, sf_dir)
    names = feat.feature_columns("demand", leak_free=True)
    model = models.fit(train, names, models.demand_regressor())
    return models.score(model, test).select(*KEYS, "Load_MW", "predicted_demand")


@query
def ml_spike_predict(spark, sf_dir):
    train, test = _split_features(spark, sf_dir)
    model = models.fit(train, feat.feature_columns("spike"), models.spike_classifier())
    scored = models.score(model, test)
    chance = vector_to_array("spike_probability")[1].alias("spike_chance")
    return scored.select(*KEYS, "is_price_spike", "predicted_spike", chance)


@query
def ml_score_all(spark, sf_dir):
    """Three models over one flat panel: the combined predictions table without a join."""
    df = materialize(flat_features(spark, sf_dir), "features")
    train, test = sampling.split_by_hash(df, keys=["hour_timestamp", "Name"])
    fitted = fit_models(train, feat.FLAT_FEATURES)
    scored = predictions_table(fitted, test)
    return scored.select("hour_timestamp", "Name", *tables.PREDICTION_COLUMNS)


@query
def ml_reports(spark, sf_dir):
    """Evaluation records of a fitted regressor and a fitted classifier."""
    train, test = _split_features(spark, sf_dir)
    names = {t: feat.feature_columns(t, leak_free=True) for t in ("price", "spike")}
    fitted = fit_models(train, names)
    return _history_rows(evaluate_models(fitted, test, names))


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _split_features(spark, sf_dir)
    names = feat.feature_columns("price", leak_free=True)
    model = models.fit(train, names, models.price_regressor())
    return models.feature_importance(train, model, names)


@query
def feature_importance(spark, sf_dir):
    return _importance(spark, sf_dir)


@query
def top_features(spark, sf_dir):
    return models.top_features(_importance(spark, sf_dir))


@query
def predict_intervals(spark, sf_dir):
    df = naive_predictions(spark, sf_dir).select(*KEYS, "predicted_price")
    return settled(models.with_interval(df))


@query
def predict_intervals_calibrated(spark, sf_dir):
    """Half-widths from the errors of four fifths of the rows, per zone, and how much of the rest they cover."""
    columns = [*KEYS, "LBMP_avg", "predicted_price"]
    df = materialize(naive_predictions(spark, sf_dir).select(*columns), "predictions")
    known, fresh = sampling.split_by_hash(df, keys=KEYS)
    bounded = models.with_calibrated_interval(
        fresh, models.calibrated_half_widths(known, "LBMP_avg", "predicted_price", by="Name", confidence=0.9), by="Name"
    )
    inside = F.col("LBMP_avg").between(F.col("price_lower"), F.col("price_upper"))
    covered = bounded.groupBy("Name", "half_width").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(inside.cast("double")).alias("coverage")
    )
    return settled(covered)


@query
def forecast_horizon(spark, sf_dir):
    """Each of the 24 hours behind every test row by one full ensemble that is fed its own predictions."""
    out = forecast.recursive_forecast(hourly_panel(spark, sf_dir))
    made = F.col("predicted").isNotNull() & ~F.isnan("predicted")
    return settled(out.select(*KEYS, "PTID", "horizon", "target_time", "actual", made.alias("forecast")))


# Over the hour alone a model has a closed form: a boosted tree deep enough gives each hour its mean, a forest gives
# a rule over the hour back.  These check the same fits, transforms and records that the wide models go through.


def _by_hour(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    columns = [*KEYS, "hour", "LBMP_avg", "Load_MW"]
    panel = materialize(hourly_panel(spark, sf_dir).select(*columns), "panel")
    rule = F.when(F.col("hour").between(7, 22), 1).otherwise(0)
    return sampling.split_by_hash(panel.withColumn("is_price_spike", rule), keys=KEYS)


def _fitted_by_hour(train: DataFrame) -> dict:
    return fit_models(train, {t: ["hour"] for t in ("price", "demand", "spike")}, boost={"depth": 23, "rounds": 1})


@query
def ml_score_by_hour(spark, sf_dir):
    train, test = _by_hour(spark, sf_dir)
    scored = predictions_table(_fitted_by_hour(train), test)
    chance = vector_to_array("spike_probability")[1].alias("spike_chance")
    predicted = ["predicted_price", "predicted_load", F.col("predicted_spike").cast("int").alias("predicted_spike")]
    return settled(scored.select(*KEYS, "LBMP_avg", "Load_MW", *predicted, chance))


@query
def ml_reports_by_hour(spark, sf_dir):
    """Evaluation records of the hour's models, the classifier held against prices above 20 instead of its rule."""
    train, test = _by_hour(spark, sf_dir)
    dear = test.withColumn("is_price_spike", F.when(F.col("LBMP_avg") > 20, 1).otherwise(0))
    names = {t: ["hour"] for t in ("price", "demand", "spike")}
    return _history_rows(evaluate_models(_fitted_by_hour(train), dear, names))


def _importance_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _by_hour(spark, sf_dir)
    wide = train.withColumn("constant", F.lit(1.0))
    names = ["constant", "hour"]
    jobs = {
        "price": (names, models.price_regressor(depth=8, rounds=2)),
        "spike": (names, models.spike_classifier()),
    }
    fitted = models.fit_together(wide, jobs)
    parts = [models.feature_importance(wide, m, names).withColumn("model", F.lit(t)) for t, m in fitted.items()]
    return parts[0].unionByName(parts[1])


@query
def feature_importance_by_hour(spark, sf_dir):
    return settled(_importance_by_hour(spark, sf_dir))


@query
def top_features_by_hour(spark, sf_dir):
    return settled(models.top_features(_importance_by_hour(spark, sf_dir).where("model = 'spike'"), 1).drop("model"))


@query
def model_save_load(spark, sf_dir):
    """A fitted forest before and after a round trip through storage scores the same rows."""
    train, test = _split_features(spark, sf_dir)
    names = feat.feature_columns("spike", leak_free=True)
    model = models.fit(train, names, models.spike_classifier())
    path = scratch_path(spark, "model")
    models.save_model(model, path)
    before = models.score(model, test).withColumnRenamed("predicted_spike", "before")
    before = before.drop("spike_probability", "rawPrediction")
    pairs = models.score(models.load_model(path), before).withColumnRenamed("predicted_spike", "after")
    return pairs.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("before") != F.col("after")).alias("mismatches")
    )


# --- increments ---------------------------------------------------------------


def _parts(df: DataFrame, root: str) -> list[str]:
    """A feed as three folders of files by a checksum of its rows, so that every hour has late rows."""
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(3))
    folders = [f"{root}/{i}" for i in range(3)]
    for i, folder in enumerate(folders):
        df.where(part == i).write.parquet(folder)
    return folders


def _taken_in(spark: SparkSession, df: DataFrame, **how) -> increments.RollupStore:
    """Three increments, folders seen again, and a compaction between the second and the third."""
    root = scratch_path(spark, "increments")
    store = increments.RollupStore(spark, f"{root}/store", **how)
    folders = _parts(df, f"{root}/feed")
    for i, folder in enumerate(folders):
        store.take(f"{folder}/*.parquet", lambda paths: spark.read.schema(df.schema).parquet(*paths))
        store.take(f"{root}/feed/{{{','.join(str(j) for j in range(i + 1))}}}/*.parquet", lambda paths: df.limit(0))
        if i == 1:
            store.compact()
    return store


@query
def rollup_price_incremental(spark, sf_dir):
    measures = ["LBMP", "Marginal_Cost_Losses", "Marginal_Cost_Congestion"]
    rolled = _taken_in(spark, feeds.hourly_price(spark, sf_dir), measures=measures).rollup()
    averages = [f"{m}_avg" for m in measures]
    spread = ["LBMP_min", "LBMP_max", "LBMP_std", F.col("rows").alias("price_readings")]
    return settled(rolled.select(*KEYS, "PTID", *averages, *spread))


@query
def rollup_load_incremental(spark, sf_dir):
    store = _taken_in(spark, feeds.hourly_load(spark, sf_dir), measures=["Load"], label="Time Zone")
    rolled = store.rollup()
    return settled(rolled.select(*KEYS, "PTID", F.col("Load_avg").alias("Load_MW"), F.col("Time Zone").alias("Time_Zone")))
