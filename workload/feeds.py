"""The given tables seen as the two raw feeds.

Hourly feeds come from ``events`` (each event is one price and one load reading
of its type); daily feeds from the star schema (line items price a nation's
supply, orders load a nation's demand).  Every row of the tables is used; missing
and malformed readings are injected by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_FEED = ["Name", "PTID", "LBMP", "Marginal_Cost_Losses", "Marginal_Cost_Congestion"]
LOAD_FEED = ["Time Zone", "Name", "PTID", "Load"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("int")
    ptid = (F.lit(61000) + F.ascii("event_type")).cast("int")
    return table(spark, sf_dir, "events").withColumns({"k": k, "PTID": ptid})


def hourly_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _events(spark, sf_dir).select(
        F.when(k != 97, F.col("ts")).alias("timestamp"),
        F.col("event_type").alias("Name"),
        "PTID",
        F.when(k != 89, F.col("value") * 10 - 505).alias("LBMP"),
        (F.pmod("user_id", F.lit(10)).cast("double") / 10).alias("Marginal_Cost_Losses"),
        (k * 40 - 2000).cast("double").alias("Marginal_Cost_Congestion"),
    )


def hourly_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return _events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"),
        F.when(F.pmod("event_id", F.lit(2)) == 0, "EST").otherwise("EDT").alias("Time Zone"),
        F.col("event_type").alias("Name"),
        "PTID",
        F.when(k != 83, (k * 100 - 300).cast("double")).alias("Load"),
    )


def daily_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nations = table(spark, sf_dir, "nation")
    return (
        items.join(suppliers, "l_suppkey")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("l_shipdate").alias("timestamp"),
            F.col("n_name").alias("Name"),
            F.col("n_nationkey").alias("PTID"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("LBMP"),
            F.col("l_tax").alias("Marginal_Cost_Losses"),
            F.col("l_discount").alias("Marginal_Cost_Congestion"),
        )
    )


def daily_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "orders")
        .join(customers, "o_custkey")
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderdate").alias("timestamp"),
            F.lit("EST").alias("Time Zone"),
            F.col("n_name").alias("Name"),
            F.col("n_nationkey").alias("PTID"),
            F.col("o_totalprice").alias("Load"),
        )
    )
