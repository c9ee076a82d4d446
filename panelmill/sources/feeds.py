"""Vendor CSV feeds: declared schemas, glob reads and the matching writer."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from panelmill.functions.columns import parse_wall_clock, wall_clock_text

# Folder patterns, vendor headers and the names used after loading.
PRICE_PATTERN = "20*realtime_zone_csv/*.csv"
LOAD_PATTERN = "20*pal_csv/*.csv"
PRICE_SCHEMA = (
    "`Time Stamp` string, Name string, PTID int, LBMP double, "
    "Marginal_Cost_Losses double, Marginal_Cost_Congestion double"
)
LOAD_SCHEMA = "`Time Stamp` string, `Time Zone` string, Name string, PTID int, Load double"
VENDOR_HEADERS = {
    "LBMP": "LBMP ($/MWHr)",
    "Marginal_Cost_Losses": "Marginal Cost Losses ($/MWHr)",
    "Marginal_Cost_Congestion": "Marginal Cost Congestion ($/MWHr)",
}


def read_feed(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """Many CSV files of one layout as one feed with a parsed ``timestamp``.

    Columns are recognised by the vendor headers or the plain names, in any
    order; types are declared, so nothing is inferred from the rows.  The files
    of one path share an order, that of the first file: a file with another one
    fails, and belongs under a path of its own.  A missing column fails here;
    columns that the schema does not name are dropped; a pattern without any
    match fails with PATH_NOT_FOUND.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    declared = StructType.fromDDL(schema)
    plain = {header: name for name, header in VENDOR_HEADERS.items()}
    parts = []
    for path in paths:
        headers = spark.read.csv(path, header=True, quote='"').columns  # reads one line
        missing = set(declared.names) - {plain.get(h, h) for h in headers}
        if missing:
            raise ValueError(f"{path} has no column {', '.join(sorted(missing))}")
        kinds = {f.name: f.dataType for f in declared}
        layout = StructType([StructField(h, kinds.get(plain.get(h, h), StringType())) for h in headers])
        raw = spark.read.schema(layout).csv(path, header=True, quote='"', enforceSchema=False)
        parts.append(rename_vendor_columns(raw).select(*[F.col(f"`{n}`") for n in declared.names]))
    raw = reduce(DataFrame.unionByName, parts)
    return raw.withColumn("timestamp", parse_wall_clock(F.col("Time Stamp")))


def read_price_feed(spark: SparkSession, root: str, pattern: str = PRICE_PATTERN) -> DataFrame:
    return read_feed(spark, f"{root}/{pattern}", PRICE_SCHEMA)


def read_load_feed(spark: SparkSession, root: str, pattern: str = LOAD_PATTERN) -> DataFrame:
    return read_feed(spark, f"{root}/{pattern}", LOAD_SCHEMA)


def read_feeds(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return read_price_feed(spark, root), read_load_feed(spark, root)


def rename_vendor_columns(df: DataFrame) -> DataFrame:
    """Vendor headers to plain names, as the headers name them."""
    return df.withColumnsRenamed({header: name for name, header in VENDOR_HEADERS.items()})


def write_feed(
    df: DataFrame, path: str, columns: Sequence[str], *, malformed: str = "bad", quoted: bool = True
) -> None:
    """Write a feed as vendor CSV: vendor headers, wall-clock text, ``malformed`` for no timestamp.

    Without ``quoted`` text goes out as it is, commas included.
    """
    stamp = F.when(F.col("timestamp").isNotNull(), wall_clock_text("timestamp")).otherwise(F.lit(malformed))
    out = df.select(stamp.alias("Time Stamp"), *[F.col(f"`{c}`") for c in columns])
    out.withColumnsRenamed(VENDOR_HEADERS).write.csv(path, header=True, quote='"' if quoted else "")
