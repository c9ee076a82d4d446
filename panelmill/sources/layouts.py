"""CSV files of mixed layouts in one scan, with a side table for the lines that do not parse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from panelmill.functions.columns import parse_wall_clock
from panelmill.runtime import attach, materialize
from panelmill.sources.feeds import VENDOR_HEADERS

STAMP = "Time Stamp"
# A comma with an even number of quotes behind it stands outside of quotes.
_OUTSIDE = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _fields(line: Column) -> Column:
    """Fields of one CSV line; quotes around a field go, doubled quotes inside count once."""
    quoted = F.transform(
        F.split(line, _OUTSIDE, -1),
        lambda f: F.replace(F.regexp_replace(F.trim(f), '^"((?s).*)"$', "$1"), F.lit('""'), F.lit('"')),
    )
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ",", -1))


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, line`` of text files; blank lines are no lines."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return lines.where(F.trim("line") != "")


def catalogue(lines: DataFrame, schema: str) -> DataFrame:
    """``file, header, fields, places``: each file's header line and where it holds each declared column.

    A header is the line that names the time stamp column as one of its fields.
    ``places`` follows the declared columns: a position from 0, or NULL for a
    column that the file lacks.  Only header lines leave the scan, so nothing
    grows with the rows.  A file with several different ones, or none, has no
    layout and is left out.
    """
    declared = StructType.fromDDL(schema).names
    plain = F.create_map(*[F.lit(x) for name, header in VENDOR_HEADERS.items() for x in (header, name)])
    likely = lines.where(F.contains("line", F.lit(STAMP)))
    named = likely.withColumn("names", F.transform(_fields(F.col("line")), lambda f: F.coalesce(F.try_element_at(plain, F.trim(f)), F.trim(f))))
    headers = named.where(F.array_contains("names", STAMP)).groupBy("file").agg(
        F.min(F.struct("line", "names")).alias("low"), F.max("line").alias("high")
    )
    whole = headers.where(F.col("low.line") == F.col("high"))
    places = [F.nullif(F.array_position("low.names", n), F.lit(0).cast("long")) - 1 for n in declared]
    return whole.select(
        "file",
        F.col("low.line").alias("header"),
        F.size("low.names").alias("fields"),
        F.array(*places).cast("array<int>").alias("places"),
    )


def read_checked_feed(spark: SparkSession, paths: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files of any column order, and the lines that are no rows.

    Rows have the declared columns and a parsed ``timestamp``.  Rejected lines
    come as ``file, line, reasons``: ``layout`` (the file has no header, or
    lacks a declared column), ``fields`` (more or fewer than the header has),
    ``timestamp`` (missing or no wall-clock time), or the name of a column whose
    text is no value of its type.  An empty field is a missing value and no
    reason.  A line equal to its file's header is neither: rows, rejected lines
    and header lines add up to the lines read.  Quoted fields must not hold line
    ends.

    The files are scanned once for headers and once for rows; each line finds
    its file's layout by an attached side of one row per file.
    """
    declared = StructType.fromDDL(schema)
    lines = read_lines(spark, paths)
    layouts = materialize(catalogue(lines, schema), "layouts")
    placed = attach(lines, layouts, ["file"], how="left").where(~F.col("line").eqNullSafe(F.col("header")))
    placed = placed.withColumn("cells", _fields(F.col("line")))

    def cell(i: int) -> Column:
        return F.nullif(F.trim(F.get("cells", F.get("places", F.lit(i)))), F.lit(""))

    values, reasons = [], []
    known = F.col("places").isNotNull() & ~F.exists("places", lambda p: p.isNull())
    reasons.append(F.when(~known, "layout"))
    sized = known & (F.size("cells") == F.col("fields"))
    reasons.append(F.when(known & ~sized, "fields"))
    for i, field in enumerate(declared):
        text = cell(i)
        value = text if isinstance(field.dataType, StringType) else text.try_cast(field.dataType)
        values.append(value.alias(field.name))
        if field.name == STAMP:
            reasons.append(F.when(sized & parse_wall_clock(text).isNull(), "timestamp"))
        else:
            reasons.append(F.when(sized & text.isNotNull() & value.isNull(), field.name))
    parsed = placed.select("file", "line", *values, F.array_compact(F.array(*reasons)).alias("reasons"))
    good = F.size("reasons") == 0
    rows = parsed.where(good).select(*[F.col(f"`{n}`") for n in declared.names])
    return rows.withColumn("timestamp", parse_wall_clock(F.col(f"`{STAMP}`"))), parsed.where(~good).select("file", "line", "reasons")
