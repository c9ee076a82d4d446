"""Row-frame windows over series of any length.

A window partitioned by entity alone puts a whole series into one task.  Here a
series longer than ``block_rows`` is cut into blocks of about that many rows.
Each block also receives the calendar cells that hold the ``reach`` rows before
it, evaluates the window, and drops those borrowed rows again.  Frames that look
back at most ``reach`` rows see exactly the rows they would see in the whole
series, gaps or not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.runtime import attach

# Thirty years of hourly rows.
BLOCK_ROWS = 262_144

Spec = Callable[[WindowSpec], dict[str, Column]]

# Short names of the rolling statistics.
STATISTICS = {"ma": F.avg, "std": F.stddev, "min": F.min, "max": F.max}


def rolling(
    value: str,
    windows: Sequence[int] = (24, 168),
    stats: Sequence[str] = ("ma", "std", "min", "max"),
    name: Callable[[str, int], str] | None = None,
) -> Spec:
    """Statistics of the previous N rows, the current row excluded."""
    name = name or (lambda stat, n: f"{value}_{stat}_{n}")

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            name(stat, n): STATISTICS[stat](value).over(w.rowsBetween(-n, -1)) for n in windows for stat in stats
        }

    return build


def lags(
    value: str, steps: Sequence[int] = (1, 2, 3, 6, 12, 24), name: Callable[[int], str] | None = None
) -> Spec:
    """The value k rows back, for each k."""
    name = name or (lambda k: f"{value}_lag_{k}")
    return lambda w: {name(k): F.lag(value, k).over(w) for k in steps}


def change(value: str, step: int, name: str) -> Spec:
    """Difference to the value ``step`` rows back."""
    return lambda w: {name: F.col(value) - F.lag(value, step).over(w)}


def with_series_columns(
    df: DataFrame,
    specs: Sequence[Spec],
    *,
    reach: int,
    entity: str = "Name",
    ts: str = "timestamp",
    ties: Sequence[str] = (),
    grain: str = "hour",
    backwards: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns computed along each entity's series.

    All specs share one window key, so Spark evaluates them after one exchange
    and one sort.  ``reach`` is the longest look-back in rows.  ``ties`` order
    rows of equal timestamp.  ``backwards`` runs the series from its end, which
    turns a lag into a lead.

    Series lengths are measured first with one aggregate over the entity column,
    so hand in a stored table rather than a long plan.
    """
    if block_rows < reach:
        raise ValueError(f"block_rows ({block_rows}) must be at least reach ({reach})")
    order = [F.desc(c) if backwards else F.asc(c) for c in (ts, *ties)]
    lengths = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_rows"))
    if lengths.where(F.col("_rows") > block_rows).isEmpty():
        # Measured: no series exceeds block_rows, whole-series windows are bounded.
        return _spread(df, entity).withColumns(_evaluate(specs, W.partitionBy(entity).orderBy(*order)))

    cell = _fitting_cell(df, entity, _cells(F.col(ts), grain), block_rows)
    layout = _block_layout(df, entity, cell, reach, backwards, block_rows).withColumnRenamed("_entity", entity)
    placed = attach(df.withColumn("_cell", cell), layout, [entity, "_cell"], how="left")
    copies = placed.select(
        *df.columns, F.posexplode(F.coalesce("_blocks", F.array(F.lit(0)))).alias("_copy", "_block")
    )
    window = W.partitionBy(entity, "_block").orderBy(*order)
    columns = _spread(copies, entity, "_block").withColumns(_evaluate(specs, window))
    return columns.where(F.col("_copy") == 0).drop("_copy", "_block")


def _spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by the window key into all shuffle partitions.

    The exchange the window needs anyway, but with a fixed partition count:
    adaptive execution would merge partitions by bytes, while sliding frames
    cost far more time per byte than a scan.
    """
    partitions = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(int(partitions), *keys) if partitions.isdigit() else df


def _evaluate(specs: Sequence[Spec], window: WindowSpec) -> dict[str, Column]:
    return {name: column for spec in specs for name, column in spec(window).items()}


def _cells(ts: Column, grain: str) -> list[Column]:
    """Calendar cells a row may be filed under, coarse to fine."""
    year, day = F.year(ts), F.unix_date(F.to_date(ts))
    month = year * 12 + F.month(ts)
    return [month, day, day * 24 + F.hour(ts)] if grain == "hour" else [year, month, day]


def _fitting_cell(df: DataFrame, entity: str, cells: Sequence[Column], block_rows: int) -> Column:
    """The coarsest cell that fits a block everywhere, so that no block outgrows its size twofold.

    Only rows of one entity within one finest cell are never parted.
    """
    for cell in cells[:-1]:
        sizes = df.groupBy(entity, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_rows"))
        if sizes.where(F.col("_rows") > block_rows).isEmpty():
            return cell
    return cells[-1]


def _block_layout(
    df: DataFrame, entity: str, cell: Column, reach: int, backwards: bool, block_rows: int
) -> DataFrame:
    """Blocks each (entity, cell) of a long series belongs to: its own first, then borrowers.

    A cell is borrowed by a later block that starts fewer than ``reach`` rows
    after the cell ends.  Blocks span ``block_rows`` >= ``reach`` row numbers, so
    only the next two blocks can qualify.  The window groups here hold one row
    per calendar cell, which the calendar bounds whatever the data size.
    """
    counts = df.groupBy(F.col(entity).alias("_entity"), cell.alias("_cell")).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy("_entity")
    along = whole.orderBy(F.desc("_cell") if backwards else F.asc("_cell"))
    before = F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    long_series = (
        counts.withColumns({"before": before, "total": F.sum("n").over(whole)})
        .where(F.col("total") > block_rows)
        .withColumn("band", F.floor(F.col("before") / block_rows))
        .withColumn("block", F.dense_rank().over(whole.orderBy("band")))
    )

    def borrower(steps: int) -> Column:
        start = F.min("before").over(whole.orderBy("block").rangeBetween(steps, steps))
        return F.when(start < F.col("before") + F.col("n") + reach, F.col("block") + steps)

    blocks = F.array_compact(F.array(F.col("block"), borrower(1), borrower(2)))
    return long_series.select("_entity", "_cell", blocks.alias("_blocks"))
