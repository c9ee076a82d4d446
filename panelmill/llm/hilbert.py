"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.llm.common import stored
from panelmill.runtime import release

BITS = 5


def cell(position: Column, cuts: Sequence[float] | Sequence[str], kind: str = "double") -> Column:
    """How many of the ascending ``cuts`` lie at or below ``position``; a missing position is in cell 0."""
    if not cuts:
        return F.lit(0).cast("long")
    at_or_below = F.filter(F.array(*[F.lit(c) for c in cuts]).cast(f"array<{kind}>"), lambda c: c <= position)
    return F.coalesce(F.size(at_or_below), F.lit(0)).cast("long")


def hilbert_index(cells: Sequence[Column], bits: int) -> Column:
    """Index along the Hilbert curve through a grid of ``2 ** bits`` cells a side.

    The grid point is turned into the transposed index bit plane by bit plane,
    from the highest: where a coordinate has the bit, the lower bits of the
    first coordinate are inverted, elsewhere they are exchanged with its own.
    Then the coordinates are Gray decoded and their bits interleaved.
    """
    n = len(cells)

    def put(x: Column, i: int, value: Column, first: Column) -> Column:
        items = [first if j == 0 else value if j == i else x[j] for j in range(n)]
        return F.array(*items)

    def turn(x: Column, step: Column) -> Column:
        low = F.call_function("shiftleft", F.lit(1), step["bit"]).cast("long") - 1
        result = None
        for i in reversed(range(n)):
            bit = F.call_function("shiftright", x[i], step["bit"]).bitwiseAND(F.lit(1))
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            other = x[0].bitwiseXOR(swap) if i else x[0]
            own = x[i].bitwiseXOR(swap)
            turned = F.when(bit == 1, put(x, i, x[i], x[0].bitwiseXOR(low))).otherwise(put(x, i, own, other))
            result = turned if result is None else F.when(step["axis"] == i, turned).otherwise(result)
        return result

    steps = F.array(
        *[F.struct(F.lit(b).alias("bit"), F.lit(i).alias("axis")) for b in range(bits - 1, 0, -1) for i in range(n)]
    )
    start = F.array(*[c.cast("long") for c in cells])
    turned = F.aggregate(steps, start, turn) if bits > 1 else start
    high = F.array(*[F.lit(b) for b in range(bits - 1, 0, -1)])
    axes = F.array(*[F.lit(i) for i in range(1, n)])
    planes = F.array(
        *[F.struct(F.lit(b).alias("bit"), F.lit(i).alias("axis")) for b in range(bits - 1, -1, -1) for i in range(n)]
    )

    def gray(x: Column) -> Column:
        """Gray decode: each coordinate is combined with the one before it."""
        if n == 1:
            return x
        nxt = lambda acc, i: F.concat(acc, F.array(F.get(x, i).bitwiseXOR(F.get(acc, i - 1))))
        return F.aggregate(axes, F.slice(x, 1, 1), nxt)

    def flip(x: Column) -> Column:
        """The bits below each set bit of the last coordinate, which are inverted in all."""
        if bits == 1:
            return F.lit(0).cast("long")

        def add(acc: Column, b: Column) -> Column:
            is_set = F.call_function("shiftright", F.get(x, F.lit(n - 1)), b).bitwiseAND(F.lit(1)) == 1
            return F.when(is_set, acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1), b).cast("long") - 1)).otherwise(acc)

        return F.aggregate(high, F.lit(0).cast("long"), add)

    def interleave(p: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            value = F.get(p["axes"], s["axis"]).bitwiseXOR(p["flip"])
            return acc * 2 + F.call_function("shiftright", value, s["bit"]).bitwiseAND(F.lit(1))

        return F.aggregate(planes, F.lit(0).cast("long"), add)

    decoded = _bound(turned, gray)
    return _bound(_bound(decoded, lambda x: F.struct(x.alias("axes"), flip(x).alias("flip"))), interleave)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def quantise(df: DataFrame, positions: dict[str, Column], bits: int = BITS) -> dict[str, Column]:
    """Cells of each dimension by quantiles over all rows, so that cells hold about equal counts.

    Numbers are cut by approximate quantiles, strings by exact ones of whole
    strings.  At most ``2 ** bits - 1`` cut points per dimension reach the driver.
    """
    points = [i / 2**bits for i in range(1, 2**bits)]
    values = df.select(*[p.alias(n) for n, p in positions.items()])
    texts = [n for n, kind in values.dtypes if kind == "string"]
    numbers = [n for n in values.columns if n not in texts]
    cells = {n: cell(positions[n], text_cuts(values.select(F.col(n).alias("value")), 2**bits), "string") for n in texts}
    if numbers:
        found = values.agg(*[F.percentile_approx(n, points, 10_000).alias(n) for n in numbers]).first()
        cells |= {n: cell(positions[n], sorted(set(found[n] or []))) for n in numbers}
    return {n: cells[n] for n in positions}


def text_cuts(values: DataFrame, parts: int) -> list[str]:
    """The first strings whose last row lies in each of ``parts`` parts of about equal counts but the lowest.

    Distinct strings with their counts are range sorted as one stored table;
    running counts are taken inside each range and moved on by the ranges before
    it.  A string with more rows than a part is a cut at most once.
    """
    counted = values.where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange("value").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "text-counts")
    # One row per range.
    sizes = ranged.groupBy("range").agg(F.sum("n").alias("rows"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select(
        F.col("range"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("earlier"),
        F.sum("rows").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(moved), "range")
    last = F.col("before") + F.col("earlier") + F.col("n") - 1
    ends = placed.select("value", F.floor(last * parts / F.col("total")).alias("part")).where("part > 0")
    cuts = ends.groupBy("part").agg(F.min("value").alias("value")).select("value").collect()
    release(ranged)
    return [r["value"] for r in cuts]


def hilbert_shards(
    docs: DataFrame, positions: dict[str, Column], shards: int, key: Sequence[str], bits: int = BITS
) -> DataFrame:
    """All rows and columns in Hilbert order, with ``hilbert``, ``shard`` and ``slot``.

    ``positions`` are the dimensions (numbers or strings per row); rows are sorted by the
    curve's index, then by ``key``, and cut into ``shards`` runs whose counts
    differ by at most one.  ``slot`` counts from 0 in each shard.  Rows that
    share a cell are one run of the sort by ``key``, so a crowded cell is split
    like any other; fully equal rows are in any order.  Nulls sort first; an
    empty table gives no rows.  Columns that are called like the added ones are
    replaced; all others are kept, whatever their names.

    The sorted table is stored once: a row's place is its number in its part
    plus the rows of the parts before it.
    """
    docs = docs.drop("hilbert", "shard", "slot")
    cells = quantise(docs, positions, bits)
    # The rows' own columns travel as one, so that none can clash.
    own = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")
    df = docs.select(own, hilbert_index(list(cells.values()), bits).alias("hilbert"))
    order = ["hilbert", *[F.col("row").getField(k) for k in key]]
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    df = stored(df.withColumn("hilbert_place", F.monotonically_increasing_id()), "hilbert")
    part = F.shiftright("hilbert_place", 33)
    # One row per part of the sort.
    counts = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    at = F.col("base") + F.col("hilbert_place").bitwiseAND(F.lit((1 << 33) - 1))
    # The first ``long`` shards have one row more than the others.
    each, long = F.floor(F.col("total") / shards), F.col("total") % shards
    edge = long * (each + 1)
    shard = F.when(at < edge, F.floor(at / (each + 1))).otherwise(long + F.floor((at - edge) / F.greatest(each, F.lit(1))))
    placed = df.withColumn("hilbert_part", part).join(F.broadcast(bases), F.col("hilbert_part") == F.col("part"))
    start = shard * each + F.least(shard, long)
    return placed.select("row.*", "hilbert", shard.cast("int").alias("shard"), (at - start).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows keep their Hilbert order, so footers prune by every dimension."""
    sharded.write.partitionBy("shard").parquet(path)
