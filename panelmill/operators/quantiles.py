"""Exact percentiles without collecting a group, by radix selection.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
buffer, which a hot key or a global percentile outgrows.  Here values become
64-bit keys of the same order in one stored table.  A pass counts the rows of
each next digit of sixteen bits and keeps the slots that hold a wanted rank; a
key has four digits, so no distribution needs more than four passes, and no
pass has more than 65,536 counts per slot.  Once the slots are small, their
values are ordered.  The input is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.functions.ordering import DIGITS, leading, sort_key
from panelmill.runtime import attach, materialize

# Rows of a slot that one task may order; a larger slot is divided by its next digit.
SLOT_ROWS = 100_000

# A share of the way from the least value to the greatest, or the zero-based place among n values.
Place = float | Callable[[Column], Column]


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    named: Mapping[str, Place],
    *,
    alongside: Mapping[str, Column] | None = None,
    needs: Sequence[str] = (),
) -> DataFrame:
    """One row per key with a linearly interpolated percentile per entry of ``named``.

    Nulls and NaN are ignored; a key without values gets NULL.  An entry may also
    be a function that gives the zero-based place from the number of values, for
    order statistics whose share differs by key.  ``keys`` may be
    empty for percentiles of the whole column.  ``alongside`` adds ordinary
    aggregates over ``value`` and the columns that it ``needs``.
    """
    alongside = dict(alongside or {})
    groups = [f"_g{i}" for i in range(len(keys))] or ["_g0"]
    grouped = [F.col(k).alias(g) for k, g in zip(keys, groups)] or [F.lit(0).alias("_g0")]
    x = F.col(value).cast("double")
    usable = F.when(~F.isnan(x), x)
    kept = [F.col(c) for c in dict.fromkeys([value, *needs])]
    table = materialize(df.select(*grouped, *kept, usable.alias("_x"), sort_key(usable).alias("_key")), "values")

    totals = [F.min("_x").alias("_low"), F.max("_x").alias("_high"), *[c.alias(n) for n, c in alongside.items()]]
    every = table.groupBy(*groups).agg(*totals) if keys else table.agg(*totals).withColumn("_g0", F.lit(0))
    searched = {name: p for name, p in named.items() if callable(p) or 0 < p < 1}
    if searched:
        found = _searched(table.select(*groups, "_x", "_key").where("_key IS NOT NULL"), groups, searched)
        if keys:
            matched = [F.col(f"every.{g}").eqNullSafe(F.col(f"found.{g}")) for g in groups]
            every = every.alias("every").join(found.alias("found"), matched, "left").select("every.*", *searched)
        else:
            # One row each, which have no key to be joined by.
            both = every.unionByName(found, allowMissingColumns=True)
            every = both.agg(*[F.any_value(c, F.lit(True)).alias(c) for c in both.columns])
    ends = {name: F.col("_low" if p <= 0 else "_high") for name, p in named.items() if name not in searched}
    shown = [ends[n].alias(n) if n in ends else F.col(n) for n in named]
    return every.select(*[F.col(g).alias(k) for k, g in zip(keys, groups)], *alongside, *shown)


def _searched(values: DataFrame, groups: Sequence[str], named: Mapping[str, Place]) -> DataFrame:
    """Percentiles strictly between 0 and 1 per group with values."""
    zero = F.lit(0).cast("long")
    inside = values.withColumns({"_slot": zero, "skipped": zero, "n": zero})
    for digits in range(1, DIGITS + 1):
        place = [*groups, "_slot", "skipped", "n"]
        counts = inside.groupBy(*place, leading(F.col("_key"), digits).alias("next")).agg(F.count(F.lit(1)).alias("size"))
        if digits == 1:
            counts = counts.withColumn("n", F.sum("size").over(W.partitionBy(*groups)))
        upto = F.sum("size").over(W.partitionBy(*groups, "_slot").orderBy("next"))
        ranked = counts.withColumn("skipped", F.col("skipped") + upto - F.col("size"))
        holds = F.exists(_ranks(named), lambda r: (r >= F.col("skipped")) & (r < F.col("skipped") + F.col("size")))
        slots = materialize(ranked.where(holds).select(*groups, F.col("next").alias("_slot"), "skipped", "n", "size"), "slots")
        facts = slots.agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest")).first()
        here = values.withColumn("_slot", leading(F.col("_key"), digits))
        inside = attach(here, slots.drop("size"), [*groups, "_slot"], rows=facts["rows"])
        if (facts["largest"] or 0) <= SLOT_ROWS:
            break
    counted = inside.groupBy(*groups, "_slot", "skipped", "n", F.col("_x").alias("x")).agg(F.count(F.lit(1)).alias("copies"))
    upto = F.sum("copies").over(W.partitionBy(*groups, "_slot").orderBy("x"))
    steps = counted.withColumn("past", F.col("skipped") + upto).withColumn("first", F.col("past") - F.col("copies"))
    return steps.groupBy(*groups).agg(*[_interpolate(p).alias(name) for name, p in named.items()])


def _spot(p: Place) -> Column:
    """Zero-based place, not always whole, among the ``n`` values of a key."""
    return (p(F.col("n")) if callable(p) else F.lit(p) * (F.col("n") - 1)).cast("double")


def _ranks(named: Mapping[str, Place]) -> Column:
    """Zero-based ranks on both sides of each place."""
    return F.array(*[edge(_spot(p)).cast("long") for p in named.values() for edge in (F.floor, F.ceil)])


def _interpolate(p: Place) -> Column:
    """Value at a place between its two neighbouring ranks."""
    spot = _spot(p)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank < F.col("past")), F.col("x")))

    below, above = at(F.floor(spot)), at(F.ceil(spot))
    weight = F.max(spot - F.floor(spot))
    return below + (above - below) * weight
