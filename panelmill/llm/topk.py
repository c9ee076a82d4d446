"""Exact top-k search by inner product with a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.llm.common import stored

SLICES = 2
ROW_BLOCK = 4096
QUERY_BLOCK = 1024
PAIRS_PER_TASK = 4


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: as doubles while these can hold every sum."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


def _pack(key: str):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        out = {
            "dim": [frame["dim"].iloc[0]],
            key: [frame[key].iloc[0]],
            "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
            "data": [np.stack(frame["vector"].to_numpy()).astype(np.float64).tobytes()],
        }
        if "cutoff" in frame:
            out["cutoffs"] = [frame["cutoff"].to_numpy(np.float64).tobytes()]
        return pd.DataFrame(out)

    return pack


def _sides(row: dict, dim: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Row ids, per-slice scores (queries x rows), query ids; a query's own row scores minus infinity."""
    ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
    rows, queries = np.frombuffer(row["data"]).reshape(-1, dim), np.frombuffer(row["query_data"]).reshape(-1, dim)
    parts = [_products(queries[:, s::SLICES], rows[:, s::SLICES]) for s in range(min(SLICES, dim))]
    own = query_ids[:, None] == ids[None, :]
    for part in parts:
        part[own] = -np.inf
    return ids, parts, query_ids, own


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest scores of each row, in no order."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, k, axis=1)[:, :k]


def top_k(vectors: DataFrame, queries: Column, k: int = 20) -> DataFrame:
    """The ``k`` rows with the highest inner product for each row of ``vec_id, vector`` that ``queries`` holds for.

    ``vector`` is an array of whole numbers as doubles; rows that are null or
    hold a null, NaN or infinite component take no part, and neither do rows
    without an id.  Equal rows count once; a query never meets its own id;
    vectors of another length have no score; ties go to the smaller id.  Returns
    ``query_id, rank, vec_id, score``.  An empty table gives no rows; other
    columns are not read.  Inner products must fit 64 bits.

    A node of the uniform threshold is one slice of the components over one
    block of rows.  Phase 1: each node lists its ``k`` best rows by its own part
    of the score; the ``k``-th best whole score among the listed rows is a safe
    cutoff.  Phase 2: a row at or above the cutoff has at least ``cutoff /
    slices`` in one slice, so those entries suffice.  Phase 3: the other slices
    of the collected entries are resolved, and ``k`` rows of each block at most
    go on.  Queries and rows meet in blocks.
    """
    fine = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", "vector", F.coalesce(queries, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & fine)
    rows = stored(rows.distinct().withColumn("dim", F.size("vector")), "vectors")
    count, asked = rows.agg(F.count(F.lit(1)), F.count_if("asked")).first()
    row_blocks, query_blocks = max(1, -(-count // ROW_BLOCK)), max(1, -(-asked // QUERY_BLOCK))
    number = F.xxhash64("vec_id", "vector")
    blocks = rows.withColumn("block", F.pmod(number, F.lit(row_blocks)).cast("int"))
    blocks = blocks.groupBy("dim", "block").applyInPandas(_pack("block"), "dim int, block int, ids binary, data binary")
    blocks = stored(blocks, "row-blocks")
    ask = rows.where("asked").withColumn("query_block", F.pmod(number, F.lit(query_blocks)).cast("int"))

    def meet(packed: DataFrame) -> DataFrame:
        """A row for each block of rows and block of queries of one length."""
        renamed = packed.withColumnsRenamed({"ids": "query_ids", "data": "query_data"})
        every = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
        pairs = blocks.withColumn("query_block", every).join(renamed, ["dim", "query_block"])
        tasks = max(1, -(-row_blocks * query_blocks // PAIRS_PER_TASK))
        return pairs.repartition(tasks, "dim", "block", "query_block")

    schema = "dim int, query_block int, ids binary, data binary"
    packed = stored(ask.groupBy("dim", "query_block").applyInPandas(_pack("query_block"), schema), "query-blocks")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                _, parts, query_ids, _ = _sides(row, row["dim"])
                listed = np.concatenate([_best(p, k) for p in parts], axis=1)
                listed = np.sort(listed, axis=1)
                whole = np.take_along_axis(sum(parts), listed, axis=1).astype(np.float64)
                # A row listed by several slices counts once.
                whole[:, 1:][listed[:, 1:] == listed[:, :-1]] = -np.inf
                best = np.take_along_axis(whole, _best(whole, k), axis=1)
                at, column = np.nonzero(best > -np.inf)
                yield pa.RecordBatch.from_pydict({"query_id": query_ids[at], "score": best[at, column]})

    # One row per query at most stays of each block's list after the limit.
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"))
    gathered = meet(packed).mapInArrow(lists, "query_id long, score double")
    ranked = gathered.withColumn("place", F.row_number().over(by_query)).where(F.col("place") <= k)
    cutoffs = ranked.where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))
    cut = ask.join(cutoffs, "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(float("-inf"))))
    packed = cut.groupBy("dim", "query_block").applyInPandas(_pack("query_block"), schema + ", cutoffs binary")
    packed = stored(packed, "query-cutoffs")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                ids, parts, query_ids, own = _sides(row, row["dim"])
                cutoff = np.frombuffer(row["cutoffs"])
                enough = np.zeros(own.shape, bool)
                for part in parts:
                    enough |= len(parts) * part >= cutoff[:, None]
                at, column = np.nonzero(enough & ~own)
                whole = sum(p[at, column] for p in parts)
                keep = whole >= cutoff[at]
                at, column, whole = at[keep], column[keep], whole[keep]
                order = np.lexsort((ids[column], -whole, at))
                at, column, whole = at[order], column[order], whole[order]
                place = np.arange(len(at)) - np.searchsorted(at, at)
                at, column, whole = (x[place < k] for x in (at, column, whole))
                found = {"query_id": query_ids[at], "vec_id": ids[column], "score": whole.astype(np.int64)}
                yield pa.RecordBatch.from_pydict(found)

    found = meet(packed).mapInArrow(resolve, "query_id long, vec_id long, score long")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
