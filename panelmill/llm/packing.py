"""Packing: documents cut into pieces and packed into sequences over the histogram of lengths.

Shortest pack first: lengths are placed longest first, each into the packs with
the most room, and only counts of packing patterns are kept.  The histogram has
one bin per length up to the capacity, so the plan is small at any input size;
pieces are joined to their pattern by their rank among pieces of one length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.llm.common import stored
from panelmill.llm.tokens import Encoder, encoded

CAPACITY = 1024
RANK_ROWS = 8_000  # of one length that are ranked together, each with up to 4 KB of ids
HELD_PIECES = 1_000


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ``[(length, copies), ...]`` with the number of packs that follow each.

    A length goes to the packs with the most room; where none has room, new
    packs take as many copies as they hold.
    """
    packs: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        fresh: dict[int, list] = defaultdict(list)
        for room in sorted((r for r in packs if r >= length), reverse=True):
            # Most room first; what is placed may leave room for another copy.
            copies = 1 if room < 2 * length else room // length
            while left and packs[room]:
                pattern, count = packs[room].pop()
                fit = min(copies, left)
                used = min(count, left // fit)
                fresh[room - fit * length].append((pattern + ((length, fit),), used))
                left -= used * fit
                if count > used:
                    packs[room].append((pattern, count - used))
            if not left:
                break
        each = capacity // length
        for copies, count in ((each, left // each), (left % each, 1)):
            if copies and count:
                fresh[capacity - copies * length].append((((length, copies),), count))
        for room, found in fresh.items():
            packs[room].extend(found)
    return [(list(pattern), count) for found in packs.values() for pattern, count in found]


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> pd.DataFrame:
    """Ranks of each length and where they go: rank ``first + i`` is in sequence ``sequence + i``."""
    rows, sequence, ranks = [], 0, defaultdict(int)
    for pattern, count in sorted(patterns, reverse=True):
        offset = 0
        for length, copies in pattern:
            for _ in range(copies):
                rows.append((length, ranks[length], sequence, offset))
                ranks[length] += count
                offset += length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"])


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids, with the ids as little-endian unsigned 32-bit bytes."""
    end, wide = np.array([end_id], np.uint32), 4 * capacity
    names = ["doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            texts = encoded(encoder, batch.column("text"))
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.concatenate([found, end]).astype("<u4").tobytes()
                for at in range(0, len(ids), wide):
                    piece = ids[at : at + wide]
                    out.append((doc_id, at // 4, len(piece) // 4, len(ids) // 4, piece, zlib.crc32(piece)))
                if len(out) >= HELD_PIECES:
                    yield _batch(out, names)
                    out = []
            if out:
                yield _batch(out, names)

    schema = "doc_id long, start long, length long, doc_tokens long, ids binary, ids_crc32 long"
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.binary() if n == "ids" else pa.int64() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS
) -> DataFrame:
    """Pack ``doc_id, text`` into sequences of at most ``capacity`` ids.

    Each document is its ids and ``end_id``, cut into full pieces and a rest.
    Returns a row per piece: ``doc_id, start, length, doc_tokens, ids,
    ids_crc32, sequence_id, offset``; offsets in a sequence have no gap.  A null
    or empty text is one piece of the end id; repeated rows and null ids are
    packed like any others; an empty table gives no rows; other columns are not
    read.
    """
    pieces = stored(cut_documents(docs, tokenizer, end_id, capacity), "pieces")
    # At most one row per length.
    bins = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = slots(shortest_pack_first(bins, capacity))
    # A length may hold most pieces, so ranks are counted in buckets of it.
    buckets = max(1, -(-sum(bins.values()) // rank_rows))
    ranked = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = ranked.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = ranked.withColumn("place", F.row_number().over(within) - 1).join(bases, ["length", "bucket"])
    shift = int(max(bins.values(), default=0)) + 1
    key = (plan["length"] * shift + plan["first"]).to_numpy(np.int64)
    order = np.argsort(key)
    key, first, sequence, offset = (
        x[order] for x in (key, *(plan[c].to_numpy(np.int64) for c in ("first", "sequence", "offset")))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, length.to_numpy(np.int64) * shift + rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy(np.int64) - first[at], "offset": offset[at]})

    placed = ranked.withColumn("placed", place("length", F.col("base") + F.col("place")))
    return placed.select("doc_id", "start", "length", "doc_tokens", "ids", "ids_crc32", "placed.*")
