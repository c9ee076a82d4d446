"""N-gram Jaccard join: size-aware, heavy-light, and linear in groups of near copies.

Texts are sets of word shingles, given by 64-bit hashes.  The elements of a set
are ordered by a fixed global order, rarest first (by a count sketch), then by
hash.  Two sets that link share at least ``a`` elements, where ``a`` follows
from their sizes, so

- *light* sets (at most ``boundary`` elements) are found by enumerating the
  subsets of two elements of their first ``n - a + 2``: two of those are shared;
- *heavy* sets are found by scanning the inverted lists of their first
  ``n - a + 1`` elements: one of those is shared.  Light sets that a heavy one
  may link with are in these lists, too.

The boundary is where the cost of both, summed over the histogram of set sizes,
is least.  Equal sets are one set from the start.  A bucket (subset or list) is
first linked to its most central member; pairs of a bucket are only compared
where these links leave its members in several components, so components are
found at the cost of a group's size and not its square.  All links lie within
components; they are counted there, by shared elements of blocks of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import filtered_joins, stored
from panelmill.llm.components import components
from panelmill.runtime import release

WIDTH = 4
PERCENT = 85
SKETCH_BITS = 20
BLOCK_CHARS = 1 << 18  # of texts shingled at a time
LONG_WORD = 1 << 12
CHUNKS = 64
# Sets of a large component to a block, sets of small ones to a pack, elements compared at a time.
BLOCK_SETS, PACK_SETS, COLUMNS = 512, 64, 4096
BLOCK_ELEMENTS = 1 << 20
# What visiting an inverted list costs, in rows written for a subset.
VISIT = 4
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


# A random number for each byte, the same for both cases of a letter and none for white space.
_BYTES = _mix(_mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLY) * _MULTIPLY)
_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BYTES[_SPACE] = 0
_POWERS = np.cumprod(np.full(LONG_WORD, 0x9FB21C651E98DF25, np.uint64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and how many words each text has.

    A word's hash is a sum over its bytes, weighted by place; words beyond
    ``LONG_WORD`` bytes are hashed one by one.
    """
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    data = b" ".join(raw)
    points = np.frombuffer(data, np.uint8)
    space = _SPACE[points]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    edges = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
    n = np.diff(np.searchsorted(starts, edges))
    if not len(starts):
        return np.zeros(0, np.uint64), n
    # White space behind a word adds nothing.
    lengths = np.diff(starts, append=len(points))
    place = np.arange(starts[0], len(points)) - np.repeat(starts, lengths)
    terms = _BYTES[points[starts[0] :]] * _POWERS[place & (LONG_WORD - 1)]
    hashes = _mix(np.add.reduceat(terms, starts - starts[0]) * _MULTIPLY)
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        word = data[starts[i] : starts[i] + lengths[i]].rstrip().lower()
        if len(word) > LONG_WORD:
            hashes[i] = xxhash.xxh3_64_intdigest(word)
    return hashes, n


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct hashes of the word shingles of a text, ascending; a shorter text is one shingle, an empty one none."""
    return next(all_shingles([text], width))


def all_shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The shingles of each text in turn, hashed over the bytes of many texts at once."""
    ends = np.cumsum([len(t or "") for t in texts])
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + BLOCK_CHARS, "right")))
        yield from _block_shingles(texts[low:high], width)
        low = high


def _block_shingles(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    hashes, counts = word_hashes(texts)
    # Shingles across the end of a text are left out below.
    span = max(0, len(hashes) - width + 1)
    grams = hashes[:span]
    for j in range(1, width):
        grams = _mix(grams * _MULTIPLY) ^ hashes[j : span + j]
    grams = _mix(grams)
    at = 0
    for n in counts.tolist():
        start = at
        at += n
        if n >= width:
            found = np.sort(grams[start : at - width + 1])
            new = np.empty(len(found), bool)
            new[0] = True
            np.not_equal(found[1:], found[:-1], out=new[1:])
            yield found[new]
        elif n:
            yield np.array([xxhash.xxh3_64_intdigest(hashes[start:at].tobytes(), seed=n)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def least_own(n: int, percent: int) -> int:
    """Elements that a set of ``n`` shares at least with any set that it links with."""
    return -(-percent * n // 100)


def least_shared(a: Column, b: Column, percent: int) -> Column:
    """Elements that sets of sizes ``a`` and ``b`` share at least if they link."""
    return F.ceil((F.lit(percent) * (a + b)) / F.lit(100 + percent))


def can_link(n: int, percent: int) -> bool:
    """Whether a set of ``n`` can link with one that is not equal to it."""
    bigger = percent * (n + 1) // 100 <= n and -(-percent * (2 * n + 1) // (100 + percent)) <= n
    equal = -(-percent * 2 * n // (100 + percent)) <= n - 1
    smaller = n > 1 and -(-percent * (2 * n - 1) // (100 + percent)) <= n - 1
    return bigger or equal or smaller


def _sketch(docs: DataFrame, width: int) -> tuple[np.ndarray, dict[int, int]]:
    """Order level of each counter (a byte; about eight to a doubling) and the number of texts of each set size.

    Sizes beyond 100,000 share bins of 10,000, so that the histogram is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        sizes: dict[int, int] = {}
        held, many = [], 0
        for batch in batches:
            for found in all_shingles(batch.column("text").to_pylist(), width):
                n = len(found) if len(found) < 100_000 else len(found) // 10_000 * 10_000
                sizes[n] = sizes.get(n, 0) + 1
                held.append(found >> np.uint64(64 - SKETCH_BITS))
                many += len(found)
                if many > 1_000_000:
                    counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
                    held, many = [], 0
        if held:
            counts += np.bincount(np.concatenate(held).astype(np.int64), minlength=len(counts))
        # The counts only order elements, so a task may report at most 65,535 of each.
        parts = np.minimum(counts, 65_535).astype("<u2").reshape(CHUNKS, -1)
        yield pa.RecordBatch.from_pydict(
            {
                "chunk": pa.array([*range(CHUNKS), *[-1] * len(sizes)], pa.int32()),
                "size": pa.array([*[0] * CHUNKS, *sizes], pa.int64()),
                "texts": pa.array([*[0] * CHUNKS, *sizes.values()], pa.int64()),
                "counts": pa.array([*[p.tobytes() for p in parts], *[None] * len(sizes)], pa.binary()),
            }
        )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, "<u2").astype(np.int64) for c in frame["counts"])
        levels = np.minimum(255, 8 * np.log2(total + 1)).astype(np.uint8)
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "levels": [levels.tobytes()]})

    schema = "chunk int, size long, texts long, counts binary"
    found = stored(docs.select("text").mapInArrow(run, schema), "shingle-sketch")
    parts = found.where("chunk >= 0").select("chunk", "counts").groupBy("chunk")
    rows = sorted(parts.applyInPandas(add, "chunk int, levels binary").collect())
    levels = np.frombuffer(b"".join(r["levels"] for r in rows), np.uint8)
    sizes = found.where("chunk < 0").groupBy("size").agg(F.sum("texts").alias("texts")).collect()
    release(found)
    return levels if len(levels) else np.zeros(1 << SKETCH_BITS, np.uint8), {r["size"]: r["texts"] for r in sizes}


def cheapest_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light set: enumeration of pairs up to it and scans of lists beyond it cost least together."""
    bins = sorted((n, t) for n, t in sizes.items() if n and can_link(n, percent))
    first = {n: n - least_own(n, percent) + 1 for n, _ in bins}
    best, chosen = float("inf"), 0
    for bound in [0, *[n for n, _ in bins]]:
        cost = sum(t * first[n] * VISIT for n, t in bins if n > bound or 100 * n >= percent * (bound + 1))
        cost += sum(t * (first[n] + 1) * first[n] // 2 for n, t in bins if n <= bound)
        if cost < best:
            best, chosen = cost, bound
    return chosen


def _signed(docs: DataFrame, width: int, percent: int, levels: np.ndarray, boundary: int) -> DataFrame:
    """``doc_id, n, set_id, check, buckets, reach``: size and digest of each text's set, and its buckets.

    ``reach`` is how many elements the set can share at most with another one in
    the bucket, if what puts them there is the first that they share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, buckets, reach = [], [], [], []
            for found in all_shingles(batch.column("text").to_pylist(), width):
                size = len(found)
                n.append(size)
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), np.int64))
                own, far = [], []
                if can_link(size, percent):
                    first = size - least_own(size, percent) + 1
                    # Hashes ascend already; levels are bytes, which are sorted by counting.
                    order = np.argsort(levels[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    ordered = found[order[: first + 1]]
                    if size <= boundary:
                        i, j = np.triu_indices(len(ordered), 1)
                        own.append(_mix(ordered[i] * _MULTIPLY + np.uint64(1)) ^ _mix(ordered[j]))
                        far.append(size - j + 1)
                    if size > boundary or 100 * size >= percent * (boundary + 1):
                        own.append(ordered[:first])
                        far.append(size - np.arange(first))
                buckets.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
                reach.append(np.concatenate(far).astype(np.int32) if far else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array(buckets, pa.list_(pa.int64())),
                    pa.array(reach, pa.list_(pa.int32())),
                ],
                ["doc_id", "n", "set_id", "check", "buckets", "reach"],
            )

    schema = "doc_id long, n long, set_id long, check long, buckets array<long>, reach array<int>"
    return stored(docs.select("doc_id", "text").mapInArrow(run, schema), "shingle-sets")


def _elements(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``set_id, n, elements`` of the sets ``wanted`` (``set_id, doc_id``), from the texts of these documents.

    Sets that only rows without an id hold are found among all such rows.  Where
    the ids are too many to broadcast, a Bloom filter of them keeps nearly all
    other texts out of the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(all_shingles(batch.column("text").to_pylist(), width))
            ids = [int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)[0]) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["set_id", "n", "elements"],
            )

    schema = "set_id long, n long, elements binary"
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    ids = wanted.where("doc_id IS NOT NULL").select("doc_id", F.lit(1).alias("wanted")).distinct()
    ids = stored(ids, "wanted-ids").where("wanted = 1").select("doc_id")
    named = texts.join(ids, "doc_id", "left_semi").select("text").mapInArrow(run, schema)
    nameless = texts.where("doc_id IS NULL").select("text").mapInArrow(run, schema)
    nameless = nameless.join(wanted.where("doc_id IS NULL").select("set_id"), "set_id", "left_semi")
    nameless = nameless.groupBy("set_id").agg(F.first("n").alias("n"), F.first("elements").alias("elements"))
    with filtered_joins(docs.sparkSession):
        found = stored(named.union(nameless), "set-elements")
    release(ids)
    return found


def _verified(
    docs: DataFrame, signed: DataFrame, pairs: DataFrame, width: int, percent: int
) -> tuple[DataFrame, DataFrame | None]:
    """The pairs ``a, b`` of sets that link, and the elements of all sets in ``pairs``.  Only their texts are read again."""
    pairs = stored(pairs.distinct(), "set-pairs")
    if not pairs.take(1):
        return pairs, None
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    wanted = signed.select("set_id", "check", "doc_id").join(ends, "set_id", "left_semi").groupBy("set_id", "check")
    wanted = stored(wanted.agg(F.min("doc_id").alias("doc_id")).select("set_id", "doc_id"), "wanted-sets")
    elements = _elements(docs, wanted, width)
    release(wanted)

    @F.pandas_udf("boolean")
    def linked(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            shared = int((y[at] == x).sum())
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pd.Series(out, dtype=bool)

    left = elements.select(F.col("set_id").alias("a"), F.col("elements").alias("left"))
    right = elements.select(F.col("set_id").alias("b"), F.col("elements").alias("right"))
    met = pairs.join(left, "a").join(right, "b")
    links = stored(met.where(linked("left", "right")).select("a", "b").distinct(), "set-links")
    release(pairs)
    return links, elements


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # An element of one set is shared with none.
    often = times > 1
    place = (np.cumsum(often) - 1)[at]
    owner, place = owner[often[at]], place[often[at]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        holds = np.zeros((len(sets), COLUMNS), np.float32)
        holds[owner[a:b], place[a:b] - low] = 1
        out += (holds @ holds.T).astype(np.int64)
    return out


def _count_links(placed: DataFrame, elements: DataFrame, percent: int) -> DataFrame:
    """``set_id, n_links``: with how many other sets each set of the components ``set_id, group`` links.

    A component of more than ``BLOCK_SETS`` sets (or ``BLOCK_ELEMENTS`` elements) is cut into blocks by hash, and
    each two of its blocks meet in one group; smaller ones share packs, where
    sets of different components do not link anyway.
    """
    lengths = elements.select("set_id", "n").distinct()
    sizes = placed.join(lengths, "set_id").groupBy("group").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    sizes = stored(sizes, "component-sizes")
    sets, held = (x or 0 for x in sizes.agg(F.sum("size"), F.sum("n")).first())
    packs = max(1, sets // PACK_SETS, held // BLOCK_ELEMENTS)
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK_SETS, F.col("n") / BLOCK_ELEMENTS)).cast("int")
    cut = placed.join(sizes, "group").withColumn("blocks", blocks)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    whole = F.col("blocks") == 1
    cut = cut.withColumn("part", F.when(whole, F.pmod(F.xxhash64("group"), F.lit(packs))).otherwise(F.col("group")))
    met = cut.drop("n").join(elements, "set_id").select(
        "set_id", whole.alias("whole"), "part", "block", "elements", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    met = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("other")

    def count(rows: pa.Table) -> pa.Table:
        ids, first = np.unique(rows["set_id"].to_numpy(), return_index=True)
        block = rows["block"].to_numpy()[first]
        held = rows["elements"].to_pylist()
        sets = [np.frombuffer(held[i], np.uint64) for i in first]
        shared, n = _shared(sets), np.array([len(x) for x in sets])
        links = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
        np.fill_diagonal(links, False)
        if rows["low"][0].as_py() != rows["high"][0].as_py():
            links &= block[:, None] != block[None, :]
        return pa.table({"set_id": pa.array(ids), "n_links": pa.array(links.sum(axis=1).astype(np.int64))})

    found = met.groupBy("whole", "part", "low", "high").applyInArrow(count, "set_id long, n_links long")
    return found.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))


def jaccard_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, count_links: bool = True
) -> DataFrame:
    """``doc_id, n_shingles, class_id, n_links, component_id`` for each row of ``doc_id, text``.

    Words are split at ASCII white space with A-Z lower-cased; the set of a text
    is its distinct shingles of ``width`` words (the whole sequence as one for a
    shorter text).  Two texts link when ``100 * shared >= percent * union``.
    ``class_id`` is the smallest id with an equal set, ``component_id`` the
    smallest id that links reach, ``n_links`` the number of other sets that link
    with its own (left out without ``count_links``).

    A null or empty text, or one without words, has no shingles and links with
    nothing: its ids are its own.  Repeated rows stay and are alike; a row
    without an id takes part and gets the smallest id of its component, if any
    row there has one.  An empty table gives no rows; other columns are not
    read.  Sets are told apart by 128-bit digests, elements by 64-bit hashes.
    """
    levels, sizes = _sketch(docs, width)
    signed = _signed(docs, width, percent, levels, cheapest_boundary(sizes, percent))
    posted = signed.where(F.size("buckets") > 0).select(
        F.explode(F.arrays_zip("buckets", "reach")).alias("p"), "set_id", "n"
    )
    posted = posted.select(F.col("p.buckets").alias("bucket"), "set_id", "n", F.col("p.reach").alias("reach"))
    # Most buckets hold one set; the rest is small.  Copies meet before the shuffle.
    shared = posted.groupBy("bucket").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high"))
    shared = stored(shared.where("low < high").select("bucket"), "shared-buckets")
    members = stored(posted.join(shared, "bucket", "left_semi").distinct(), "bucket-members")
    release(shared)
    # The buckets are most of the stored sets and not needed again.
    with_buckets, signed = signed, stored(signed.select("doc_id", "n", "set_id", "check"), "set-names")
    release(with_buckets)

    def fits(a: str, b: str) -> Column:
        need = least_shared(F.col(f"{a}.n"), F.col(f"{b}.n"), percent)
        return F.least(f"{a}.reach", f"{b}.reach", f"{a}.n", f"{b}.n") >= need

    # The most central member of a bucket is in most shared buckets.
    central = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("weight"))
    hubs = members.join(central, "set_id").groupBy("bucket").agg(
        F.max(F.struct("weight", "set_id", "n", "reach")).alias("hub")
    )
    hubs = hubs.select("bucket", F.col("hub.set_id").alias("set_id"), F.col("hub.n").alias("n"), F.col("hub.reach").alias("reach"))
    spokes = members.alias("m").join(hubs.alias("h"), "bucket").where(F.col("m.set_id") != F.col("h.set_id"))
    spokes = spokes.where(fits("m", "h")).select(F.col("m.set_id").alias("a"), F.col("h.set_id").alias("b"))
    near, elements = _verified(docs, signed, spokes, width, percent)
    first = components(near).withColumnRenamed("node", "set_id")
    # What is left: members of one bucket in several components.  The largest
    # component of a bucket is met by the others, never by itself.
    placed = members.join(first, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    mixed = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("rows"))
    mixed = mixed.groupBy("bucket").agg(
        F.max(F.struct("rows", "component")).alias("main"), F.count(F.lit(1)).alias("several")
    )
    mixed = mixed.where("several > 1").select("bucket", F.col("main.component").alias("main"))
    open_rows = stored(placed.join(mixed, "bucket").withColumn("minor", F.col("component") != F.col("main")), "mixed-buckets")
    rest = open_rows.where("minor").alias("m").join(open_rows.alias("o"), "bucket")
    rest = rest.where(F.col("m.component") != F.col("o.component")).where(
        ~F.col("o.minor") | (F.col("m.set_id") < F.col("o.set_id"))
    )
    pairs = rest.where(fits("m", "o")).select(
        F.least("m.set_id", "o.set_id").alias("a"), F.greatest("m.set_id", "o.set_id").alias("b")
    )
    release(members)
    far, more = _verified(docs, signed, pairs, width, percent)
    release(open_rows, first)
    links = near.union(far)
    linked = components(links).withColumnsRenamed({"node": "set_id", "component": "group"})
    held = [x for x in (elements, more) if x is not None]
    ends = linked.select("set_id", F.lit(0).cast("long").alias("n_links"))
    if count_links and held:
        ends = _count_links(linked, held[0].union(held[-1]) if len(held) > 1 else held[0], percent)
    classes = signed.where("n > 0").groupBy("set_id", "check").agg(F.min("doc_id").alias("class_id"))
    classes = classes.join(linked, "set_id", "left").join(ends, "set_id", "left")
    alone = F.col("group").isNull()
    key = [F.coalesce("group", "set_id").alias("group"), F.when(alone, F.col("check")).otherwise(F.lit(0)).alias("part")]
    classes = stored(classes.select("set_id", "check", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), *key), "set-classes")
    release(near, far, linked, ends, *held)
    lowest = classes.groupBy("group", "part").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(lowest, ["group", "part"]).drop("group", "part")
    # Copies are many rows of one key; adaptive execution splits them.
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "set_id", "check").join(
        classes, ["set_id", "check"], "left"
    ).select(
        "doc_id",
        "n_shingles",
        F.coalesce(F.when(F.col("n_shingles") > 0, F.col("class_id")), "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "doc_id").alias("component_id"),
    )
    return out if count_links else out.drop("n_links")
