"""Benchmark decontamination by latent semantic retrieval, checked by longest common subsequences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import stored, words
from panelmill.llm.lines import LOWER, UPPER
from panelmill.runtime import release

BLOCK = 16  # words; passages are WINDOW blocks, one from every block
WINDOW = 2
RANK = 64
OVERSAMPLE = 16
POWER_ROUNDS = 1
FEATURES = 1 << 15  # words of a block of items; all of them count, and words of most documents fill up
COMMON = 0.1  # words in a larger share of the documents weigh nothing
ITEM_WEIGHT = 4.0
CORPUS_WEIGHT = 10_000  # passages; what all passages of the documents weigh together, if there are more
HELD_WORDS = 300_000  # counted by a task before it reports them
FIT_WORDS = 200_000  # multiplied at a time
QR_ROWS = 4096  # orthonormalised at a time
ITEM_BLOCK = 4096
ITEM_BYTES = 8 << 20
MIN_COSINE = 0.5
LITERAL = 0.8
PARAPHRASE = 0.6
SHORT = 8  # words; shorter items must occur literally
CHUNKS = 256
NAMES = ["doc_id", "item_id", "cosine", "lcs", "answered", "near_word"]
SCHEMA = "doc_id long, item_id long, cosine double, lcs double, answered boolean, near_word long"


def answer_of(text: str) -> list[bytes]:
    """The last sentence of an item, or its last five words if it is one sentence."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if words(s)]
    last = words(sentences[-1]) if sentences else []
    return last if len(sentences) > 1 else last[-5:]


def common_subsequence(masks: dict, length: int, text: list) -> int:
    """Length of the longest common subsequence; ``masks`` has a bit for each place of a word among ``length``."""
    full = (1 << length) - 1
    row = full
    for word in text:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return length - row.bit_count()


def _contains(text: list[int], part: list[int]) -> bool:
    n = len(part)
    return bool(part) and any(text[i : i + n] == part for i, w in enumerate(text) if w == part[0])


@dataclass
class Item:
    """An item whose words are given by their features."""

    item_id: int
    words: list[int]
    answer: list[int]
    masks: dict[int, int]
    bag: Counter


def _item(item_id: int, found: list[int], answer: list[int]) -> Item:
    masks: dict[int, int] = {}
    for i, w in enumerate(found):
        masks[w] = masks.get(w, 0) | 1 << i
    return Item(item_id, found, answer, masks, Counter(found))


# --- words --------------------------------------------------------------------


def _flat_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts one after the other, those that ``words`` gives, and how many each text has."""
    held = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    found, n = held.flatten(), pc.list_value_length(held).fill_null(0).to_numpy().astype(np.int64)
    # White space at an end of a text leaves an empty part there.
    empty = pc.equal(pc.binary_length(found), 0)
    if pc.any(empty).as_py():
        n -= np.bincount(pc.list_parent_indices(held).filter(empty).to_numpy(), minlength=len(n))
        found = found.filter(pc.invert(empty))
    return found.cast(pa.binary()).dictionary_encode(), n


def _word_counts(docs: DataFrame) -> DataFrame:
    """``word, texts``: how many texts hold each word; the row without a word has the number of texts."""

    def counted(texts: pa.Array) -> pa.Table:
        found, n = _flat_words(texts)
        many = max(len(found.dictionary), 1)
        key = np.sort(np.repeat(np.arange(len(n)), n) * many + found.indices.to_numpy())
        first = np.flatnonzero(np.diff(key, prepend=-1))
        counts = np.bincount(key[first] % many, minlength=many)[: len(found.dictionary)]
        return pa.table({"word": found.dictionary, "texts": counts})

    def merged(held: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("texts", "sum")])
        return pa.table({"word": sums["word"], "texts": sums["texts_sum"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, texts = [], 0, 0
        for batch in batches:
            texts += batch.num_rows
            held.append(counted(batch.column("text")))
            rows += held[-1].num_rows
            if rows > HELD_WORDS:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > HELD_WORDS:
                    yield from held[0].to_batches()
                    held, rows = [], 0
        if held:
            yield from merged(held).to_batches()
        yield pa.RecordBatch.from_pydict({"word": pa.array([None], pa.binary()), "texts": pa.array([texts], pa.int64())})

    found = docs.select("text").mapInArrow(run, "word binary, texts long")
    return stored(found.groupBy("word").agg(F.sum("texts").alias("texts")), "word-counts")


def _pairs(counts: DataFrame) -> dict[bytes, int]:
    """``word, texts`` on the driver, through Arrow: rows of Python objects take several times the memory."""
    found = counts.select("word", "texts").toArrow()
    return dict(zip(found["word"].to_pylist(), found["texts"].to_pylist(), strict=True))


def _vocabulary(counts: DataFrame, own: set[bytes]) -> dict[bytes, int]:
    """In how many texts each feature occurs: all of ``own``, filled up to ``FEATURES`` by the words of most texts."""
    spark = counts.sparkSession
    rows = spark.createDataFrame([(w,) for w in sorted(own)], "word binary")
    out = dict.fromkeys(sorted(own), 0)
    out |= _pairs(counts.join(F.broadcast(rows), "word"))
    most = counts.where("word IS NOT NULL").orderBy(F.desc("texts"), "word").limit(FEATURES)
    fresh = ((word, texts) for word, texts in _pairs(most).items() if word not in own)
    return out | dict(islice(fresh, max(0, FEATURES - len(own))))


def _as_features(docs: DataFrame, lookup: Broadcast) -> DataFrame:
    """``doc_id, n, features``: the number of words of each text and their features, -1 for none, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(list(lookup.value), pa.binary())
        numbers = np.append(np.fromiter(lookup.value.values(), "<i4"), np.int32(-1))
        for batch in batches:
            found, n = _flat_words(batch.column("text"))
            place = pc.index_in(found.dictionary, known).fill_null(len(known)).to_numpy()
            features = numbers[place][found.indices.to_numpy()]
            ends = np.append(0, np.cumsum(4 * n)).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(features)])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), held]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "features"])

    coded = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, features binary")
    return stored(coded, "text-features")


# --- fit ----------------------------------------------------------------------


def _parts(n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the part of ``size`` words that each word lies in, over texts of ``n`` words, and the parts of each text."""
    parts = -(-n // size)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.cumsum(parts) - parts, n) + place // size, parts


def _run_sums(table: np.ndarray, at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``value``, which ascends, and the sum of the rows ``at`` of ``table`` for each.

    The longest runs come first, so what has a next row is always the front.
    """
    first = np.flatnonzero(np.diff(value, prepend=-1))
    length = np.diff(first, append=len(value))
    order = np.argsort(-length, kind="stable")
    start, length = first[order], length[order]
    sums = table[at[start]]
    for j in range(1, int(length.max(initial=0))):
        many = int(np.searchsorted(-length, -j))
        if many < 32:
            for i in range(many):
                end = start[i] + length[i]
                for low in range(start[i] + j, end, 1024):
                    sums[i] += table[at[low : min(low + 1024, end)]].sum(axis=0)
            break
        sums[:many] += table[at[start[:many] + j]]
    return value[start], sums


def _gathered(table: np.ndarray, at: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """Sums of the rows ``at`` of ``table`` over each of ``parts`` parts; ``part`` ascends."""
    out = np.zeros((parts, table.shape[1]), np.float32)
    found, sums = _run_sums(table, at, part)
    out[found] = sums
    return out


def _add_product(out: np.ndarray, at: np.ndarray, part: np.ndarray, weight: np.ndarray, table: np.ndarray) -> None:
    """Adds ``A' A basis`` to ``out``, where row ``part[i]`` of ``A`` holds word ``at[i]``, weighted and of length one.

    ``table`` is the basis with its rows weighted; ``out`` lacks the weights of its own rows.
    """
    many = int(part[-1]) + 1
    shift = many.bit_length()
    key = np.sort(at.astype(np.int64) << shift | part)
    feature, row = key >> shift, key & ((1 << shift) - 1)
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    value = np.diff(starts, append=len(key)) * weight[feature[starts]]
    squares = np.bincount(row[starts], value * value, minlength=many)
    rows = _gathered(table, at, part, many) / np.maximum(squares, 1e-24)[:, None].astype(np.float32)
    found, sums = _run_sums(rows, row, feature)
    out[found] += sums


def _weighted(basis: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The rows of ``basis`` times their weights, rounded to floats without a matrix of doubles between."""
    return np.multiply(basis, weight[:, None], out=np.empty(basis.shape, np.float32), casting="unsafe")


def _product(coded: DataFrame, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``A' A basis`` for the weighted TF-IDF matrix ``A`` of all passages of all texts, one beginning where one ends."""
    table = _weighted(basis, weight)
    shared = coded.sparkSession.sparkContext.broadcast((weight, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, table = shared.value
        heavy = np.append(weight > 0, False)  # the last place is that of feature -1
        out = np.zeros(table.shape)
        for batch in batches:
            n = batch.column("n").to_numpy()
            at = np.frombuffer(b"".join(batch.column("features").to_pylist()), "<i4")
            part, _ = _parts(n, BLOCK * WINDOW)
            used = heavy[at]
            at, part = at[used], part[used]
            # Whole passages of about ``FIT_WORDS`` words at a time.
            low = 0
            while low < len(at):
                high = int(np.searchsorted(part, part[min(low + FIT_WORDS, len(part)) - 1], "right"))
                _add_product(out, at[low:high], part[low:high] - part[low], weight, table)
                low = high
        parts = [p.tobytes() for p in np.array_split(out, CHUNKS)]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "part": pa.array(parts, pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p) for p in frame["part"])
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "part": [total.tobytes()]})

    parts = coded.select("n", "features").mapInArrow(run, "chunk int, part binary")
    del table
    rows = parts.groupBy("chunk").applyInPandas(add, "chunk int, part binary").toArrow()
    shared.destroy()
    out = np.zeros(basis.shape)
    places = np.array_split(out, CHUNKS)  # views
    for chunk, part in zip(rows["chunk"].to_pylist(), rows["part"], strict=True):
        place = places[chunk]
        place[:] = np.frombuffer(part.as_buffer()).reshape(place.shape)
    out *= weight[:, None]
    return out


def _orthonormalised(product: np.ndarray) -> np.ndarray:
    """Writes the Q of ``product = Q R`` over ``product`` and returns R: blocks of rows first, then their factors.

    The library's own form holds four more matrices of this size.
    """
    width = product.shape[1]
    blocks = np.array_split(product, max(1, len(product) // max(QR_ROWS, width)))  # views
    factors = []
    for block in blocks:
        block[:], factor = np.linalg.qr(block)
        factors.append(factor)
    turn, factor = np.linalg.qr(np.concatenate(factors))
    for i, block in enumerate(blocks):
        block[:] = block @ turn[i * width : (i + 1) * width]
    return factor


def latent_space(coded: DataFrame, items: list[Item], weight: np.ndarray, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (features x rank) of the TF-IDF passages of all texts, and all items, by randomised SVD.

    Every passage counts.  Those of the texts weigh together as ``CORPUS_WEIGHT``
    passages where there are more of them, and an item as ``ITEM_WEIGHT`` squared,
    so the items keep their share at any size.  The products with the passages
    run on the cluster; the driver takes in the items (a block of bounded bytes)
    and orthonormalises matrices of features x rank.  The last product also
    gives the vectors (Nystroem), without another run over the passages.
    """
    passages = coded.agg(F.sum(F.ceil(F.col("n") / F.lit(BLOCK * WINDOW)))).first()[0] or 0
    share = min(1.0, CORPUS_WEIGHT / max(passages, 1))
    held = [(i, w) for i, item in enumerate(items) for w in item.words if weight[w] > 0]
    owner, at = (np.array(x, np.int64) for x in zip(*held)) if held else (np.zeros(0, np.int64),) * 2
    width = min(rank + OVERSAMPLE, len(weight))
    product = np.random.default_rng(seed).standard_normal((len(weight), width))
    for _ in range(1 + POWER_ROUNDS):
        # One matrix holds the product and then its basis; what is not needed goes before the next is made.
        basis = product
        _orthonormalised(basis)
        product = _product(coded, weight, basis)
        product *= share
        if held:
            own = np.zeros(product.shape)
            _add_product(own, at, owner, weight, _weighted(basis, weight))
            own *= ITEM_WEIGHT**2 * weight[:, None]
            product += own
            del own
    inner = basis.T @ product
    del basis
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    kept = values > 1e-7 * max(values[-1], 1e-12)
    if not kept.any():
        return np.zeros((len(weight), 1), np.float32)
    product = product @ (turn[:, kept] / np.sqrt(values[kept]))
    axes, _, _ = np.linalg.svd(_orthonormalised(product))
    return (product @ axes[:, :rank]).astype(np.float32)


# --- search -------------------------------------------------------------------


def _passages(at: np.ndarray, n: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of the passages of several texts, the text of each, and its first passage.

    ``at`` holds the features of all words (-1: none), ``n`` the words of each
    text.
    """
    block, blocks = _parts(n, BLOCK)
    ends = np.cumsum(blocks)
    owner = np.repeat(np.arange(len(n)), blocks)
    used = np.flatnonzero(at >= 0)
    sums = _gathered(vectors, at[used], block[used], int(ends[-1]))
    passages = sums.copy()
    for s in range(1, min(WINDOW, len(owner))):
        passages[:-s] += sums[s:] * (owner[s:] == owner[:-s])[:, None]
    passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-12)
    return passages, owner, ends - blocks


class _Anchors:
    """Items by the feature of their weightiest word, for finding literal copies whatever their cosine."""

    def __init__(self, items: list[Item], weight: np.ndarray) -> None:
        # Words of no weight are not looked up.
        features = [[w if weight[w] > 0 else -1 for w in item.words] for item in items]
        ranked = [sorted(range(len(i.words)), key=lambda j: (-weight[i.words[j]], j)) for i in items]
        anchor = np.array([f[r[0]] for f, r in zip(features, ranked, strict=True)])
        self.items = np.argsort(anchor, kind="stable")
        # Items of one anchor feature lie between two bounds.
        self.bounds = np.searchsorted(anchor[self.items], np.arange(len(weight) + 1))
        self.length = np.array([len(f) for f in features])
        # Where each item has its anchor, first, last and second weightiest word, and their features.
        self.places = np.array([[r[0], 0, len(r) - 1, r[min(1, len(r) - 1)]] for r in ranked])
        self.features = np.array([[f[j] for j in at] for f, at in zip(features, self.places.tolist(), strict=True)])

    def candidates(self, at: np.ndarray, starts: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Text, item and first word (in the text) of places that agree in these words.

        ``at`` has the features of all words, ``starts`` and ``n`` the bounds of the texts.
        """
        many = np.where(at < 0, 0, self.bounds[at + 1] - self.bounds[at])
        hits = np.flatnonzero(many)
        for part in np.split(hits, np.flatnonzero(np.diff(np.cumsum(many[hits]) >> 20)) + 1):
            times = many[part]
            p = np.repeat(part, times)
            turn = np.arange(len(p)) - np.repeat(np.cumsum(times) - times, times)
            i = self.items[self.bounds[at[p]] + turn]
            d = np.searchsorted(starts, p, "right") - 1
            low = p - self.places[i, 0]
            inside = (low >= starts[d]) & (low + self.length[i] <= starts[d] + n[d])
            d, i, low = d[inside], i[inside], low[inside]
            same = (at[low[:, None] + self.places[i]] == self.features[i]).all(axis=1)
            yield from zip(d[same].tolist(), i[same].tolist(), (low - starts[d])[same].tolist(), strict=True)


def _word_bits(known: list[Item], features: int) -> np.ndarray:
    """A row of bits for each item: which features its words are; the last is that of no feature."""
    bits = np.zeros((len(known), features // 8 + 1), np.uint8)
    for row, item in zip(bits, known, strict=True):
        at = np.array(item.words)
        np.bitwise_or.at(row, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return bits


def _held_words(bits: np.ndarray, i: np.ndarray, texts: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many words of the passages that begin at ``start`` the items ``i`` hold; texts go up to ``end``."""
    place = start[:, None] + np.arange(BLOCK * WINDOW)
    found = texts[np.minimum(place, len(texts) - 1)]
    # A feature of -1 has no bit in any item, nor has what lies behind the text.
    held = bits[i[:, None], found >> 3] >> (found & 7) & 1
    return (held.astype(bool) & (found >= 0) & (place < end[:, None])).sum(axis=1)


def _search(
    doc_ids: list,
    n: np.ndarray,
    texts: np.ndarray,
    heavy: np.ndarray,
    vectors: np.ndarray,
    wanted: np.ndarray,
    known: list[Item],
    bits: np.ndarray,
    anchors: _Anchors,
    min_cosine: float,
) -> Iterator[pa.RecordBatch]:
    """Leaks in texts of ``n`` words, whose features follow each other in ``texts``."""
    if not n.sum():
        return
    at = np.where(heavy[texts], texts, -1)
    starts = np.cumsum(n) - n
    held = [texts[s : s + m] for s, m in zip(starts.tolist(), n.tolist(), strict=True)]
    passages, owner, first = _passages(at, n, vectors)
    # Some passage holds 17 words of a longer item, or all of a shorter one.
    least = PARAPHRASE * np.minimum([len(item.words) for item in known], BLOCK + 1)
    best: dict[tuple[int, int], tuple] = {}
    for lo in range(0, len(passages), 16_384):
        cosine = passages[lo : lo + 16_384] @ wanted
        near, item = np.divmod(np.flatnonzero(cosine >= min_cosine), len(known))
        for part in range(0, len(near), 8192):
            p, i = near[part : part + 8192], item[part : part + 8192]
            d = owner[lo + p]
            low = (lo + p - first[d]) * BLOCK
            enough = _held_words(bits, i, texts, starts[d] + low, starts[d] + n[d]) >= least[i]
            for p, i, d, low in zip(*(x[enough].tolist() for x in (p, i, d, low)), strict=True):
                found = _checked(held[d], known[i], low)
                if found and ((d, i) not in best or found[0] > best[d, i][1]):
                    best[d, i] = (float(cosine[p, i]), *found)
    for d, i, low in anchors.candidates(at, starts, n):
        if (d, i) in best and best[d, i][1] == 1:
            continue
        if held[d][low : low + len(known[i].words)].tolist() == known[i].words:
            passage = passages[first[d] + low // BLOCK]
            best[d, i] = (float(passage @ wanted[:, i]), 1.0, True, low)
    if best:
        rows = [(doc_ids[d], known[i].item_id, *found) for (d, i), found in sorted(best.items())]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], NAMES)


def _checked(document: np.ndarray, item: Item, at: int) -> tuple[float, bool, int] | None:
    """Share of the item's words in order, whether its answer stands there, and where, if that makes a leak."""
    m = len(item.words)
    # The passage may be any part of the item, or hold all of it.
    low, high = max(0, at - m), at + BLOCK * WINDOW + m
    text = document[low:high].tolist()
    # What the bags share bounds the subsequence.
    if sum(map(item.bag.__contains__, text)) < PARAPHRASE * m:
        return None
    share = common_subsequence(item.masks, m, text) / m
    if share < PARAPHRASE:
        return None
    answered = _contains(text, item.answer)
    leak = _contains(text, item.words) if m < SHORT else share >= LITERAL or answered
    return (share, answered, low) if leak else None


def _leaks_of_block(
    docs: DataFrame, counts: DataFrame, texts: int, items: list[tuple], min_cosine: float
) -> DataFrame:
    """The leaks of items ``item_id, words, answer``."""
    context = docs.sparkSession.sparkContext
    vocabulary = _vocabulary(counts, {w for _, found, _ in items for w in found})
    number = {w: i for i, w in enumerate(vocabulary)}
    known = [_item(i, *([number[w] for w in part] for part in parts)) for i, *parts in items]
    held = np.array(list(vocabulary.values()), np.int64)
    idf = np.log((texts + 1) / (held + 1))
    common = held > COMMON * max(texts, 5)
    for item in known:
        if common[item.words].all():
            common[item.words] = False  # nothing else could find it
    idf[common] = 0.0
    idf[~common] = np.maximum(idf[~common], 0.05)
    coded = _as_features(docs, context.broadcast(number))
    table = latent_space(coded, known, idf, RANK) * idf[:, None].astype(np.float32)
    targets = np.stack([table[item.words].sum(axis=0) for item in known])
    targets /= np.maximum(np.linalg.norm(targets, axis=1, keepdims=True), 1e-12)
    heavy = np.append(idf > 0, False)  # the last place is that of feature -1
    bits = _word_bits(known, len(number))
    shared = context.broadcast((heavy, table, targets.T.copy(), known, bits, _Anchors(known, idf)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            ids, features = batch.column("doc_id").to_pylist(), batch.column("features").to_pylist()
            ends = np.cumsum(n)
            low = 0
            while low < len(n):
                # About 400,000 words at a time.
                high = low + 1 + int(np.searchsorted(ends[low:], ends[low] - n[low] + 400_000))
                found = np.frombuffer(b"".join(features[low:high]), "<i4")
                yield from _search(ids[low:high], n[low:high], found, *shared.value, min_cosine)
                low = high

    return coded.mapInArrow(run, SCHEMA)


def find_leaks(docs: DataFrame, items: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """Which rows of ``doc_id, text`` hold an item of ``item_id, text``, literally or as a paraphrase.

    Returns a row per document row and item: the best cosine's passage with its
    ``cosine``, ``lcs`` (longest common subsequence in words, as a share of the
    item), whether the item's ``answered`` (its last sentence stands there
    literally) and ``near_word`` (where in the document to look).  A pair counts
    if ``lcs`` is at least 0.8, or at least 0.6 and the answer is there; items
    of fewer than eight words must stand there literally.

    Passages are windows of 32 words from every sixteenth word on.  Document
    frequencies and the vocabulary are counted over all documents; the latent
    space is fitted on all passages of all documents (every second window, so
    that each word counts once) and all items; every passage of every document
    is projected and searched.  Of passages of one cosine the first counts.
    Literal copies are also looked up by the weightiest word of each item, so
    none depends on its cosine; ``near_word`` of such a find is its first word.
    Items go in blocks of bounded bytes and of about ``FEATURES`` distinct words,
    each broadcast; every word of a block is a feature.

    Null and empty texts hold nothing; an item without words is in no document;
    repeated rows and repeated items are all reported; with no documents or no
    items there are no rows; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text").where("text IS NOT NULL")
    items = items.select("item_id", "text").where("text IS NOT NULL")
    count, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    tokens = items.select(F.explode(F.split(F.translate("text", UPPER, LOWER), r"[\x20\x09-\x0D]+")).alias("word"))
    distinct = tokens.distinct().count()
    blocks = max(1, -(-count // ITEM_BLOCK), -(-(size or 0) // ITEM_BYTES), -(-distinct // FEATURES))
    out = spark.createDataFrame([], SCHEMA)
    if not distinct:
        return out
    counts = _word_counts(docs)
    texts = counts.where("word IS NULL").agg(F.sum("texts")).first()[0] or 0
    for number in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number)
        rows = part.orderBy("item_id", "text").collect()
        known = [(r["item_id"], words(r["text"]), answer_of(r["text"])) for r in rows if words(r["text"])]
        if known:
            out = out.union(_leaks_of_block(docs, counts, texts, known, min_cosine))
    release(counts)
    return out
