"""Periodic runs of words by an enhanced suffix array: branching squares, rotated and merged into runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_WORDS = 250_000
# Suffixes of smaller children tested at a time.
BATCH_TESTS = 2_000_000

Arrange = Callable[[object, int], "np.ndarray | None"]


class Numbers(dict):
    """Words numbered in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def _refine(order: np.ndarray, rank: np.ndarray, live: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Sort the suffixes at the places ``live`` by ``key``, rank them by the place of their group, return groups of several."""
    by_key = np.argsort(key, kind="stable")
    key = key[by_key]
    order[live] = order[live][by_key]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    rank[order[live]] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))]
    alone = fresh.copy()
    alone[:-1] &= fresh[1:]
    return live[~alone]


class SuffixArray:
    """Sorted suffixes of texts that are joined behind a mark of their own each.

    ``symbols`` are equal only within a text, so no two suffixes of different
    texts share a word.  ``levels[k]`` ranks all suffixes by their first 2**k
    words; ``place`` is the inverse of ``order``.
    """

    def __init__(self, symbols: np.ndarray, widest: int | None = None) -> None:
        n = len(symbols)
        self.symbols = symbols
        self.order, self.place = np.arange(n), np.empty(n, np.int64)
        live = _refine(self.order, self.place, np.arange(n), symbols)
        self.levels, width = [self.place.astype(np.int32)], 1
        while len(live) and (widest is None or width < widest):
            members = self.order[live]
            # A suffix that shares ``width`` words has them all before its mark.
            live = _refine(self.order, self.place, live, self.place[members] * n + self.place[members + width])
            self.levels.append(self.place.astype(np.int32))
            width *= 2
        self.shared = self.order[live]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes at ``a`` and ``b`` share."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            step = np.where(self.levels[k][a] == self.levels[k][b], 1 << k, 0)
            a += step
            b += step
        return a - start


def _next_smaller(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place in ``at`` the first place behind it with a smaller value; the last value is the smallest."""
    least = [values]
    while 2 << (len(least) - 1) < len(values):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    limit, found = values[at], at + 1
    for k in range(len(least) - 1, -1, -1):
        inside = found < len(least[k])
        jump = inside & (least[k][np.where(inside, found, 0)] >= limit)
        found = found + np.where(jump, 1 << k, 0)
    return found


def _intervals(suffixes: SuffixArray, least_size: int) -> tuple[np.ndarray, ...]:
    """Places, depths and bounds of LCP intervals: ``start, end`` of each child but the largest, ``depth, first, last``."""
    order = suffixes.order
    n = len(order)
    depth = np.full(n + 1, -1, np.int64)
    depth[1:n] = suffixes.common(order[:-1], order[1:])
    cut = np.flatnonzero(depth[: n + 1] > 0)
    last = _next_smaller(depth, cut) - 1
    first = n - _next_smaller(depth[::-1], n - cut)
    big = last - first + 1 >= least_size
    cut, first, last = cut[big], first[big], last[big]
    if not len(cut):
        return (np.empty(0, np.int64),) * 5
    by = np.argsort(first * (n + 1) + last, kind="stable")
    cut, first, last = cut[by], first[by], last[by]
    head = np.ones(len(cut), bool)
    head[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    group = np.cumsum(head) - 1
    heads = np.flatnonzero(head)
    tails = np.append(heads[1:], len(cut)) - 1
    groups, total = len(heads), len(cut) + len(heads)
    start, end = np.empty(total, np.int64), np.empty(total, np.int64)
    start[np.arange(len(cut)) + group + 1] = cut
    start[heads + np.arange(groups)] = first[heads]
    end[np.arange(len(cut)) + group] = cut
    end[tails + np.arange(groups) + 1] = last[heads] + 1
    of = np.repeat(np.arange(groups), tails - heads + 2)
    size = end - start
    most = np.maximum.reduceat(size, heads + np.arange(groups))
    largest = np.flatnonzero(size == most[of])
    _, one = np.unique(of[largest], return_index=True)
    small = np.ones(total, bool)
    small[largest[one]] = False
    of = of[small]
    return start[small], end[small], depth[cut[heads]][of], first[heads][of], last[heads][of]


def _branching_squares(suffixes: SuffixArray, least_size: int) -> tuple[np.ndarray, np.ndarray]:
    """``start, half``: squares whose next word differs from the one a half before it.

    Both halves of such a square begin in one LCP interval whose depth is the
    half, in different children, so at least one of them is in a smaller child:
    each suffix of a smaller child asks whether the suffix a depth before or
    behind it lies in the same interval.
    """
    start, end, depth, first, last = _intervals(suffixes, least_size)
    order, place, symbols = suffixes.order, suffixes.place, suffixes.symbols
    n, found = len(order), []
    sizes = end - start
    ends = np.cumsum(sizes)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + BATCH_TESTS, side="right")))
        size = sizes[at:stop]
        child = np.repeat(np.arange(at, stop), size)
        inner = np.arange(len(child)) - np.repeat(np.cumsum(size) - size, size)
        i, d = order[start[child] + inner], depth[child]
        for sign in (1, -1):
            other = i + sign * d
            real = (other >= 0) & (other < n)
            where = place[np.where(real, other, 0)]
            kept = real & (where >= first[child]) & (where <= last[child])
            left, half = np.minimum(i, other)[kept], d[kept]
            branches = symbols[left + half] != symbols[left + 2 * half]
            found.append(np.stack([left[branches], half[branches]]))
        at = stop
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return pairs[0], pairs[1]


def _rotated(symbols: np.ndarray, start: int, period: int) -> int:
    """The leftmost start from which the words keep the period up to ``start``."""
    width = 64
    while start:
        low = max(0, start - width)
        odd = np.flatnonzero(symbols[low:start] != symbols[low + period : start + period])
        if len(odd):
            return low + int(odd[-1]) + 1
        start, width = low, 2 * width
    return 0


def periodic_runs(texts: list[np.ndarray], least_words: int, least_periods: int) -> list[list[tuple[int, int, int]]]:
    """Runs ``(start, length, period)`` of each text of word numbers, by start, then period.

    A run is a stretch with a smallest period q that no neighbouring word
    extends and that has at least ``least_words`` words and ``least_periods * q``
    words; ``least_periods`` is 2 or more.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]

    def joined(chosen: list[int]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(texts[c]) + 1 for c in chosen])
        ends = np.cumsum(lengths)
        flat = np.zeros(int(ends[-1]), np.int64)
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False
        flat[inside] = np.concatenate([texts[c] for c in chosen]) + 1
        span = int(flat.max()) + 1
        return flat + np.repeat(np.arange(len(chosen)), lengths) * span, ends - lengths

    # The words of a run but its last period come again a period later: a text in which no such stretch repeats has no run.
    repeat = min(max(least_words - 1, 1), *(max(q * (least_periods - 1), least_words - q) for q in range(1, least_words + 1)))
    width = 1 << (repeat.bit_length() - 1)
    chosen = [c for c, t in enumerate(texts) if len(t) >= least_words]
    if not chosen:
        return out
    symbols, starts = joined(chosen)
    repeated = np.unique(np.searchsorted(starts, SuffixArray(symbols, width).shared, side="right") - 1)
    chosen = [chosen[c] for c in repeated]
    if not chosen:
        return out
    symbols, starts = joined(chosen)
    suffixes = SuffixArray(symbols)
    # All but the last of a run's periods begin with the same words as the last one does.
    left, half = _branching_squares(suffixes, least_periods)
    before = (least_periods - 2) * half
    fits = left >= before
    left, half, before = left[fits], half[fits], before[fits]
    whole = suffixes.common(left - before, left - before + half) >= (least_periods - 1) * half
    ends = np.unique(np.stack([(left + 2 * half)[whole], half[whole]]), axis=1)
    done_end, done = -1, []
    for end, period in ends.T.tolist():
        if end != done_end:
            done_end, done = end, []
        # A multiple of the period of a run that ends here gives the same run.
        if any(period % q == 0 and s <= end - 2 * period for s, q in done):
            continue
        start = _rotated(symbols, end - least_periods * period, period)
        done.append((start, period))
        if end - start >= least_words:
            text = int(np.searchsorted(starts, start, side="right")) - 1
            out[chosen[text]].append((start - int(starts[text]), end - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def find_runs(
    docs: DataFrame, least_words: int = 6, least_periods: int = 4, arrange: Arrange | None = None
) -> DataFrame:
    """``doc_id, runs, collapsed`` for each row of ``doc_id, text``.

    Words are what ASCII white space separates.  ``runs`` holds
    ``start, length, period`` in words, by start, then period; ``collapsed`` is
    the words that are in no run behind its first period, joined by one space.
    ``arrange`` may give, for an id and a number of words, the index of the word
    that stands at each place instead of the text's own order.

    A null or empty text has no words, no runs and an empty ``collapsed``; a row
    without an id is treated alike and not rearranged; repeated rows stay; an
    empty table gives no rows; other columns are not read.  Texts are worked on
    whole, about ``BATCH_WORDS`` words at a time; a longer text is a batch of
    its own, and memory grows with its words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def group(names: list, words: list[list[bytes]]) -> pa.RecordBatch:
        numbers, texts = Numbers(), []
        for i, (name, own) in enumerate(zip(names, words, strict=True)):
            at = arrange(name, len(own)) if arrange and own and name is not None else None
            if at is not None:
                words[i] = own = [own[x] for x in at.tolist()]
            texts.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
        found = periodic_runs(texts, least_words, least_periods)
        collapsed = []
        for own, runs in zip(words, found, strict=True):
            if runs:
                keep = np.ones(len(own), bool)
                for start, length, period in runs:
                    keep[start + period : start + length] = False
                own = [own[x] for x in np.flatnonzero(keep).tolist()]
            collapsed.append(b" ".join(own))
        fields = [("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]
        shown = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names),
                pa.array(shown, pa.list_(pa.struct(fields))),
                pa.array(collapsed, pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "runs", "collapsed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, words, size = [], [], 0
            ids = batch.column("doc_id")
            raw = batch.column("text").cast(pa.binary())
            for i in range(len(raw)):
                text = raw[i].as_py()
                words.append(text.split() if text else [])
                names.append(ids[i].as_py())
                size += len(words[-1])
                if size >= BATCH_WORDS:
                    yield _typed(group(names, words), ids.type)
                    names, words, size = [], [], 0
            if names:
                yield _typed(group(names, words), ids.type)

    schema = f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _typed(batch: pa.RecordBatch, kind: pa.DataType) -> pa.RecordBatch:
    """Ids of a batch in the type they came in, also where all of them are null."""
    return batch.set_column(0, "doc_id", batch.column(0).cast(kind))
