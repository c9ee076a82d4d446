"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Texts are cut into batches of tokens, stored once.  Each batch sends its
distinct words and word pairs, with their counts, to segments by the leading
bits of their hashes.  A segment merges the counts, enters them into a filter
sized from what it holds, and answers every batch from it; a batch then scores
its texts.  The number of segments follows the bytes of the texts, so nothing
is broadcast, gathered on the driver or bounded by a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import WordHashes, stored, words

# Counts are kept as powers of BASE; a bigram's chance is drawn to its word's with the weight of PRIOR tokens.
BASE = 1.5
PRIOR = 4.0
PROBES = 4
# Least bits of a filter for each level entered: at most 0.7 % of absent levels are read as present.
BITS_PER_ENTRY = 12
SEGMENT_BYTES = {"word": 64 << 20, "pair": 8 << 20}
FLUSH = 2_000_000
# Hashes of what is no word: the start of a document and its end.
START, END = 0x243F6A8885A308D3, 0x13198A2E03707344
_MIX = [np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def bigrams(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mixed((before * _MIX[2]) ^ mixed(tokens))


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised count: 1 for a count of one, then one more for each factor of ``BASE``."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for level 0."""
    low = BASE ** (levels - 1.0)
    return np.where(levels <= 0, 0.0, np.where(levels == 1, 1.0, low * (1 + BASE) / 2))


def power_of_two(x: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, x)))))


@dataclass(frozen=True)
class Filter:
    """``2 ** width`` bits for the n-grams of one of ``2 ** segments`` segments.

    An n-gram of level ``q`` is entered once for every level up to ``q``; its
    level is read by probing upwards until a probe fails or ``top``, the highest
    level entered, is reached.  Missing n-grams may be read as present (the
    fewer bits, the more often), present ones are never lost.
    """

    segments: int
    width: int
    bits: np.ndarray | None = None
    top: int = int(level(2**63 - 1))

    def _probes(self, keys: np.ndarray, at: int) -> Iterator[np.ndarray]:
        g = mixed(keys ^ np.uint64(at * int(_MIX[2]) & (1 << 64) - 1))
        step, mask = (g >> np.uint64(32)) | np.uint64(1), np.uint64((1 << self.width) - 1)
        for i in range(PROBES):
            yield (g + np.uint64(i) * step) & mask

    def part(self, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """Bits that hold these n-grams."""
        bits = np.zeros(1 << self.width, bool)
        at = 1
        while len(keys):
            for probe in self._probes(keys, at):
                bits[probe] = True
            at += 1
            keep = levels >= at
            keys, levels = keys[keep], levels[keep]
        return np.packbits(bits, bitorder="little")

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram; 0 if it was not entered."""
        out = np.zeros(len(keys), np.int64)
        left, at = np.arange(len(keys)), 1
        while len(left) and at <= self.top:
            hit = np.ones(len(left), bool)
            for place in self._probes(keys[left], at):
                hit &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left = left[hit]
            out[left] = at
            at += 1
        return out


def entered(keys: np.ndarray, levels: np.ndarray, segments: int = 0) -> Filter:
    """A filter that holds these n-grams, sized from the number of levels to enter."""
    width = max(6, power_of_two(BITS_PER_ENTRY * int(levels.sum())))
    return Filter(segments, width, Filter(segments, width).part(keys, levels), int(levels.max(initial=0)))


def _segment(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _split(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Runs of sorted keys that share a segment."""
    edges = np.searchsorted(_segment(keys, bits), np.arange((1 << bits) + 1))
    for segment in np.flatnonzero(np.diff(edges)):
        yield int(segment), slice(edges[segment], edges[segment + 1])


_BATCH = pa.schema([("batch", pa.int64()), *[(c, pa.binary()) for c in ("ids", "no_id", "learned", "lengths", "words", "tokens")]])


@dataclass(frozen=True)
class Batch:
    """Texts as places in their sorted distinct words, of which ``START`` is one."""

    learned: np.ndarray
    lengths: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Batch:
        found = np.frombuffer(row["words"], np.uint64)
        tokens = np.frombuffer(row["tokens"], "<u2" if len(found) <= 1 << 16 else "<u4")
        return cls(np.frombuffer(row["learned"], bool), np.frombuffer(row["lengths"], np.int64), found, tokens)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    @property
    def start(self) -> int:
        return int(np.searchsorted(self.words, np.uint64(START)))

    def before(self) -> np.ndarray:
        """The place of the word before each token."""
        out = np.roll(self.tokens, 1)
        out[self.starts] = self.start
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct word pairs, and the place of each token's pair in them."""
        return np.unique(bigrams(self.words[self.tokens], self.words[self.before()]), return_inverse=True)

    def counts(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """All words and all pairs, each with how often the learned texts hold it."""
        learned = np.repeat(self.learned, self.lengths)
        number = np.bincount(self.tokens[learned], minlength=len(self.words))
        number[self.start] += int(self.learned.sum())
        yield "word", self.words, number
        keys, at = self.pairs()
        yield "pair", keys, np.bincount(at[learned], minlength=len(keys))


def token_batches(docs: DataFrame) -> DataFrame:
    """The rows of ``doc_id, text, learned`` in batches of about ``FLUSH`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        held: list[np.ndarray] = []
        doc_ids, learned, size = [], [], 0
        known = WordHashes()

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate([*held, np.array([START], np.uint64)])
            distinct, at = np.unique(tokens, return_inverse=True)
            row = {
                "batch": number,
                "ids": np.array([d or 0 for d in doc_ids], np.int64).tobytes(),
                "no_id": np.array([d is None for d in doc_ids], bool).tobytes(),
                "learned": np.array(learned, bool).tobytes(),
                "lengths": np.array([len(h) for h in held], np.int64).tobytes(),
                "words": distinct.tobytes(),
                "tokens": at[:-1].astype("<u2" if len(distinct) <= 1 << 16 else "<u4").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], _BATCH)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "learned", "text")]
            for doc_id, flag, text in zip(*columns, strict=True):
                found = list(map(known.__getitem__, words(text)))
                found.append(END)
                held.append(np.array(found, np.uint64))
                doc_ids.append(doc_id)
                learned.append(flag)
                size += len(found)
                if size >= FLUSH:
                    yield flush()
                    number += 1
                    held, doc_ids, learned, size = [], [], [], 0
        if held:
            yield flush()

    schema = "batch long, ids binary, no_id binary, learned binary, lengths binary, words binary, tokens binary"
    return stored(docs.mapInArrow(run, schema), "token-batches")


def read_counts(batches: DataFrame, bits: dict[str, int]) -> DataFrame:
    """What the filters answer to each batch: ``batch, kind, segment, levels, counts, distinct, total``.

    A row without a batch holds the number of distinct and of all counted words
    (or pairs) of the segment.  ``levels`` are read from the segment's filter;
    ``counts`` are exact, for words only.
    """

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in found:
            for row in piece.to_pylist():
                for kind, keys, counts in Batch.of(row).counts():
                    cuts = list(_split(keys, bits[kind]))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "batch": pa.array([row["batch"]] * len(cuts), pa.int64()),
                            "kind": pa.array([kind] * len(cuts), pa.string()),
                            "segment": pa.array([s for s, _ in cuts], pa.int64()),
                            "keys": pa.array([keys[at].tobytes() for _, at in cuts], pa.binary()),
                            "counts": pa.array([counts[at].astype("<u4").tobytes() for _, at in cuts], pa.binary()),
                        }
                    )

    def merge(sent: pa.Table) -> pa.Table:
        kind, segment = sent["kind"][0].as_py(), sent["segment"][0].as_py()
        pieces = [np.frombuffer(k, np.uint64) for k in sent["keys"].to_pylist()]
        keys, at = np.unique(np.concatenate(pieces), return_inverse=True)
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in sent["counts"].to_pylist()])
        counts = np.bincount(at, counts, len(keys)).astype(np.int64)
        have = counts > 0
        levels = entered(keys[have], level(counts[have]), bits[kind]).read(keys)[at].astype(np.uint8)
        real = have & (keys != np.uint64(START))
        edges = np.cumsum([0, *map(len, pieces)])
        cuts = [slice(a, b) for a, b in zip(edges, edges[1:])]
        rows = sent.num_rows
        exact = counts[at] if kind == "word" else np.zeros(len(at), np.int64)
        return pa.table(
            {
                "batch": pa.array([*sent["batch"].to_pylist(), None], pa.int64()),
                "kind": pa.array([kind] * (rows + 1), pa.string()),
                "segment": pa.array([segment] * (rows + 1), pa.int64()),
                "levels": pa.array([*[levels[c].tobytes() for c in cuts], None], pa.binary()),
                "counts": pa.array([*[exact[c].tobytes() if kind == "word" else None for c in cuts], None], pa.binary()),
                "distinct": pa.array([*[None] * rows, int(real.sum())], pa.int64()),
                "total": pa.array([*[None] * rows, int(counts[real].sum())], pa.int64()),
            }
        )

    counted = batches.mapInArrow(count, "batch long, kind string, segment long, keys binary, counts binary")
    schema = "batch long, kind string, segment long, levels binary, counts binary, distinct long, total long"
    return stored(counted.groupBy("kind", "segment").applyInArrow(merge, schema), "ngram-counts")


def score_documents(docs: DataFrame, learn: Column) -> DataFrame:
    """Score every row of ``doc_id, text``; rows for which ``learn`` holds are counted first.

    Returns ``doc_id, learned, n_tokens, n_known, train_tokens, base_score,
    score``.  Tokens are words (A-Z lower-cased, split at ASCII white space) and
    one end per text; ``n_known`` counts tokens that the counted rows hold.
    ``base_score`` is the unigram log10 probability with 0.1 added to exact
    counts; ``score`` is the bigram model's log10 probability, from the levels
    that the filters of words and pairs answer.

    A null text is empty: one end.  Repeated rows are scored alike; with nothing
    counted, counts are 0; an empty table gives no rows; other columns are not
    read.  Words are told apart by 64-bit hashes.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learned"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    batches = token_batches(docs)
    answers = read_counts(batches, {kind: power_of_two(size / most) for kind, most in SEGMENT_BYTES.items()})
    by_word = answers.where("batch IS NULL AND kind = 'word'")
    vocabulary, trained = (n or 0 for n in by_word.agg(F.sum("distinct"), F.sum("total")).first())
    total = trained + 0.1 * (vocabulary + 1)
    smooth = max(trained, 1) + 0.1 * (vocabulary + 1)

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        batch = Batch.of(row)
        told = told.sort_by("segment").to_pylist()

        def answer(kind: str, column: str, dtype: type) -> np.ndarray:
            return np.concatenate([np.frombuffer(r[column], dtype) for r in told if r["kind"] == kind])

        exact = answer("word", "counts", np.int64)
        seen = count_of(answer("word", "levels", np.uint8).astype(np.int64))
        pair = count_of(answer("pair", "levels", np.uint8).astype(np.int64))[batch.pairs()[1]]
        context = seen[batch.before()]
        alone = ((seen + 0.1) / smooth)[batch.tokens]
        chance = np.log10((np.minimum(pair, context) + PRIOR * alone) / (context + PRIOR))
        base = np.log10((exact + 0.1) / total)[batch.tokens]
        starts = batch.starts
        return pa.table(
            {
                "doc_id": pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["no_id"], bool)),
                "learned": pa.array(batch.learned),
                "n_tokens": pa.array(batch.lengths),
                "n_known": pa.array(np.add.reduceat((exact > 0).astype(np.int64)[batch.tokens], starts)),
                "base_score": pa.array(np.add.reduceat(base, starts)),
                "score": pa.array(np.add.reduceat(chance, starts)),
            }
        )

    told = answers.where("batch IS NOT NULL").select("batch", "kind", "segment", "levels", "counts")
    schema = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double"
    scored = batches.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(score, schema)
    return scored.select(
        "doc_id", "learned", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score"
    )
