"""Quality classifier: naive Bayes support vectors over n-grams of words and of word shapes."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import filtered_joins, stored

# One bucket in ``1 << BUCKET_BITS`` for each shape feature; as many again for each word feature.
BUCKET_BITS = 18
BUCKETS = 2 << BUCKET_BITS
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 32 << 20
HELD_ROWS = 500  # of which a worker holds the features
SLOT_BITS = 12  # of the hashes that the sample is drawn by
# An n-gram is indicated once for each share of the text's n-grams that it reaches.
SHARES = (0.0, 0.02, 0.1, 0.3)
_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WHITE = re.compile(r"\s")


_SPACE, _UNKNOWN = -1, -2
_POWERS = np.cumprod(np.full(1 << 12, _MULTIPLY, np.uint64))
_BLOCK = 1 << 18


def sign(character: str) -> int:
    """What a character is in a shape: upper case, lower case, other letter, digit, or itself; white space is none."""
    if character.isspace():
        return _SPACE
    for is_kind, kind in ((str.isupper, "A"), (str.islower, "a"), (str.isalpha, "x"), (str.isdigit, "0")):
        if is_kind(character):
            return ord(kind)
    return ord(character)


class Words:
    """Hashes of the words of texts, lower-cased, and of their shapes: the signs of a word, equal neighbours as one.

    Works on whole arrays of code points; signs and lower-case forms of
    characters are kept in tables that fill up as characters are met.
    """

    def __init__(self) -> None:
        self.signs = np.full(sys.maxunicode + 1, _UNKNOWN, np.int32)
        self.lower = np.arange(sys.maxunicode + 1, dtype=np.int32)

    def _block(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        signs = self.signs[points]
        if (signs == _UNKNOWN).any():
            for point in np.unique(points[signs == _UNKNOWN]).tolist():
                self.signs[point] = sign(chr(point))
                lower = chr(point).lower()
                self.lower[point] = ord(lower) if len(lower) == 1 else point
            signs = self.signs[points]
        (at,) = np.nonzero(signs != _SPACE)
        first = np.ones(len(at), bool)
        first[1:] = at[1:] != at[:-1] + 1
        signs = signs[at]
        run = first.copy()
        run[1:] |= signs[1:] != signs[:-1]
        return _hashes(signs[run], first[run]), _hashes(self.lower[points[at]], first)

    def look_up(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Shape and word hashes of the words of a text; a word that repeats the one before it has shape 1."""
        text, start, found = text or "", 0, []
        while start < len(text):
            # Long texts go block by block, cut at white space.
            space = _WHITE.search(text, start + _BLOCK) if len(text) - start > _BLOCK else None
            end = space.start() if space else len(text)
            found.append(self._block(text[start:end]))
            start = end
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        shapes, hashes = (np.concatenate(part) for part in zip(*found))
        shapes[1:][hashes[1:] == hashes[:-1]] = 1
        return shapes, hashes


def _hashes(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash per word of the symbols of all words, ``first`` marking where a word begins."""
    (starts,) = np.nonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.append(starts[1:], len(symbols)) - starts
    place = np.arange(len(symbols)) - np.repeat(starts, lengths)
    weights = _POWERS[place & (len(_POWERS) - 1)]
    # A symbol is mixed before it is weighted, and so is the sum.
    mixed = (symbols.astype(np.uint64) + np.uint64(1)) * _MIX
    sums = np.add.reduceat((mixed ^ (mixed >> np.uint64(29))) * weights, starts)
    return (sums ^ (sums >> np.uint64(32))) * _MULTIPLY


def buckets(grams: list[np.ndarray], kinds: list[int]) -> np.ndarray:
    """Distinct buckets of n-gram hashes, each array of its own kind (below 16)."""
    kind = np.repeat(np.array(kinds, np.uint64), [len(g) for g in grams])
    mixed = (np.concatenate(grams) * np.uint64(16) + kind) * _MULTIPLY
    return np.unique((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))


def shape_features(shapes: np.ndarray) -> np.ndarray:
    """Distinct feature buckets: shape n-grams of one to three words at each share of the text that they reach.

    Bucket 0 is set for every text.
    """
    grams, found, kinds = shapes, [], []
    for n in range(1, 4):
        if n > 1:
            grams = (grams[:-1] * _MULTIPLY) ^ shapes[n - 1 :]
        if not len(grams):
            break
        distinct, counts = np.unique(grams, return_counts=True)
        for level, share in enumerate(SHARES):
            found.append(distinct[counts >= share * len(grams)] if share else distinct)
            kinds.append(4 * level + n)
    return np.union1d(np.zeros(1, np.int32), buckets(found, kinds)) if found else np.zeros(1, np.int32)


def word_features(hashes: np.ndarray) -> np.ndarray:
    """Distinct feature buckets: words and pairs of neighbouring words, lower-cased."""
    pairs = (hashes[:-1] * _MULTIPLY) ^ hashes[1:]
    return buckets([hashes, pairs], [1, 2])


class Features:
    """Feature buckets of texts: those of shapes first, then those of words."""

    def __init__(self) -> None:
        self.known = Words()

    def __call__(self, text: str | None) -> np.ndarray:
        shapes, hashes = self.known.look_up(text)
        return np.concatenate([shape_features(shapes), word_features(hashes) + np.int32(1 << BUCKET_BITS)])


def featurise(docs: DataFrame) -> DataFrame:
    """``doc_id, label, features`` of ``doc_id, label, text``: buckets as little-endian 32-bit bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in (b.slice(at, HELD_ROWS) for b in batches for at in range(0, b.num_rows, HELD_ROWS)):
            found = [features(t.as_py()).astype("<i4").tobytes() for t in batch.column("text")]
            columns = [batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "features"])

    return docs.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, features binary")


def class_counts(labelled: DataFrame) -> DataFrame:
    """``bucket, positive, negative``: labelled documents of each class that have the feature, at most ``BUCKETS`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for features, label in zip(batch.column("features"), batch.column("label").to_pylist(), strict=True):
                counts[1 if label else 0, np.frombuffer(features.as_buffer(), np.int32)] += 1
        (used,) = np.nonzero(counts.sum(axis=0))
        columns = {"bucket": used.astype(np.int32), "positive": counts[1, used], "negative": counts[0, used]}
        yield pa.RecordBatch.from_pydict(columns)

    partial = labelled.select("features", "label").mapInArrow(run, "bucket int, positive long, negative long")
    # A task has each bucket once, so adding up before the exchange would only fill memory.
    return partial.repartition("bucket").groupBy("bucket").agg(F.sum("positive").alias("positive"), F.sum("negative").alias("negative"))


def dual_descent(
    rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 0.1, epochs: int = 20, seed: int = 7
) -> np.ndarray:
    """Weights of a linear hinge-loss model by dual coordinate descent over scaled indicators.

    One dual variable per row, between 0 and ``cost``; each step solves for one
    of them exactly and moves the weights along that row.  Classes are weighted
    so that each has half of the cost.
    """
    weights, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    norms = np.array([scale[r] @ scale[r] for r in rows])
    share = np.array([np.mean(labels <= 0), np.mean(labels > 0)])
    most = cost * 0.5 / np.maximum(share[(labels > 0).astype(int)], 1e-9)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if norms[i] == 0:
                continue
            y, r = labels[i], rows[i]
            v = scale[r]
            step = (1 - y * (weights[r] @ v)) / norms[i]
            new = min(max(alpha[i] + step, 0.0), most[i])
            if new != alpha[i]:
                weights[r] += (new - alpha[i]) * y * v
                moved = max(moved, abs(new - alpha[i]) / most[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights * scale


def sigmoid_fit(margins: np.ndarray, labels: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to the chance of label 1, by Newton steps."""
    positive, negative = float((labels > 0).sum()), float((labels <= 0).sum())
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((p - target) * margins).sum() + 1e-3 * (a - 1), (p - target).sum()])
        cross = (w * margins).sum()
        hessian = np.array([[(w * margins**2).sum() + 1e-3, cross], [cross, w.sum() + 1e-6]])
        da, db = np.linalg.solve(hessian, gradient)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (1e-3, float(b))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    slope: float
    offset: float

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.weights[features].sum() + self.offset, -40, 40))))


def bounded_sample(labelled: DataFrame, sample_rows: int, sample_bytes: int) -> pd.DataFrame:
    """The rows with the smallest hashed ids, as many as the bounds on rows and on bytes of features allow.

    Counts by leading bits of the hash tell how far to look, so no task sends
    rows that are not wanted.
    """
    mark, length = F.xxhash64("doc_id"), F.octet_length("features")
    slot = F.shiftright(mark, 64 - SLOT_BITS)
    slots = labelled.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("rows"), F.sum(length).alias("n"))
    slots = slots.toPandas().sort_values("slot")
    # All slots that fit, and the first that does not.
    full = (slots["rows"].cumsum() > sample_rows) | (slots["n"].cumsum() > sample_bytes)
    near = labelled.where(slot <= int(slots["slot"][full].iloc[0])) if full.any() else labelled
    order = [mark, "doc_id", "features"]
    # Lengths alone tell how many rows fit.
    sized = near.orderBy(*order).limit(sample_rows).select(length.alias("n")).toPandas()
    fitting = int((sized["n"].cumsum() <= sample_bytes).sum())
    return near.orderBy(*order).limit(fitting).select("features", "label").toPandas()


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Fit on ``doc_id, features, label``.

    Class log-count ratios are counted over all labelled rows.  The hinge-loss
    model is fitted on a sample of at most ``sample_rows`` rows and
    ``sample_bytes`` bytes of features, those whose hashed id is smallest; every
    fifth of them is left to the logistic curve.  With fewer than two classes
    (or a sample of one class) the score is the share of label 1, or one half.
    """
    counts = class_counts(labelled).toArrow()  # rows of Python objects would take over 100 MB
    total = labelled.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    positive, negative = int(total[0]), int(total[1])
    sample = bounded_sample(labelled, sample_rows, sample_bytes) if positive and negative else None
    if sample is None or sample["label"].nunique() < 2:
        share = (positive + 1e-6) / (positive + negative + 2e-6)
        return QualityModel(np.zeros(BUCKETS), 1.0, float(np.log(share / (1 - share))))
    p, q = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bucket = counts["bucket"].to_numpy()
    p[bucket], q[bucket] = counts["positive"].to_numpy(), counts["negative"].to_numpy()
    ratio = np.log((p + 1) / (positive + 2)) - np.log((q + 1) / (negative + 2))
    ratio[0] = 1.0  # the offset
    rows = [np.frombuffer(f, np.int32) for f in sample["features"]]
    labels = np.where(sample["label"] == 1, 1.0, -1.0)
    curve = np.arange(len(rows)) % 5 == 4
    train = np.flatnonzero(~curve)
    weights = dual_descent([rows[i] for i in train], labels[train], ratio)
    margins = np.array([weights[r].sum() for r in rows])
    check = curve if 0 < (labels[curve] > 0).sum() < curve.sum() else np.ones(len(rows), bool)
    return QualityModel(weights, *sigmoid_fit(margins[check], labels[check]))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
) -> DataFrame:
    """``doc_id, score``: the chance that ``quality`` is 1, for each row of ``doc_id, text``.

    ``labels`` has ``doc_id, quality``; only rows for which ``usable`` (over
    ``doc_id``) holds are learned from; nothing but the text is an input of a
    score.  A document with several labels counts with the smallest, null labels
    and labels without a document not at all.  A null text is empty and scored
    by the features that every text has; repeated rows are scored alike; an
    empty table gives no rows; other columns are not read.
    """
    texts = docs.select("doc_id", "text")
    known = labels.where(usable & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    known = stored(known, "quality-labels").where("label >= 0")
    with filtered_joins(docs.sparkSession):
        labelled = stored(featurise(texts.join(known, "doc_id")), "quality-labelled")
    model = fit(labelled, sample_rows, sample_bytes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [model.score(features(t.as_py())) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return texts.mapInArrow(score, "doc_id long, score double")
