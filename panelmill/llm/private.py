"""Personal data: rules, and a linear-chain conditional random field over word shapes for rewritten forms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import stored

# Kinds in their order, and what a rule finds of each.
KINDS = ("email", "ip", "card", "phone")
RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
# Kinds of the spans that the model adds.
ADDED = tuple(f"likely_{k}" for k in KINDS)
TAGS = ("other", *KINDS)
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

# The labelled table: windows of about SAMPLE_DOCS documents, at most SAMPLE_WINDOWS of them.
SAMPLE_DOCS = 8_000
SAMPLE_WINDOWS = 1_500
CONTEXT = 3
BATCH_CHARS = 4_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CUES = ("at", "dot")
_AROUND = "()[]{}<>"
_BEHIND = tuple(".,;:!?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    """Whether what a rule matched is kept."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of what the rules find, by start, then kind; kinds are places in ``KINDS``."""
    found = []
    if "@" in text:
        found += [(m.start(), 0, m.end()) for m in RULES["email"].finditer(text)]
    for rank, kind in enumerate(KINDS[1:], 1):
        found += [(m.start(), rank, m.end()) for m in RULES[kind].finditer(text) if passes(kind, m.group())]
    return sorted(found)


def word_shape(word: str) -> str:
    """Runs of letters as one sign, of digits as their number by size, other signs once per run; ``at`` and ``dot`` stay."""
    if word.isalpha() and word.lower() not in _CUES:
        return "x"
    bare = word.strip(_AROUND + ".,;:").lower()
    if bare in _CUES:
        return "".join("<" if c in "([{<" else ">" if c in ")]}>" else "" for c in word).replace("<", f"<{bare}", 1) or bare
    signs: list[str] = []
    for run in re.finditer(r"[0-9]+|[^\W\d_]+|(.)\1*", word, re.DOTALL):
        piece = run.group()
        if piece[0] in "0123456789":
            n = len(piece)
            signs.append(str(n) if n < 5 else "6" if n < 9 else "9" if n < 12 else "w" if n < 20 else "z")
        else:
            signs.append("x" if piece[0].isalpha() else piece[0])
    shape = "".join(signs)
    return shape if len(shape) <= 24 else f"{shape[:12]}~{shape[-12:]}"


def shape_features(shape: str) -> list[str]:
    """The shape, its ends, its signs and how many digits it has."""
    digits = sum({"6": 6, "9": 9, "w": 16, "z": 20}.get(c, 0) if not c.isdigit() or c in "69" else int(c) for c in shape)
    signs = "".join(sorted({c for c in shape if not c.isalnum()}))
    return ["any", f"is {shape}", f"head {shape[:2]}", f"tail {shape[-2:]}", f"signs {signs}", f"digits {min(digits, 20) // 2}"]


def rewritten(kind: str, found: str) -> list[str]:
    """The ways in which people write what the rules then miss: marks spelled out, bracketed or exchanged."""
    if kind == "email":
        user, host = found.split("@", 1)
        dots = host.replace(".", " dot ")
        return [
            f"{user} at {dots}",
            f"{user} [at] {host.replace('.', ' [dot] ')}",
            f"{user}(at){host}",
            f"{user} (at) {host}",
            f"{user} @ {host}",
        ]
    if kind == "ip":
        return [found.replace(".", mark) for mark in ("[.]", "(.)", " dot ")]
    digits = re.sub("[^0-9]", "", found)
    if kind == "card":
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [mark.join(fours) for mark in (".", "/", "_", ", ")]
    near = digits[-10:]
    area, middle, last = near[:-7], near[-7:-4], near[-4:]
    return [f"({area}) {middle}-{last}", f"{area}-{middle}-{last}", f"{area}.{middle}.{last}", f"{area} {middle} {last}"]


def restored(kind: str, found: str) -> bool:
    """Whether a decoded stretch, its marks put back, is of the kind: the exact check behind the model."""
    if kind in ("email", "ip"):
        plain = re.sub(r"\s*(?:[\[({<]\s*(?:dot|\.)\s*[\])}>]|\sdot\s|\.)\s*", ".", found, flags=re.I)
        if kind == "email":
            plain = re.sub(r"\s*(?:[\[({<]\s*(?:at|@)\s*[\])}>]|\sat\s|@)\s*", "@", plain, flags=re.I)
        match = RULES[kind].fullmatch(plain)
        return bool(match) and passes(kind, plain)
    if kind == "card":
        return bool(re.fullmatch(r"[0-9]{2,}(?:(?:[./_-]|,? )[0-9]{2,})+", found)) and passes(kind, found)
    parts = re.findall("[0-9]+", found)
    return bool(re.fullmatch(r"[(]?[0-9][\x20().0-9-]+[0-9]", found)) and len(parts) > 1 and passes(kind, found)


def _tagged(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[str], list[int]]:
    """Words of a text and the tag of each: the kind of the first span that it overlaps."""
    words, tags, at = [], [], 0
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        words.append(m.group())
        tags.append(spans[at][1] + 1 if at < len(spans) and spans[at][0] < m.end() else 0)
    return words, tags


def _windows(text: str) -> Iterator[tuple[str, str]]:
    """``shapes, tags`` around each span, each of its rewritten forms, other numbers, and one plain stretch."""
    spans = base_spans(text)

    def shown(words: list[str], tags: list[int]) -> tuple[str, str]:
        return " ".join(map(word_shape, words)), "".join(map(str, tags))

    if re.search("[0-9@]", text):
        words, tags = _tagged(text, spans)
        odd = [i for i, w in enumerate(words) if not tags[i] and re.search("[0-9@]", w)]
    else:
        words = _WORD.findall(text)
        tags, odd = [0] * len(words), []
    for i in [*odd[:20], len(words) // 2]:
        part = slice(max(0, i - CONTEXT), i + CONTEXT + 1)
        if part.start < len(words):
            yield shown(words[part], tags[part])
    for start, kind, end in spans:
        before, behind = _WORD.findall(text[:start])[-CONTEXT:], _WORD.findall(text[end:])[:CONTEXT]
        for form in (text[start:end], *rewritten(KINDS[kind], text[start:end])):
            own = _WORD.findall(form)
            yield shown([*before, *own, *behind], [0] * len(before) + [kind + 1] * len(own) + [0] * len(behind))


def labelled_windows(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """The labelled table: ``shapes, tags`` of distinct windows, at most ``windows`` of each tag that occurs.

    Documents are taken by a hash of their rows, about ``sample_docs`` of them;
    only those with a digit or an at sign are asked for windows around spans.
    Labels are what the rules find, and its rewritten forms.
    """
    share = min(1.0, sample_docs / max(1, docs.count()))
    low = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)) + (share >= 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [w for t in batch.column("text").to_pylist() for w in _windows(t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["shapes", "tags"])

    found = docs.select("doc_id", "text").where(low).mapInArrow(run, "shapes string, tags string").distinct()
    found = stored(found, "windows")
    hashed = F.xxhash64("shapes", "tags")
    positive = found.where(F.col("tags").rlike("[1-9]")).orderBy(hashed, "shapes", "tags").limit(windows)
    negative = found.where(~F.col("tags").rlike("[1-9]")).orderBy(hashed, "shapes", "tags").limit(windows)
    return positive.unionByName(negative)


@dataclass
class Field:
    """Weights of a conditional random field: own, previous and next word's features per tag, and tag pairs."""

    features: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray

    def scores(self, shapes: list[str]) -> np.ndarray:
        """What each shape adds to its own word, the next word and the previous one, per tag."""
        out = np.zeros((3, len(shapes), len(TAGS)))
        for i, shape in enumerate(shapes):
            if shape:
                known = [self.features[f] for f in shape_features(shape) if f in self.features]
                out[:, i] = self.weights[:, known].sum(axis=1)
        return out


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.squeeze(most, axis) + np.log(np.exp(x - most).sum(axis=axis))


def train(windows: list[tuple[list[str], list[int]]], rounds: int = 80, step: float = 0.2, shrink: float = 0.002) -> Field:
    """Fit a field to words' shapes and tags: penalised likelihood by forward and backward sums, Adam over all windows.

    The words before and behind a window have the tag ``other``.
    """
    names = sorted({s for shapes, _ in windows for s in shapes})
    features: dict[str, int] = {}
    for name in names:
        for f in shape_features(name):
            features.setdefault(f, len(features))
    field = Field(features, np.zeros((3, len(features), len(TAGS))), np.zeros((len(TAGS), len(TAGS))))
    if not windows:
        return field
    number = {s: i + 1 for i, s in enumerate(names)}
    has = np.zeros((len(names) + 1, len(features)))
    for s, i in number.items():
        has[i, [features[f] for f in shape_features(s)]] = 1
    n, longest, k = len(windows), max(len(s) for s, _ in windows), len(TAGS)
    shape = np.zeros((n, longest + 2), np.int64)
    tag = np.zeros((n, longest + 2), np.int64)
    for row, (shapes, tags) in enumerate(windows):
        shape[row, 1 : len(shapes) + 1] = [number[s] for s in shapes]
        tag[row, 1 : len(tags) + 1] = tags
    real = shape > 0
    around = [shape, np.roll(shape, 1, axis=1), np.roll(shape, -1, axis=1)]
    flat = [a[real] for a in around]
    gold = np.eye(k)[tag]
    # Behind a window's end nothing is scored: words there are all the tag other, at no cost.
    joint = real | np.roll(real, 1, axis=1)
    lead, follow = tag[:, :-1][joint[:, 1:]], tag[:, 1:][joint[:, 1:]]
    seen_pairs = np.bincount(lead * k + follow, minlength=k * k).reshape(k, k)
    shut = np.zeros(k)
    shut[1:] = -1e9
    state = [np.zeros_like(field.weights), np.zeros_like(field.pairs)]
    moments = [(np.zeros_like(s), np.zeros_like(s)) for s in state]
    for t in range(1, rounds + 1):
        weights, pairs = state
        by_shape = np.einsum("sf,wfk->wsk", has, weights)
        emit = np.where(real[..., None], sum(by_shape[w][a] for w, a in enumerate(around)), shut)
        ahead, behind = np.empty((n, longest + 2, k)), np.empty((n, longest + 2, k))
        ahead[:, 0], behind[:, -1] = shut, 0
        steps = [np.where(joint[:, i, None, None], pairs, 0.0) for i in range(longest + 2)]
        for i in range(1, longest + 2):
            ahead[:, i] = emit[:, i] + _sum_exp(ahead[:, i - 1, :, None] + steps[i], 1)
        for i in range(longest, -1, -1):
            behind[:, i] = _sum_exp(steps[i + 1] + (emit[:, i + 1] + behind[:, i + 1])[:, None, :], 2)
        total = _sum_exp(ahead[:, -1], 1)
        chance = np.exp(ahead + behind - total[:, None, None])
        error = (gold - chance)[real]
        up = np.zeros_like(weights)
        for w, at in enumerate(flat):
            per_shape = np.stack([np.bincount(at, error[:, c], len(names) + 1) for c in range(k)], axis=1)
            up[w] = has.T @ per_shape
        expected = np.zeros((k, k))
        for i in range(1, longest + 2):
            on = joint[:, i]
            both = ahead[on, i - 1, :, None] + pairs + (emit[on, i] + behind[on, i])[:, None, :] - total[on, None, None]
            expected += np.exp(both).sum(axis=0)
        slopes = [up / n - shrink * weights, (seen_pairs - expected) / n - shrink * pairs]
        for j, slope in enumerate(slopes):
            mean, square = moments[j]
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope**2 - square)
            state[j] = state[j] + step * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    field.weights, field.pairs = state
    return field


def viterbi(emit: np.ndarray, pairs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Best tags of chains laid end to end, each beginning at one of ``starts``; tag 0 stands before and behind each.

    A best path leaves tag 0 only for stretches that gain by it.  What a stretch
    could gain at most is a sum over its words and a constant, so running sums
    tell which words lie in no stretch with a gain: these have tag 0, and only
    what lies between them is decoded, stretches of one length at a time.
    """
    stay = pairs[0, 0]
    along = pairs[1:, 1:].max() - stay
    gain = (emit[:, 1:].max(axis=1) - emit[:, 0]).astype(np.float64) + along
    ends = pairs[0, 1:].max() + pairs[1:, 0].max() - 2 * stay - along
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    before = sums[1:] - np.minimum.accumulate(sums[:-1])
    behind = np.maximum.accumulate(sums[:0:-1])[::-1] - sums[:-1]
    sure = before + behind - gain + ends < -1e-3
    out = np.zeros(len(emit), np.int8)
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return out
    fresh = np.ones(len(open_), bool)
    fresh[1:] = np.diff(open_) > 1
    begins = np.zeros(len(emit) + 1, bool)
    begins[starts] = True
    fresh |= begins[open_]
    first = open_[fresh]
    lengths = np.diff(np.append(np.flatnonzero(fresh), len(open_)))
    for length in np.unique(lengths):
        at = first[lengths == length]
        best = pairs[0] + emit[at]
        came = np.empty((length, len(at), emit.shape[1]), np.int8)
        for i in range(1, length):
            reach = best[:, :, None] + pairs
            came[i] = reach.argmax(axis=1)
            best = reach.max(axis=1) + emit[at + i]
        tag = (best + pairs[:, 0]).argmax(axis=1)
        for i in range(length - 1, -1, -1):
            out[at + i] = tag
            if i:
                tag = came[i, np.arange(len(at)), tag]
    return out


class Decoder:
    """Tags of the words of whole texts, with the scores of each shape looked up."""

    def __init__(self, field: Field, limit: int = 200_000) -> None:
        self.field, self.limit = field, limit
        self.shapes: dict[str, int] = {"": 0}
        self.words: dict[str, int] = {}
        self.scores = np.zeros((3, 1, len(TAGS)), np.float32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.words) > self.limit or len(self.shapes) > self.limit:
            self.__init__(self.field, self.limit)
        new, out = [], []
        for word in words:
            # Most words are letters alone, or letters and a sign behind them.
            if word.isalpha() and word.lower() not in _CUES:
                key = "x"
            elif word[:-1].isalpha() and word[-1:] in _BEHIND and word[:-1].lower() not in _CUES:
                key = "x" + word[-1]
            else:
                key = word
            number = self.words.get(key)
            if number is None:
                shape = word_shape(key) if key else ""
                if shape not in self.shapes:
                    self.shapes[shape] = len(self.shapes)
                    new.append(shape)
                number = self.words[key] = self.shapes[shape]
            out.append(number)
        if new:
            self.scores = np.concatenate([self.scores, self.field.scores(new).astype(np.float32)], axis=1)
        return np.array(out, np.int64)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tags of all words of the texts, and where each text's words begin and end."""
        split = pc.ascii_split_whitespace(texts)
        edges = np.asarray(split.offsets) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return np.zeros(0, np.int8), edges
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        starts = edges[:-1][edges[:-1] < edges[1:]]
        before, behind = np.roll(number, 1), np.roll(number, -1)
        before[starts] = 0
        behind[np.append(starts[1:], len(number)) - 1] = 0
        own, following, previous = self.scores
        emit = own[number] + following[before] + previous[behind]
        tags = viterbi(emit, self.field.pairs.astype(np.float32), starts)
        # A text that begins or ends with white space has an empty word there.
        tags[number == 0] = 0
        return tags, edges


def added_spans(text: str, tags: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of decoded stretches that hold up and touch no base span; kinds follow those of ``KINDS``."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    tags = tags[1:] if at and at[0][0] else tags
    out, i = [], 0
    while i < len(at):
        kind = int(tags[i])
        j = i + 1
        while j < len(at) and tags[j] == kind:
            j += 1
        if kind:
            start, end = at[i][0], at[j - 1][1]
            while start < end and text[start] in "\"'<,;:!?*":
                start += 1
            while start < end and text[end - 1] in "\"'>,;:!?*.":
                end -= 1
            if text[start:end].count("(") < text[start:end].count(")") and text[end - 1] == ")":
                end -= 1
            clear = all(e <= start or s >= end for s, _, e in base)
            if clear and restored(KINDS[kind - 1], text[start:end]):
                out.append((start, len(KINDS) + kind - 1, end))
        i = j
    return out


def find_private(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """``doc_id, spans`` for each row of ``doc_id, text``: spans by start, then kind; code points, end exclusive.

    What the rules find has the kinds ``KINDS``.  A field trained on ``labelled``
    (``shapes, tags``; by default ``labelled_windows`` of the documents) tags all
    words of all texts; a stretch of one tag that touches no such span and that,
    its marks put back, is of its kind is added under ``ADDED``.

    A null text is empty; repeated rows stay; a row without a find has an empty
    array; an empty table gives no rows; other columns are not read.
    """
    windows = (labelled if labelled is not None else labelled_windows(docs)).collect()
    windows = sorted((w.shapes.split(" "), [int(t) for t in w.tags]) for w in windows if w.tags)
    field = train(windows)
    names = KINDS + ADDED
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(field)
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.string()), "")
            sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            at = 0
            while at < len(texts):
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + BATCH_CHARS, side="right")))
                part = texts.slice(at, end - at)
                tags, edges = decode(part)
                hit = np.add.reduceat(np.append(tags != 0, False), np.minimum(edges[:-1], len(tags))) * (np.diff(edges) > 0) > 0
                marked = pc.match_substring_regex(part, "[0-9@]").to_numpy(zero_copy_only=False)
                spans: list[list[tuple[int, int, int]]] = [[]] * len(part)
                for i in np.flatnonzero(hit | marked).tolist():
                    text = part[i].as_py()
                    found = base_spans(text) if marked[i] else []
                    if hit[i]:
                        found = sorted(found + added_spans(text, tags[edges[i] : edges[i + 1]], found))
                    spans[i] = found
                shown = [[{"kind": names[k], "start": s, "end": e} for s, k, e in own] for own in spans]
                fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
                arrays = [batch.column("doc_id").slice(at, end - at), pa.array(shown, pa.list_(pa.struct(fields)))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "spans"])
                at = end

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPANS}")
