"""Token ids of whole texts by a tokenizer file, each distinct chunk encoded once per worker.

Both supported kinds of tokenizer cut a text before they merge, and never merge
across a cut, so a text may be encoded in chunks that end at such cuts and the
chunks' ids joined.  Chunks repeat, texts do not: an encoder, which lives as long
as its task, remembers the ids of the chunks it met, in two generations of up to
``CACHE`` each.  Cutting and finding the distinct chunks of a batch is left to
Arrow.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CACHE = 60_000
BATCH_CHARS = 4_000_000
# Marks of this module: a full stop, a comma, the start of a text, the end of a chunk, and a cut in a chunk.
_STOP, _COMMA, _FIRST, _END, _CUT = "\x01", "\x02", "\x03", "\x04", "\x05"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# A full stop or comma that may belong to a run of signs; behind a letter or digit it stands alone.
_SIGN_RUN = r"[^\pL\pN][.,][ \n]"
# Word files cut between a letter and any sign but an apostrophe, which may begin a contraction.  Latin letters
# only, without the one that lower case turns into a letter and a mark: other scripts have more of that kind.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-įı-ɏ", "!-&(-/:-@\\[-`{-~"
_SIGN_BEHIND_LETTER = f"([{_LETTERS}])([{_SIGNS}])"
# Chunks whose pieces are known without the library's cutter: letters and the signs before and behind them.
_PLAIN = re.compile(f"[{_FIRST}\n]?[{_SIGNS}]*[{_LETTERS}]*[{_SIGNS}]*")
_PLAIN_WORD = re.compile(f"[{_LETTERS}]+")
_CUT_AT_SIGNS = re.compile(f"(?<=[{_LETTERS}])(?=[{_SIGNS}])|(?<=[{_SIGNS}])(?=[{_LETTERS}])")
# How word files cut; a word of letters is one piece.
_WORD_CUTTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Chunks in one text, and chunks of which the library's results are held at a time.
RUN, HELD = 250, 5_000
# Upper and lower case may compose with different marks.
_MARKED = r"[A-Z]\pM"


def _letters_of_bytes() -> np.ndarray:
    """The character that stands for each byte in files of byte-level pieces."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = np.zeros(256, "<u2")
    table[shown] = shown
    hidden = np.flatnonzero(table == 0)
    table[hidden] = 0x100 + np.arange(len(hidden))
    return table


_BYTES = _letters_of_bytes()


def _in_bytes(text: str) -> str:
    return _BYTES[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")


@cache
def _loaded(path: str) -> tuple[Tokenizer, dict, Tokenizer | None]:
    """A tokenizer file, its content but for the model, and its model alone if ``_alone`` allows; read once per process."""
    from tokenizers import Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec.pop("model")
    loaded, merges = Tokenizer.from_file(path), None
    if _alone(model):
        # The model is shared, not copied.
        merges = Tokenizer(loaded.model)
        if model.get("end_of_word_suffix"):
            merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return loaded, spec, merges


def _alone(model: dict) -> bool:
    """Whether the model may be given byte-level pieces directly: all bytes are tokens, and no merge has a mark in it."""
    vocab, suffix = model.get("vocab"), model.get("end_of_word_suffix") or ""
    unusual = ("dropout", "ignore_merges", "continuing_subword_prefix")
    if model.get("type") != "BPE" or any(model.get(k) for k in unusual) or not isinstance(vocab, dict):
        return False
    one = {x + e for x in map(chr, _BYTES.tolist()) for e in {"", suffix}}
    marks = _in_bytes(_END + _CUT)
    return one <= vocab.keys() and not any(m in token for token in vocab.keys() - one for m in marks)


class Encoder:
    """Ids of texts as unsigned 32-bit arrays, as the library gives them; no special tokens are added.

    A text that holds one of the file's added tokens, in either case, is encoded whole.

    Byte-level files cut before a single space and around a single line end;
    runs of white space are cut by context, so a text that holds such a run is
    encoded whole; a cut also lies between a letter or digit and a full stop or
    comma.  Word files drop white space, so every space is a cut, as is the
    place between a letter and a sign; they lower-case, so chunks that differ
    in the case of A-Z are one.  Any other file is used on whole texts.

    Most chunks are Latin letters, perhaps with signs around them: their pieces
    are known, so they go to the file's model without the library's normalizer
    and cutter.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, spec, merges = _loaded(path)
        cutter = spec.get("pre_tokenizer") or {}
        first = cutter.get("pretokenizers", [cutter])[0]
        self.byte_level = (
            spec.get("normalizer") is None
            and cutter.get("type") == "ByteLevel"
            and cutter.get("use_regex", True)
            and not cutter.get("add_prefix_space")
        )
        self.by_word = (
            first.get("type") == "Split"
            and first.get("behavior") == "Removed"
            and first.get("invert") is True
            and "[^\\s" in first.get("pattern", {}).get("Regex", "")
            and "Lowercase" in [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        )
        # Texts that hold one of the marks are encoded whole, too.
        self.whole = f"[\x01-\x04]|{_MARKED}" if self.by_word else f"[\x01-\x03]|[{_SPACES}][{_SPACES}]"
        added = [t["content"] for t in spec.get("added_tokens") or [] if t["content"]]
        if added:
            self.whole += "|(?i:" + "|".join(re.escape(t) for t in added) + ")"
        self.merges = merges if self._pieces_known(spec, merges) else None
        apart = self.by_word or self.byte_level
        self.end = self.tokenizer.encode(_END, add_special_tokens=False).ids if apart else []
        # Tokens of their own, by ``_alone``.
        self.marks = [self.merges.encode(_in_bytes(m)).ids[0] for m in (_END, _CUT)] if self.merges else []
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _pieces_known(self, spec: dict, merges: Tokenizer | None) -> bool:
        if merges is None or not self.by_word:
            return merges is not None and self.byte_level and merges.pre_tokenizer is None
        steps = [(n.get("type"), (n.get("pattern") or {}).get("Regex")) for n in spec["normalizer"]["normalizers"]]
        cutters = spec["pre_tokenizer"].get("pretokenizers", [])
        return (
            merges.pre_tokenizer is not None
            and set(steps) <= {("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)}
            and len(cutters) == 2
            and cutters[0]["pattern"]["Regex"] == _WORD_CUTTER
            and cutters[1].get("type") == "ByteLevel"
            and not cutters[1].get("use_regex", True)
            and not cutters[1].get("add_prefix_space", True)
        )

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def _encode_words(self, keys: list[str]) -> list[bytes]:
        """Ids of chunks of a word file, many in one text: an end mark is a token that no chunk holds."""
        runs = [keys[at : at + RUN] for at in range(0, len(keys), RUN)]
        out = []
        for run, found in zip(runs, self._encode([f" {_END} ".join([*run, ""]) for run in runs]), strict=True):
            ids = np.frombuffer(found, np.uint32)
            ends = (4 * np.flatnonzero(ids == self.end[0])).tolist()
            if len(ends) != len(run):
                raise ValueError("the end mark is no token of its own in this file")
            out += [found[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]
        return out

    def _merge(self, keys: list[str]) -> list[bytes]:
        """Ids of plain chunks, many in one text, by the file's model; merges cross neither a mark nor a word's end."""
        end, cut = self.marks
        runs = [keys[at : at + RUN] for at in range(0, len(keys), RUN)]
        if self.by_word:
            joined = [f" {_END} ".join([*run, ""]).lower() for run in runs]
            texts = [_in_bytes(text).replace(_in_bytes(" "), " ") for text in joined]
        else:
            joined = [f" {f'{_END} '.join(run)}{_END}".replace(" \n", f"\n{_CUT}").replace(f" {_FIRST}", "") for run in runs]
            texts = [_in_bytes(_CUT_AT_SIGNS.sub(_CUT, text)) for text in joined]
        out = []
        for run, coded in zip(runs, self.merges.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, np.uint32)
            ids = ids[ids != cut]
            ends = (4 * np.flatnonzero(ids == end)).tolist()
            found = ids.tobytes()
            if len(ends) != len(run):
                raise ValueError("the end mark is no token of its own in this file")
            out += [found[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends)]
        return out

    def _text_of(self, key: str) -> str:
        if key[:1] == _FIRST:
            return key[1:]
        if key in (_STOP, _COMMA):
            return "." if key == _STOP else ","
        return key if key[:1] == "\n" else " " + key

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        if self.by_word:
            apart = pc.replace_substring_regex(pc.ascii_lower(texts), _SIGN_BEHIND_LETTER, r"\1 \2")
            return pc.split_pattern(pc.replace_substring(apart, "\n", " "), " ")
        ends = pc.replace_substring(texts, "\n", " \n")
        apart = pc.replace_substring(pc.replace_substring(ends, ". ", f" {_STOP} "), ", ", f" {_COMMA} ")
        cut = pc.if_else(pc.match_substring_regex(texts, _SIGN_RUN), ends, apart)
        return pc.split_pattern(pc.binary_join_element_wise(_FIRST, cut, ""), " ")

    def _look_up(self, keys: list[str]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known, self.older = {}, self.known
        new = [k for k in keys if k not in self.known]
        self.known.update((k, self.older[k]) for k in new if k in self.older)
        new = [k for k in new if k not in self.older]
        for at in range(0, len(new), HELD):
            part = new[at : at + HELD]
            if self.merges is not None:
                plain_key = (_PLAIN_WORD if self.by_word else _PLAIN).fullmatch
                plain = [k for k in part if plain_key(k)]
                self.known.update(zip(plain, self._merge(plain), strict=True))
                part = [k for k in part if k not in self.known]
            if self.by_word and len(self.end) == 1:
                found = self._encode_words(part)
            else:
                found = self._encode(part if self.by_word else [self._text_of(k) for k in part])
            self.known.update(zip(part, found, strict=True))
        return list(map(self.known.__getitem__, keys))

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not (self.byte_level or self.by_word):
            return [np.frombuffer(b, np.uint32) for b in self._encode(texts.to_pylist())]
        whole = pc.match_substring_regex(texts, self.whole)
        chunks = self._chunks(pc.if_else(whole, "", texts))
        coded = chunks.flatten().dictionary_encode()
        # By way of numpy, which makes strings ten times as fast as Arrow does.
        found = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        _, ends, joined = pa.array(found, pa.large_binary()).take(coded.indices).buffers()
        edges = np.frombuffer(ends, np.int64)[np.asarray(chunks.offsets) - chunks.offsets[0].as_py()] // 4
        out = np.split(np.frombuffer(joined or b"", np.uint32), edges[1:])[:-1]
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        for i, text in zip(alone, self._encode(texts.take(pa.array(alone)).to_pylist()), strict=True):
            out[i] = np.frombuffer(text, np.uint32)
        return out


def encoded(encode: Encoder, texts: pa.Array) -> Iterator[np.ndarray]:
    """The ids of each text of a string array in turn, working on about ``BATCH_CHARS`` bytes at a time."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + BATCH_CHARS, side="right")))
        yield from encode(texts.slice(at, end - at))
        # The worker outlives the task, and what it keeps it keeps from its neighbours.
        pa.default_memory_pool().release_unused()
        at = end
