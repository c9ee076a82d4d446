"""Simple-8b: token ids packed into 64-bit words, in blocks that decode on their own.

Format of one file image (little-endian):

====================  =====================================================
magic ``PMS8``        4 bytes, then version and block size (unsigned 32-bit)
documents, ids        number of each (unsigned 64-bit)
blocks, escapes       number of each (unsigned 64-bit)
document ids          signed 64-bit each, with one byte each before them: 1 = null
document lengths      unsigned 64-bit each
word offsets          one more than blocks: first word of each block
escape offsets        one more than blocks: first escape of each block
words                 selector in the top 4 bits, values from the lowest bit up
escapes               ids of more than 60 bits, as unsigned 64-bit values
====================  =====================================================

A file is any number of images, each with a line feed behind it.

Selector ``s`` below 14 holds ``60 // WIDTHS[s]`` values of ``WIDTHS[s]`` bits.
Selector 15 stands for one escaped id; its lower bits are the escape's number in
the block.  No word crosses a block, so any block can be decoded alone, all its
words of one selector at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

# The widths that divide 60 bits into distinct counts.
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.uint64)
COUNTS = (60 // WIDTHS).astype(np.int64)
LIMITS = (np.uint64(1) << WIDTHS) - np.uint64(1)
ESCAPE = 15
BLOCK = 4096
MAGIC = b"PMS8"
_HEAD = struct.Struct("<4sIIQQQQ")


def pack(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, word offsets and escape offsets of ``ids`` (unsigned 64-bit)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return ids, ids, np.zeros(1, np.int64), np.zeros(1, np.int64)
    level = np.searchsorted(LIMITS, ids).astype(np.int8)  # 14: needs an escape
    room = np.minimum(block - np.arange(n) % block, n - np.arange(n))
    best = np.full(n, 13, np.int8)
    best[level == 14] = ESCAPE
    for s in range(12, -1, -1):
        count = int(COUNTS[s])
        small = level <= s
        if n < count or np.count_nonzero(small) < count:
            break  # narrower selectors need even more small ids in a row
        run = np.concatenate(([0], np.cumsum(~small)))
        free = np.zeros(n, bool)
        free[: n - count + 1] = run[count:] == run[: n - count + 1]
        best[free & (room >= count)] = s
    step = np.where(best == ESCAPE, 1, COUNTS[np.minimum(best, 13)]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    start = np.array(starts, dtype=np.int64)
    chosen = best[start]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(14):
        mine = np.flatnonzero(chosen == s)
        if len(mine):
            values = ids[start[mine][:, None] + np.arange(COUNTS[s])]
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * WIDTHS[s]
            words[mine] |= np.bitwise_or.reduce(values << shifts, axis=1)
    word_at = np.searchsorted(start, np.arange(blocks + 1) * block)
    odd = np.flatnonzero(chosen == ESCAPE)
    escapes = ids[start[odd]]
    escape_at = np.searchsorted(start[odd], np.arange(blocks + 1) * block)
    words[odd] |= (np.arange(len(odd)) - escape_at[start[odd] // block]).astype(np.uint64)
    return words, escapes, word_at, escape_at


def unpack(words: np.ndarray, escapes: np.ndarray, word_at: np.ndarray, escape_at: np.ndarray) -> np.ndarray:
    """The ids of consecutive blocks, given their slices of offsets."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(selector == ESCAPE, 1, COUNTS[np.minimum(selector, 13)])
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(14):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            shifts = np.arange(COUNTS[s], dtype=np.uint64) * WIDTHS[s]
            out[at[mine][:, None] + np.arange(COUNTS[s])] = (words[mine][:, None] >> shifts) & LIMITS[s]
    odd = np.flatnonzero(selector == ESCAPE)
    if len(odd):
        block = np.searchsorted(word_at - word_at[0], odd, side="right") - 1
        number = (words[odd] & LIMITS[13]).astype(np.int64)
        out[at[odd]] = escapes[escape_at[block] - escape_at[0] + number]
    return out


def write_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, escapes, word_at, escape_at = pack(ids)
    parts = [
        _HEAD.pack(MAGIC, 1, BLOCK, len(doc_ids), len(ids), len(word_at) - 1, len(escapes)),
        bytes(d is None for d in doc_ids),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array(lengths, "<u8").tobytes(),
        word_at.astype("<u8").tobytes(),
        escape_at.astype("<u8").tobytes(),
        words.astype("<u8").tobytes(),
        escapes.astype("<u8").tobytes(),
    ]
    return b"".join(parts)


def read_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of an image."""
    magic, version, _, docs, n, blocks, n_escapes = _HEAD.unpack_from(image)
    if magic != MAGIC or version != 1:
        raise ValueError("not a Simple-8b image of version 1")
    at = _HEAD.size
    null = bytes(image[at : at + docs])
    at += docs

    def take(count: int, kind: str) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(image, kind, count, at)
        at += 8 * count
        return values

    names, lengths = take(docs, "<i8").tolist(), take(docs, "<u8").astype(np.int64)
    word_at, escape_at = (take(blocks + 1, "<u8").astype(np.int64) for _ in range(2))
    words, escapes = take(int(word_at[-1]), "<u8"), take(n_escapes, "<u8")
    ids = unpack(words, escapes, word_at, escape_at)
    if len(ids) != n:
        raise ValueError("damaged Simple-8b image")
    return [None if gone else d for d, gone in zip(names, null, strict=True)], lengths, ids


def join_images(images: list[bytes]) -> bytes:
    """A file: images one after the other, each with a line feed behind it."""
    return b"".join(image + b"\n" for image in images)


def split_images(content: bytes) -> Iterator[memoryview]:
    """The images of a file; one that is cut short, or not followed by a line feed, is an error."""
    at, whole = 0, memoryview(content)
    while at < len(whole):
        if len(whole) - at < _HEAD.size:
            raise ValueError("damaged Simple-8b file")
        _, _, _, docs, _, blocks, n_escapes = _HEAD.unpack_from(whole, at)
        last_offset = at + _HEAD.size + 17 * docs + 8 * blocks
        words = int(np.frombuffer(whole[last_offset : last_offset + 8], "<u8")[0]) if last_offset + 8 <= len(whole) else 0
        end = last_offset + 8 + 8 * (blocks + 1) + 8 * words + 8 * n_escapes
        if end >= len(whole) or whole[end] != 10:
            raise ValueError("damaged Simple-8b file")
        yield whole[at:end]
        at = end + 1


def ids_in(image: bytes | memoryview) -> int:
    """How many ids an image holds, by its head."""
    return _HEAD.unpack_from(image)[4]
