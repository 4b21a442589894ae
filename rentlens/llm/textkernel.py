"""Vectorised words and word hashes over Arrow text columns.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes. A span's hash takes in eight bytes a step, for all spans of
a block at once, and mixes after each; no word becomes a Python object. A word has two such chains of unlike make, with
128 bits between them, and its two hashes each depend on both. Spans of over LONG bytes take BLAKE2b instead. Nothing
here is a polynomial of the bytes, whose hashes of some long, regular words agree whatever the base.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
BLOCK_BYTES = 1 << 19


def lean(f):
    """An Arrow function that gives its memory back when its task ends: a worker runs many tasks, one after the other."""

    @functools.wraps(f)
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        _powers.clear()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return go


def _random_words(name: str, n: int) -> np.ndarray:
    raw = b"".join(hashlib.sha256(f"{name}{i}".encode()).digest() for i in range((n + 3) // 4))
    return np.frombuffer(raw, "<u8")[:n].copy()


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes up to which a span is hashed step by step.
LONG = 256
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
_ROLL = _random_words("roll", 64) | U(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n; kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + 1), base, U)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _mix_other(h: np.ndarray) -> np.ndarray:
    """Another such bijection (the finaliser of MurmurHash3)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


@dataclass
class Block:
    """Some consecutive texts: their bytes, word bounds and word hashes.

    rows: place of the first text in its column; text_at: byte offsets of the texts (one more than texts);
    start, end: byte bounds of each word; hashes, second: two hashes of each word; first: word offsets of the texts;
    folded: the bytes that are hashed; eights: the eight of them from each place on, as one number.
    """

    rows: int
    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    folded: np.ndarray
    eights: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.text_at) - 1

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first))

    def _chain(self, start: np.ndarray, end: np.ndarray, other: bool) -> np.ndarray:
        size = end - start
        h = _mix_other(size.astype(U) + U(0x632BE59BD9B4E019)) if other else mix(size.astype(U) + U(0x9E3779B97F4A7C15))
        who, at, left = np.arange(len(size)), start, size
        if len(size) and size.max() > LONG:
            for i in np.flatnonzero(size > LONG).tolist():
                raw = hashlib.blake2b(self.folded[start[i] : end[i]], digest_size=16).digest()
                h[i] = int.from_bytes(raw[8 * other : 8 * other + 8], "little")
            who = np.flatnonzero(size <= LONG)
            at, left = start[who], size[who]
        while len(who):
            x = self.eights[at] & _FIRST[np.minimum(left, 8)]
            h[who] = _mix_other(h[who] * U(0x9FB21C651E98DF25) + x) if other else mix(h[who] ^ x)
            more = left > 8
            who, at, left = who[more], at[more] + 8, left[more] - 8
        return h

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, for features: one chain."""
        return self._chain(start, end, False)

    @functools.cached_property
    def _chains(self) -> tuple[np.ndarray, np.ndarray]:
        return self._chain(self.start, self.end, False), self._chain(self.start, self.end, True)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        one, two = self._chains
        return mix(one + mix(two))

    @functools.cached_property
    def second(self) -> np.ndarray:
        one, two = self._chains
        return _mix_other(two ^ _mix_other(one * U(0x9FB21C651E98DF25)))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a little-endian number; zeros behind the end."""
    x = np.zeros(len(data) + 8, U)
    x[: len(data)] = data
    for k in (1, 2, 4):
        x[:-k] |= x[k:] << U(8 * k)
    return x


def block_of(data: np.ndarray, text_at: np.ndarray, rows: int = 0, lower: bool = False, space: np.ndarray = _SPACE) -> Block:
    """The block of the texts whose bytes are ``data``; text_at starts at 0 and ends at len(data). space: what parts words."""
    n = len(data)
    inside = ~space[data]
    starts, ends = inside.copy(), inside.copy()
    if n:
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = text_at[(text_at > 0) & (text_at < n)]
        starts[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    folded = _LOWER[data] if lower else data
    return Block(rows, data, text_at, start, end, np.searchsorted(start, text_at), folded, _eights(folded))


def blocks(column: pa.Array, lower: bool = False, most: int = BLOCK_BYTES, space: np.ndarray = _SPACE) -> Iterator[Block]:
    """The column in blocks of about ``most`` bytes; a longer text is a block of its own."""
    data, offsets = _bytes_of(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield block_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i, lower, space)
        i = j


def rolled(hashes: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hashes of every k consecutive words, one for each of the first len - k + 1 words (across texts too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    if k <= 8:
        out = np.zeros(n, U)
        for j in range(k):
            out += hashes[j : j + n] * _ROLL[(j + salt) % 64]
        return mix(out)
    sums = np.zeros(len(hashes) + 1, U)
    base = (int(_ROLL[40 + salt % 8]) << 3 | 5) & (1 << 64) - 1
    np.cumsum(mix(hashes + _ROLL[salt % 64]) * _power(base, len(hashes))[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _power(pow(base, -1, 1 << 64), n)[:n])


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """key and mark: 128 bits that tell rows apart by id and text. A null id is a value of its own, a null text empty."""
    of = (F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.xxhash64(F.lit("key"), *of).alias("key"), F.xxhash64(F.lit("mark"), *of).alias("mark")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string: lengths in bytes, then contents."""
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return b"".join([np.array([len(raw), *map(len, raw)], "<i8").tobytes(), *raw])


def unpacked(blob: bytes, *kinds: str) -> list[np.ndarray]:
    head = np.frombuffer(blob, "<i8", 1 + len(kinds))
    at, out = 8 * (1 + len(kinds)), []
    for size, kind in zip(head[1:], kinds, strict=True):
        out.append(np.frombuffer(blob, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def word_counts(column: pa.Array) -> np.ndarray:
    """Words of each text of a column."""
    data, offsets = _bytes_of(column)
    out, i, n = np.zeros(len(offsets) - 1, np.int64), 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, "right")) - 1))
        inside = ~_SPACE[data[offsets[i] : offsets[j]]]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edge = offsets[i:j] - offsets[i]
        edge = edge[edge < len(inside)]
        starts[edge] = inside[edge]
        out[i:j] = np.diff(np.concatenate([[0], np.cumsum(starts)])[offsets[i : j + 1] - offsets[i]])
        i = j
    return out
