"""Vectorised text kernels shared by the corpus operators.

Texts stay in Arrow buffers: words are found, lower-cased and hashed with numpy
over the UTF-8 bytes of many documents at once, so that no Python object is made
per word.  All byte classes used here are ASCII, so bytes and code points agree.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2_000_000
SEGMENT = 1 << 18  # bytes whose running hashes are held at once
TRIM_BYTES = 64 << 20  # after so many bytes a task gives its free memory back

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: bytes that are part of a word: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: bytes that are part of a word: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (xor-shift and multiply), vectorised."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


#: powers of the base and of its inverse
_POWER, _BACK = (
    np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(SEGMENT, b, np.uint64)])) for b in (_BASE, _BASE_INV)
)


def spelt(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of the bytes of each run, to be mixed with its length; runs ascend and don't overlap."""
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        base = int(start[k])
        last = max(k + 1, int(np.searchsorted(end, base + SEGMENT, "right")))
        n = int(end[last - 1]) - base
        if n > SEGMENT:  # one long run, in steps
            total, power, step = 0, 1, int(_POWER[SEGMENT])
            for a in range(base, base + n, SEGMENT):
                part = _BYTE[data[a : min(a + SEGMENT, base + n)]]
                total += power * int((part * _POWER[: len(part)]).sum(dtype=np.uint64))
                power = power * step % (1 << 64)
            out[k] = np.uint64(total % (1 << 64))
        else:
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data[base : base + n]] * _POWER[:n], out=total[1:])
            a = start[k:last] - base
            out[k:last] = (total[end[k:last] - base] - total[a]) * _BACK[a]
        k = last
    return out


class Lookup:
    """Position of 64-bit keys in a sorted array, or -1; a table over the leading bits saves the binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, min(20, len(keys).bit_length()))
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        if not len(self.keys):
            return out
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        open_ = np.arange(len(h))
        while len(open_):
            here = at[open_]
            inside = here < len(self.keys)
            open_, here = open_[inside], here[inside]
            found = self.keys[here]
            same = found == h[open_]
            out[open_[same]] = here[same]
            more = found < h[open_]
            open_ = open_[more]
            at[open_] += 1
        return out


def trim() -> None:
    """Give memory that is free again back to the machine: Arrow's pool and the C library's heap."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; a null is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of `column`; a longer row is a slice of its own."""
    met = 0
    for batch in batches:
        _, at = raw(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
        met += int(at[-1])
        if met > TRIM_BYTES:
            trim()
            met = 0
    if met > CHUNK_BYTES:
        trim()  # the worker process goes on to other tasks


class Words:
    """The words of some documents.

    data: lower-cased bytes; start, end: of each word; doc: its row; first: index of
    each row's first word (n + 1 entries); hash: 64 bits of each word's bytes.
    """

    def __init__(self, column: pa.Array, inside: np.ndarray = SPACED, lower: bool = True):
        data, at = raw(column)
        if lower:
            data = LOWER[data]
        self.data, self.at = data, at
        n = len(data)
        mask = np.zeros(n + 2, bool)
        mask[1:-1] = inside[data]
        # a row's end also ends a word
        left = mask[1:-1] & ~mask[:-2]
        right = mask[1:-1] & ~mask[2:]
        cut = at[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        left[cut] = mask[1:-1][cut]
        right[cut - 1] = mask[1:-1][cut - 1]
        self.start = np.flatnonzero(left)
        self.end = np.flatnonzero(right) + 1
        self.first = np.searchsorted(self.start, at, "left")
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.hash = mix(spelt(data, self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)


def word_hash(word: str) -> int:
    """The hash that `Words` gives a word (already lower-cased where it matters)."""
    return int(Words(pa.array([word]), np.ones(256, bool), lower=False).hash[0])


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all n-grams of a word sequence, documents not regarded: entry i covers words i to i + n - 1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    total = np.full(m, np.uint64((salt * 0x9E3779B97F4A7C15 + n) & (2**64 - 1)))
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + m]
    return mix(total)
