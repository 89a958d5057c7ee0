"""Vectorised word splitting and hashing over Arrow text columns.

Texts stay UTF-8 bytes. The word classes below only test ASCII bytes, so a byte test equals the code point test.
Hashes are 64-bit polynomial hashes of the word's bytes, finished with a mixing step; where equality of hashes decides
a result, callers compare the bytes as well or state the odds.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {"pw": np.ones(1, U64), "inv": np.ones(1, U64)}

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing: digits, a-z and every byte of a non-ASCII code point.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: [^\x20\x09-\x0D]
SOLID = np.ones(256, bool)
SOLID[0x20] = SOLID[0x09:0x0E] = False


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


@functools.cache
def _trim() -> Callable | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def bounded(fn: Callable) -> Callable:
    """fn, with the memory that a batch has taken given back to the system after it: workers live on between stages."""

    @functools.wraps(fn)
    def inner(*args):
        try:
            return fn(*args)
        finally:
            release()

    return inner


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["pw"]) < n:
        n = max(n, 1 << 20)
        for key, base in (("pw", _P), ("inv", _PINV)):
            t = np.full(n, base, U64)
            t[0] = 1
            _tables[key] = np.multiply.accumulate(t)
    return _tables["pw"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


@dataclass
class Chunk:
    """Some consecutive texts of a batch: rows first..last of it, their bytes, and offsets into those."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def chunks(col: pa.Array, target: int = 1 << 20) -> Iterator[Chunk]:
    """Cut a column into runs of whole texts of about ``target`` bytes; a longer text is a run of its own."""
    offsets, data = buffers(col)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1)
        j = min(j, n)
        yield Chunk(i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    """Words of a chunk in text order: byte range, index of the text they are in, and hash."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    n_docs: int
    hashes: np.ndarray

    def first_of(self) -> np.ndarray:
        """For each text, the index of its first word; n_docs + 1 entries."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))

    def joined(self, i: int, n: int) -> bytes:
        """Words i to i + n, joined by spaces."""
        d = self.data
        return b" ".join(d[s:e].tobytes() for s, e in zip(self.starts[i : i + n], self.ends[i : i + n], strict=True))


def split(chunk: Chunk, mask: np.ndarray, fold: np.ndarray = LOWER, hashed: bool = True) -> Words:
    """Maximal runs of bytes in ``mask`` (after ``fold``); no run crosses from one text to the next."""
    data, offsets = fold[chunk.data], chunk.offsets
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(data, e, e, e, len(chunk), np.zeros(0, U64))
    m = mask[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    if not hashed:
        return Words(data, starts, ends, doc, len(chunk), np.zeros(0, U64))
    return Words(data, starts, ends, doc, len(chunk), range_hashes(data, starts, ends))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of ``data``."""
    n = len(data)
    pw, inv = _powers(n + 1)
    sums = np.empty(n + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * pw[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts])


_STEP = [U64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(64)]


def windows(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` consecutive words within one text, and the index of each one's first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    acc = hashes[:m].copy()
    for k in range(1, n):
        acc += hashes[k : k + m] * _STEP[k]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :]) if n > 1 else np.arange(m)
    return mix(acc[at] + U64(n)), at


def window_hash(hashes: np.ndarray) -> int:
    """The hash that ``windows`` gives these words as one window."""
    return int(windows(hashes, np.zeros(len(hashes), np.int64), len(hashes))[0][0])


def words_of(text: str | None, mask: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """The words of one text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return split(Chunk(0, 1, data, np.array([0, len(data)])), mask, fold)


class HashSet:
    """Sorted 64-bit keys behind a bitmap, for fast membership of many probes."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(np.asarray(keys, U64))
        self._map()

    def __getstate__(self):
        return self.keys

    def __setstate__(self, keys: np.ndarray):
        self.keys = keys
        self._map()

    def _map(self) -> None:
        bits = max(12, min(24, int(len(self.keys)).bit_length() + 4))
        self.mask = U64((1 << bits) - 1)
        self.map = np.zeros(1 << bits, bool)
        self.map[self.keys & self.mask] = True

    def find(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the probes that are keys, and which key each of them is."""
        at = np.flatnonzero(self.map[probes & self.mask])
        if not len(self.keys) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.keys, probes[at])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == probes[at]
        return at[ok], k[ok]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of consecutive runs of ``values``."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
