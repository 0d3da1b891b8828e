"""Vectorised text kernels over Arrow batches (numpy; no per-character Python).

Texts arrive as one byte buffer with offsets. Words are maximal runs of bytes
other than space and 0x09-0x0D; A-Z can be folded to a-z. Words and word
n-grams are identified by 64-bit hashes that depend on their bytes only, so they
agree between tasks and machines; a clash of two different words has a chance of
about 2^-64 per pair.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 2 << 20
HASHED = 1 << 19  # bytes whose hashes are worked out at a time

WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ORDER = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    p = np.full(n, BASE, np.uint64)
    if n:
        p[0] = 1
    return np.multiply.accumulate(p)


def buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary() if not pa.types.is_large_string(column.type) else pa.large_binary())
    column = pc.fill_null(column, b"") if column.null_count else column
    wide = pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each of n places the least that it hangs together with by the edges (u, v)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, u, label[v])
        np.minimum.at(label, v, label[u])
        np.minimum.at(label, before, label)  # what a place's old least has found is news to it as well
        label = label[label]
        if (label == before).all():
            return label


def release() -> None:
    """Give back to the system what this worker has freed. Workers wait for later tasks beside the executor's JVM, and
    the allocators would keep what the largest batch took until then."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batches, limit: int = BLOCK):
    """Record batches cut into runs of rows of about ``limit`` text bytes (column "text"); at the
    end of a task's batches freed memory goes back to the system."""
    b = off = None
    for b in batches:
        i = b.schema.get_field_index("text")
        _, off = buffer(b.column(i))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            end = min(end, b.num_rows)
            yield b.slice(at, end - at)
            at = end
    del b, off
    release()


def bounds(data: np.ndarray, off: np.ndarray, ws: np.ndarray = WS):
    """(start, end) of all words, split at the bytes of ``ws`` and at documents' ends."""
    n = len(data)
    solid = ~ws[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    prev = np.empty(n, bool)
    if n:
        prev[0] = False
        prev[1:] = solid[:-1]
        prev &= ~edge[:n]
    start = np.flatnonzero(solid & ~prev)
    follow = np.empty(n, bool)
    if n:
        follow[-1] = False
        follow[:-1] = solid[1:]
        follow &= ~edge[1:]
    return start, np.flatnonzero(solid & ~follow) + 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """Hashes of spans in order, by blocks of whole spans, which keep the 8-byte temporaries small."""
    h = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + HASHED, "right")))
        s, e = start[at:to], end[at:to]
        h[at:to] = span_hash(data[s[0]:e[-1]], s - s[0], e - s[0], fold)
        at = to
    return h


def words(data: np.ndarray, off: np.ndarray, fold: bool = True, ws: np.ndarray = WS):
    """(start, end, hash, per-document word offsets) of all words, split at the bytes of ``ws``
    and at documents' ends."""
    start, end = bounds(data, off, ws)
    return start, end, hashes(data, start, end, fold), np.searchsorted(start, off)


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool) -> np.ndarray:
    """Hashes of spans that don't overlap, in order; by a polynomial whose powers restart at each."""
    total = np.zeros(len(data) + 1, np.uint64)
    ln = e - s
    rel = np.arange(len(data), dtype=np.int64)
    rel -= np.repeat(s, np.diff(np.append(s, len(data)))) if len(s) else 0
    longest = int(ln.max()) if len(ln) else 0
    pw = powers(longest + 1)
    np.minimum(rel, longest, out=rel)
    v = BYTE[LOWER[data] if fold else data] * pw[rel]
    np.cumsum(v, out=total[1:])
    return mix(total[e] - total[s] + ln.astype(np.uint64) * ORDER[63])


def word_hash(word: str) -> int:
    """The hash that ``words`` gives a word (with folding)."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(span_hash(raw, np.array([0]), np.array([len(raw)]), True)[0])


def ngrams(h: np.ndarray, woff: np.ndarray, n: int):
    """(hash, per-document offsets) of the word n-grams; a document of 1 to n-1 words gives
    the whole sequence as one."""
    cnt = np.diff(woff)
    m = len(h)
    val = np.zeros(m, np.uint64)
    for k in range(n):
        part = np.zeros(m, np.uint64)
        part[:max(0, m - k)] = h[k:]
        val += part * ORDER[k]
    val = mix(val)
    out_cnt = np.where(cnt >= n, cnt - n + 1, (cnt > 0).astype(cnt.dtype))
    pos = np.arange(m) - np.repeat(woff[:-1], cnt)
    keep = pos < np.repeat(np.maximum(cnt - n + 1, 0), cnt)
    short = np.flatnonzero((cnt > 0) & (cnt < n))
    for d in short:
        a, b = woff[d], woff[d + 1]
        v = np.uint64(0)
        with np.errstate(over="ignore"):
            for k in range(b - a):
                v = v + h[a + k] * ORDER[k]
            val[a] = mix(np.array([v + ORDER[40 + b - a]], np.uint64))[0]
        keep[a] = True
    off = np.concatenate(([0], np.cumsum(out_cnt)))
    return val[keep], off


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i]+length[i]-1, one run after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    return np.arange(total, dtype=np.int64) + np.repeat(start - first, length)


def string_list(values: np.ndarray, off: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
