"""Language-model scores from an Elias-Fano n-gram trie (operator 10).

Words (A-Z folded) and one end of text are tokens, known by 64-bit hashes. Level 1 of
the trie holds every training token and its exact count; level 2 holds, under each
context token, its successors. A token's probability is its add-half unigram
probability p0, sharpened by its context c:

    p(w | c) = C(c, w) / (N(c) + mu) + mu / (N(c) + mu) * p0(w)

* Both levels are cut into shards: level 1 by hash, level 2 by bits of the context and
  bits of the successor, so a frequent context is spread over many shards. The number
  of shards follows the shuffle partitions.
* In a shard all sequences that grow are Elias-Fano coded: token hashes, the pointers
  from contexts to successors, and successors (40-bit prints) made monotone by their
  context's rank. The first term of p is kept as one byte, on a logarithmic scale.
* A look-up finds a context's rank and then the successor relative to that rank: the
  high bits lead to a bucket by a small directory, the low bits are bisected there.
* Tasks count within windows and ship packed counts; one task a shard merges them and
  writes the shard's file in the shared folder, under a temporary name first, so tasks
  can be repeated. Scoring tasks map the files; nothing of the model is broadcast.

The shared folder must be a mounted one (a path or file:), as files are memory-mapped.

Defined cases: null, empty or blank text is the end token alone; repeated rows are
scored, and learned from, as often as they occur; without training rows every
probability is 1 and every score 0; a null doc_id is scored, not learned from;
further columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm.common import crc_mod, documents, partitions
from gradewell.session import scratch_path

MU = 40.0
PRINT = 40                              # bits of a successor's print
END, START = np.uint64(0xA5A5_0E0D_5EED_0001), np.uint64(0xA5A5_0E0D_5EED_0002)
WINDOW = 2 << 20                        # tokens counted together in a task
SCALE = np.log(1e-9) / 254              # a byte's step on the logarithmic scale


# ---- Elias-Fano ------------------------------------------------------------------

def ef_encode(values: np.ndarray, universe: int) -> dict:
    """Arrays of a sorted sequence of numbers below ``universe`` (at most 2^64)."""
    n = len(values)
    low = max(0, (universe // max(1, n)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low)).astype(np.int64)
    buckets = int((universe - 1) >> low) + 1
    bits = np.zeros(-(-(n + buckets + 128) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(np.uint64)
    zeros = 64 - np.bitwise_count(words).astype(np.int64)
    directory = np.concatenate(([0], np.cumsum(zeros)))[:-1:8]  # zeros before every eighth word
    packed = np.zeros(-(-n * low // 64) + 2, np.uint64)
    if low and n:
        kept = values & np.uint64((1 << low) - 1)
        at = np.arange(n, dtype=np.int64) * low
        w, r = at >> 6, (at & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        packed[w[first]] |= np.bitwise_or.reduceat(kept << r, first)
        over = np.flatnonzero(r.astype(np.int64) + low > 64)
        packed[w[over] + 1] |= kept[over] >> (np.uint64(64) - r[over])
    return {"meta": np.array([n, low, buckets], np.int64), "high": words, "dir": directory, "low": packed}


def _word_at(words, bit):
    """The 64 bits that start at each place."""
    w, r = bit >> 6, (bit & 63).astype(np.uint64)
    lo = words[w] >> r
    hi = np.where(r > 0, words[w + 1] << ((np.uint64(64) - r) & np.uint64(63)), np.uint64(0))
    return lo | hi


def _zero_place(x, k):
    """Place of the k-th (from 0) zero bit of each word, which must have it."""
    z, at, k = ~x, np.zeros(len(x), np.int64), k.copy()
    for step in (32, 16, 8, 4, 2, 1):
        part = (z >> at.astype(np.uint64)) & np.uint64((1 << step) - 1)
        c = np.bitwise_count(part).astype(np.int64)
        skip = c <= k
        k -= np.where(skip, c, 0)
        at += np.where(skip, step, 0)
    return at


def _lows(ef, i):
    low = int(ef["meta"][1])
    if not low:
        return np.zeros(len(i), np.uint64)
    at = i * low
    w, r = at >> 6, (at & 63).astype(np.uint64)
    v = ef["low"][w] >> r
    v |= np.where(r > 0, ef["low"][w + 1] << ((np.uint64(64) - r) & np.uint64(63)), np.uint64(0))
    return v & np.uint64((1 << low) - 1)


def _bucket(ef: dict, h: np.ndarray) -> np.ndarray:
    """The bit where each bucket begins: after the (h - 1)-th zero."""
    k = h - 1
    block = np.maximum(np.searchsorted(ef["dir"], k, "right") - 1, 0)
    left = k - ef["dir"][block]
    w = block * 8
    todo = np.flatnonzero(h > 0)
    bit = np.zeros(len(h), np.int64)
    while len(todo):
        word = ef["high"][w[todo]]
        zeros = 64 - np.bitwise_count(word).astype(np.int64)
        here = zeros > left[todo]
        go = todo[here]
        bit[go] = w[go] * 64 + _zero_place(word[here], left[go]) + 1
        todo = todo[~here]
        left[todo] -= zeros[~here]
        w[todo] += 1
    return bit


def ef_find(ef: dict, x: np.ndarray) -> np.ndarray:
    """Index of each number, or -1: the high bits name a bucket, the low bits are bisected there."""
    n, low, buckets = (int(v) for v in ef["meta"])
    out = np.full(len(x), -1, np.int64)
    if not n or not len(x):
        return out
    x = x.astype(np.uint64)
    hx = (x >> np.uint64(low)).astype(np.int64)
    ask = np.flatnonzero(hx < buckets)
    hx = hx[ask]
    bit = _bucket(ef, hx)
    lo = bit - hx                                   # rank of the bucket's first value
    word = _word_at(ef["high"], bit)
    ones = np.where(~word == 0, 64, np.bitwise_count(word & ~(word + np.uint64(1))).astype(np.int64))
    long = np.flatnonzero(ones == 64)
    if len(long):
        ones[long] = _bucket(ef, hx[long] + 1) - 1 - bit[long]
    some = np.flatnonzero(ones)
    ask, lo, hi, want = ask[some], lo[some], (lo + ones)[some], (x[ask] & np.uint64((1 << low) - 1))[some]
    end = hi.copy()
    todo = np.arange(len(ask))
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        less = _lows(ef, mid) < want[todo]
        lo[todo[less]] = mid[less] + 1
        hi[todo[~less]] = mid[~less]
        todo = todo[lo[todo] < hi[todo]]
    ok = np.flatnonzero(lo < end)
    ok = ok[_lows(ef, lo[ok]) == want[ok]]
    out[ask[ok]] = lo[ok]
    return out


# ---- files -----------------------------------------------------------------------

def save(path: str, arrays: dict) -> None:
    """One file of named arrays at multiples of 8 bytes, put in place at once."""
    head, at, parts = {}, 0, []
    for k, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head[k] = (at, a.dtype.str, len(a))
        raw += bytes(-len(raw) % 8)
        at += len(raw)
        parts.append(raw)
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 8)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as f:
        f.write(len(text).to_bytes(8, "little") + text)
        for raw in parts:
            f.write(raw)
    os.replace(tmp, path)


def load(path: str) -> dict:
    """The arrays of a file, memory-mapped."""
    raw = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8:8 + size].tobytes())
    out = {}
    for k, (at, kind, n) in head.items():
        dtype = np.dtype(kind)
        a = 8 + size + at
        out[k] = np.asarray(raw[a:a + n * dtype.itemsize]).view(dtype)
    return out


def _ef(arrays: dict, name: str) -> dict:
    return {k: arrays[f"{name}.{k}"] for k in ("meta", "high", "dir", "low")}


def _named(name: str, ef: dict) -> dict:
    return {f"{name}.{k}": v for k, v in ef.items()}


def small(counts: np.ndarray) -> dict:
    """Counts as a byte each, with the large ones aside."""
    big = np.flatnonzero(counts >= 255)
    return {"c8": np.minimum(counts, 255).astype(np.uint8), "big": big.astype(np.int64), "bigc": counts[big].astype(np.int64)}


def large(a: dict, i: np.ndarray) -> np.ndarray:
    c = a["c8"][i].astype(np.int64)
    over = np.flatnonzero(c == 255)
    c[over] = a["bigc"][np.searchsorted(a["big"], i[over])]
    return c


class Shards:
    """Where tokens and pairs are kept."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.right = bits // 2          # bits of the successor
        self.left = bits - self.right   # bits of the context

    def path(self, level: int, shard: int) -> str:
        return f"{self.folder}/level{level}-{shard:06d}"

    def open(self, level: int, shard: int) -> dict | None:
        p = self.path(level, shard)
        return load(p) if os.path.exists(p) else None  # a shard without tokens has no file

    def of_token(self, h):
        return (h >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)

    def of_pair(self, a, b):
        left = (a >> np.uint64(64 - self.left)).astype(np.int64) if self.left else np.zeros(len(a), np.int64)
        right = ((b >> np.uint64(63 - self.right)) & np.uint64((1 << self.right) - 1)).astype(np.int64)
        return (left << self.right) | right

    def counts(self, h: np.ndarray, opened: dict) -> np.ndarray:
        """Training counts of tokens."""
        out, shard = np.zeros(len(h), np.int64), self.of_token(h)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for a, b in zip(cut, cut[1:]):
            at = order[a:b]
            s = int(shard[at[0]])
            if (1, s) not in opened:
                opened[1, s] = self.open(1, s)
            file = opened[1, s]
            if file is not None:
                i = ef_find(_ef(file, "key"), h[at])
                ok = i >= 0
                out[at[ok]] = large(file, i[ok])
        return out

    def terms(self, a: np.ndarray, b: np.ndarray, opened: dict) -> np.ndarray:
        """C / (N + mu) of pairs of a context and a token, 0 for unseen ones."""
        out, shard = np.zeros(len(a)), self.of_pair(a, b)
        order = np.argsort(shard, kind="stable")
        cut = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for x, y in zip(cut, cut[1:]):
            at = order[x:y]
            s = int(shard[at[0]])
            if (2, s) not in opened:
                opened[2, s] = self.open(2, s)
            file = opened[2, s]
            if file is None:
                continue
            own, inverse = np.unique(a[at], return_inverse=True)
            rank = ef_find(_ef(file, "context"), own)[inverse]
            at, rank = at[rank >= 0], rank[rank >= 0]
            i = ef_find(_ef(file, "next"), (rank.astype(np.uint64) << np.uint64(PRINT)) | prints(b[at]))
            ok = i >= 0
            out[at[ok]] = np.exp(SCALE * file["term"][i[ok]])
        return out


def prints(h):
    return h & np.uint64((1 << PRINT) - 1)


# ---- counting and building -----------------------------------------------------------

def tokens(column):
    """(hashes of all tokens, end tokens included, offsets)."""
    data, off = K.buffer(column)
    _, _, h, woff = K.words(data, off)
    n = len(off) - 1
    out = np.empty(len(h) + n, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(woff))] = h
    off = woff + np.arange(n + 1)
    out[off[1:] - 1] = END
    return out, off


def contexts(h, off):
    c = np.empty(len(h), np.uint64)
    c[1:] = h[:-1]
    c[off[:-1]] = START
    return c


def _windows(batches, make):
    held, size = [], 0
    for b in K.slices(batches):
        h, off = tokens(b.column("text"))
        held.append((h, contexts(h, off)))
        size += len(h)
        if size >= WINDOW:
            yield from make(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held, size = [], 0
    if size:
        yield from make(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))


def _blobs(shard, order_key, pack):
    cut = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for a, b in zip(cut, cut[1:]):
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int64()), pa.array([order_key], pa.int64()),
                                          pa.array([pack(a, b)], pa.binary())], ["shard", "origin", "blob"])


def _count_tokens(shards: Shards):
    def run(batches):
        def make(h, _):
            v, c = np.unique(h, return_counts=True)
            c = c.astype(np.uint32)
            yield from _blobs(shards.of_token(v), TaskContext.get().partitionId(), lambda a, b: v[a:b].tobytes() + c[a:b].tobytes())
        yield from _windows(batches, make)
    return run


def _count_pairs(shards: Shards):
    def run(batches):
        def make(h, c):
            shard = shards.of_pair(c, h)
            order = np.lexsort((h, c, shard))
            shard, c, h = shard[order], c[order], h[order]
            head = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (h[1:] != h[:-1]))))
            times = np.diff(np.append(head, len(h)))
            shard, c, p = shard[head], c[head], prints(h[head]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PRINT // 8]

            def pack(a, b):
                first = np.flatnonzero(np.concatenate(([True], c[a + 1:b] != c[a:b - 1])))
                n = np.diff(np.append(first, b - a)).astype(np.uint32)
                t = small(times[a:b])
                sizes = np.array([len(first), b - a, len(t["big"])], np.int64)
                return b"".join(x.tobytes() for x in (sizes, c[a:b][first], n, p[a:b], t["c8"], t["big"], t["bigc"]))
            yield from _blobs(shard, TaskContext.get().partitionId(), pack)
        yield from _windows(batches, make)
    return run


def _unpack_pairs(raw: bytes):
    nc, n, nb = np.frombuffer(raw, np.int64, 3).tolist()
    at = 24
    c = np.frombuffer(raw, np.uint64, nc, at)
    k = np.frombuffer(raw, np.uint32, nc, at + 8 * nc)
    at += 12 * nc
    p = np.zeros((n, 8), np.uint8)
    p[:, :PRINT // 8] = np.frombuffer(raw, np.uint8, n * (PRINT // 8), at).reshape(n, -1)
    at += n * (PRINT // 8)
    times = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    at += n
    times[np.frombuffer(raw, np.int64, nb, at)] = np.frombuffer(raw, np.int64, nb, at + 8 * nb)
    return np.repeat(c, k), p.view("<u8").reshape(-1).astype(np.uint64), times


def _by_shard(batches):
    shard, blobs = None, []
    for b in batches:
        for s, raw in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist()):
            if shard is not None and s != shard:
                yield shard, blobs
                blobs = []
            shard = s
            blobs.append(raw)
    if shard is not None:
        yield shard, blobs


def _build_tokens(shards: Shards):
    def run(batches):
        for shard, blobs in _by_shard(batches):
            os.makedirs(shards.folder, exist_ok=True)
            parts = [(np.frombuffer(r, np.uint64, len(r) // 12), np.frombuffer(r, np.uint32, len(r) // 12, len(r) // 12 * 8)) for r in blobs]
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.zeros(len(h), np.int64)
            np.add.at(c, at, np.concatenate([p[1] for p in parts]).astype(np.int64))
            save(shards.path(1, shard), {**_named("key", ef_encode(h, 1 << 64)), **small(c)})
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(h), int(c.sum()))], ["shard", "n", "total"])
    return run


def _build_pairs(shards: Shards, mu: float):
    def run(batches):
        opened: dict = {}
        for shard, blobs in _by_shard(batches):
            parts = [_unpack_pairs(r) for r in blobs]
            c, p, t = (np.concatenate([x[k] for x in parts]) for k in range(3))
            order = np.lexsort((p, c))
            c, p, t = c[order], p[order], t[order]
            head = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (p[1:] != p[:-1]))))
            c, p, t = c[head], p[head], np.add.reduceat(t, head)
            own, first, rank = np.unique(c, return_index=True, return_inverse=True)
            total = shards.counts(np.where(own == START, END, own), opened)
            term = t / (total[rank] + mu)
            byte = np.clip(np.rint(np.log(term) / SCALE), 0, 255).astype(np.uint8)
            pairs = (rank.astype(np.uint64) << np.uint64(PRINT)) | p
            save(shards.path(2, shard), {
                **_named("context", ef_encode(own, 1 << 64)), **_named("pointer", ef_encode(np.append(first, len(c)), len(c) + 1)),
                **_named("next", ef_encode(pairs, len(own) << PRINT)), "term": byte})
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(c), int(t.sum()))], ["shard", "n", "total"])
    return run


def build(docs: DataFrame, mu: float = MU):
    """Count and write the trie of ``docs``; returns (Shards, tokens, distinct tokens)."""
    spark = docs.sparkSession
    bits = max(4, (partitions(spark) - 1).bit_length())
    folder = scratch_path(spark, f"llm-lm-{uuid.uuid4().hex[:12]}")
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    elif "://" in folder:
        raise ValueError(f"the trie's levels are memory-mapped: spark.checkpoint.dir must be a mounted folder, not {folder}")
    os.makedirs(folder, exist_ok=True)
    shards, text = Shards(folder, bits), docs.select("text")
    schema, built = "shard long, origin long, blob binary", "shard long, n long, total long"

    def merged(count, make):
        dealt = text.mapInArrow(count, schema).repartition(1 << bits, "shard").sortWithinPartitions("shard", "origin")
        return dealt.mapInArrow(make, built).agg(F.sum("n"), F.sum("total")).first()
    n, total = merged(_count_tokens(shards), _build_tokens(shards))
    merged(_count_pairs(shards), _build_pairs(shards, mu))
    return shards, total or 0, n or 0


def _score(shards: Shards, total: int, distinct: int, mu: float):
    def run(batches):
        opened: dict = {}
        for b in K.slices(batches):
            h, off = tokens(b.column("text"))
            word, at = np.unique(h, return_inverse=True)
            count = shards.counts(word, opened)
            p0 = (count + 0.5) / (total + 0.5 * (distinct + 1))
            c = contexts(h, off)
            key = K.mix(c) ^ (h * K.ORDER[7])
            _, first, pair = np.unique(key, return_index=True, return_inverse=True)
            pc, ph = c[first], h[first]
            ctx = count[np.searchsorted(word, np.where(pc == START, END, pc))]
            term = shards.terms(pc, ph, opened) + mu / (ctx + mu) * p0[at[first]]
            add = lambda v: np.add.reduceat(v, off[:-1]) if len(off) > 1 else v[:0]
            rows = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(np.diff(off).astype(np.int64)), pa.array(add((count > 0)[at].astype(np.int64))),
                 pa.array(np.full(rows, total, np.int64)), pa.array(add(np.log10(p0)[at])), pa.array(add(np.log10(term)[pair]))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, model, held_out=None, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    shards, total, distinct = model
    held = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_score(shards, total, distinct, mu), "doc_id long, held_out boolean, n_tokens long, n_known long, "
                                                                "train_tokens long, base_score double, score double")


def op10_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_mod(F.col("doc_id"), 5) == 1
    return score(docs, build(docs.where(~held)), held)
