"""Benchmark decontamination by q-gram lemma filtering (operator 2).

Text is folded (A-Z to a-z, white space runs to one space) and handled as UTF-8
bytes. Every benchmark item is cut into windows of ``window`` bytes, one every
``step`` (a shorter item is one window). A window leaks into a document when the
document holds a stretch within ``edits`` edits of it.

1. q-gram lemma: such a stretch shares at least window - q + 1 - q * edits q-grams
   with the window, all on edits + 1 neighbouring diagonals.
2. Diagonals are grouped into bands that overlap by ``edits``, so one band holds
   them all. Shared q-grams are counted by (document, window, band); counts that
   meet the bound are candidates. A cheaper test goes first: only stretches dense
   enough in q-grams of any window can hold such a band.
3. Candidates are verified by banded alignment, all candidates of a batch at once.

The benchmark is the query set: it is dealt into blocks of about ``block_bytes``, and
each block's index (a few times that size) is broadcast for one pass over the documents.

Defined cases: null or empty texts and items never match; items shorter than q bytes
match nothing, and short items take as many edits as still leave ``least`` shared
q-grams; repeated rows give repeated results; repeated items are reported under each
of their ids; a null doc_id or item_id is carried along; further columns are ignored,
and ``drop_leaks`` returns them untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm.common import documents


@dataclass(frozen=True)
class Params:
    window: int = 80
    step: int = 20
    edits: int = 6
    q: int = 8
    band: int = 16
    least: int = 8
    block_bytes: int = 2 << 20


SLICE = 1 << 20   # bytes of texts that are searched at a time
SHARED = 1 << 18  # about so many shared q-grams are counted at a time


def fold(data: np.ndarray, off: np.ndarray):
    """(folded bytes, place of each in ``data``, offsets of the documents in the folded bytes)."""
    ws = K.WS[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(ws[1:] & ws[:-1])
    heads = off[:-1][np.diff(off) > 0]
    keep[heads] = True
    at = np.flatnonzero(keep)
    out = K.LOWER[data[at]]
    out[ws[at]] = 32
    return out, at, np.searchsorted(at, off)


def grams(data: np.ndarray, q: int) -> np.ndarray:
    """The q bytes at every place as one number; places less than q before the end have none."""
    n = max(0, len(data) - q + 1)
    v = np.zeros(n, np.uint64)
    for k in range(q):
        v |= data[k:k + n].astype(np.uint64) << np.uint64(8 * k)
    return v


class Index:
    """q-grams of the windows of some items."""

    def __init__(self, items: list[tuple], p: Params):
        rows, data, lengths, starts, least, edits = [], [], [], [], [], []
        at = 0
        for i, (_, text) in enumerate(items):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            raw, _, _ = fold(raw, np.array([0, len(raw)]))
            raw = raw[int(len(raw) and raw[0] == 32):]
            raw = raw[:len(raw) - int(len(raw) and raw[-1] == 32)]
            if len(raw) < p.q:
                continue
            size = min(len(raw), p.window)
            k = min(p.edits, max(0, (size - p.q + 1 - p.least) // p.q))
            for s in dict.fromkeys([*range(0, len(raw) - size + 1, p.step), len(raw) - size]):
                rows.append(i)
                starts.append(at + s)
                lengths.append(size)
                edits.append(k)
                least.append(size - p.q + 1 - p.q * k)
            data.append(raw)
            data.append(np.zeros(p.q, np.uint8))
            at += len(raw) + p.q
        self.ids = [r[0] for r in items]
        self.item = np.array(rows, np.int64)
        self.start, self.size = np.array(starts, np.int64), np.array(lengths, np.int64)
        self.least, self.edits = np.array(least, np.int64), np.array(edits, np.int64)
        self.data = np.concatenate([*data, np.zeros(p.window, np.uint8)]) if data else np.zeros(0, np.uint8)
        # one entry for every q-gram of every window
        n = self.size - p.q + 1
        place = K.ragged(self.start, n)
        win = np.repeat(np.arange(len(n)), n)
        v = grams(self.data, p.q)[place] if len(place) else np.zeros(0, np.uint64)
        order = np.argsort(v, kind="stable")
        v, self.win, self.place = v[order], win[order], place[order]
        self.keys, first = np.unique(v, return_index=True)
        self.first = np.append(first, len(v))
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.keys)) * 32))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[K.mix(self.keys) >> np.uint64(64 - self.bits)] = True

    def search(self, data: np.ndarray, off: np.ndarray, p: Params):
        """(document, item, first byte, end byte, edits) of the regions in folded bytes."""
        none = tuple(np.zeros(0, np.int64) for _ in range(5))
        if not len(self.keys) or len(data) < p.q:
            return none
        v = grams(data, p.q)
        hit = self.seen[K.mix(v) >> np.uint64(64 - self.bits)]
        # dense stretches: at least the smallest bound of hits within the longest reach
        reach = int(self.size.max()) - p.q + 1 + 2 * p.edits
        total = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
        end = np.minimum(np.arange(len(v)) + reach, len(v))
        dense = hit & (total[end] - total[:-1] >= int(self.least.min()))
        heads = np.flatnonzero(dense)
        if not len(heads):
            return none
        cover = np.zeros(len(v) + 1, np.int32)
        np.add.at(cover, heads, 1)
        np.add.at(cover, np.minimum(heads + reach, len(v)), -1)
        pos = np.flatnonzero(hit & (np.cumsum(cover)[:-1] > 0))
        k = np.minimum(np.searchsorted(self.keys, v[pos]), len(self.keys) - 1)
        ok = self.keys[k] == v[pos]
        pos, k = pos[ok], k[ok]
        doc = np.searchsorted(off, pos, "right") - 1
        ok = pos + p.q <= off[doc + 1]
        pos, k, doc = pos[ok], k[ok], doc[ok]
        parts, at = [], 0
        each = self.first[k + 1] - self.first[k]
        upto = np.cumsum(each)
        while at < len(pos):  # documents by the piece, so that frequent q-grams stay bounded
            to = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SHARED, "right"))
            to = max(to, at + 1)
            to = int(np.searchsorted(doc, doc[to - 1], "right"))
            parts.append(self._count(pos[at:to], k[at:to], doc[at:to], off, p))
            at = to
        d, w, diag, lo, hi = (np.concatenate(x) for x in zip(*parts))
        if not len(d):
            return none
        cost = np.concatenate([self._align(data, off, d[i:i + 4096], w[i:i + 4096], diag[i:i + 4096], p) for i in range(0, len(d), 4096)])
        ok = cost <= self.edits[w]
        return d[ok], self.item[w[ok]], lo[ok], hi[ok], cost[ok]

    def _count(self, pos, k, doc, off, p):
        n = self.first[k + 1] - self.first[k]
        e = K.ragged(self.first[k], n)
        x, d, w = np.repeat(pos, n), np.repeat(doc, n), self.win[e]
        diag = (x - off[d]) - (self.place[e] - self.start[w]) + self.size.max()  # never negative
        band = diag // p.band
        low = np.flatnonzero((diag % p.band < p.edits) & (band > 0))  # also in the band before
        x, d, w, band = (np.concatenate((a, b)) for a, b in ((x, x[low]), (d, d[low]), (w, w[low]), (band, band[low] - 1)))
        order = np.lexsort((x, band, w, d))
        x, d, w, band = x[order], d[order], w[order], band[order]
        new = np.ones(len(x), bool)
        new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1]) | (band[1:] != band[:-1])
        fresh = new.copy()
        fresh[1:] |= x[1:] != x[:-1]
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(x)) - 1
        count = np.add.reduceat(fresh.astype(np.int64), head) if len(head) else head
        ok = count >= self.least[w[head]]
        return d[head[ok]], w[head[ok]], band[head[ok]] * p.band - self.size.max(), x[head[ok]], x[last[ok]] + p.q

    def _align(self, data, off, d, w, diag, p):
        """Least edits between each window and any stretch of its document on the band's diagonals."""
        width = p.band + 3 * p.edits + 1
        lo, hi = off[d], off[d + 1]
        first = lo + diag - p.edits             # document place of column 0 in row 0
        cols = np.arange(width)
        row = np.zeros((len(d), width), np.int32)
        best = np.full(len(d), 1 << 20, np.int32)
        for i in range(int(self.size[w].max())):
            at = first[:, None] + i + cols      # column j of row i is document place first + i + j
            inside = (at >= lo[:, None]) & (at < hi[:, None])
            c = np.where(inside, data[np.clip(at, 0, len(data) - 1)], 0)
            sub = row + (c != self.data[self.start[w] + i][:, None])
            skip = np.full_like(row, 1 << 20)   # the window's byte has no partner
            skip[:, :-1] = row[:, 1:] + 1
            new = np.minimum(sub, skip)
            new = np.minimum.accumulate(new - cols, axis=1) + cols  # a document byte has no partner
            row = new
            done = self.size[w] == i + 1
            best[done] = row[done].min(axis=1)
        return best


def _run(index, p: Params):
    def run(batches):
        ix = index.value
        for b in K.slices(batches, SLICE):
            raw, off = K.buffer(b.column("text"))
            data, at, foff = fold(raw, off)
            d, item, lo, hi, cost = ix.search(data, foff, p)
            chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
            ids = b.column("doc_id").to_pylist()
            found: dict = {}
            for x, i, s, e, c in zip(d.tolist(), item.tolist(), lo.tolist(), hi.tolist(), cost.tolist()):
                s = int(chars[at[s]] - chars[off[x]])
                e = int(chars[at[e - 1] + 1] - chars[off[x]])
                old = found.get((x, i))
                found[x, i] = (min(s, old[0]), max(e, old[1]), min(c, old[2])) if old else (s, e, c)
            rows = [(ids[x], ix.ids[i], *v) for (x, i), v in found.items()]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "start", "stop", "edits"])
    return run


def leaks(docs: DataFrame, bench: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each document row and item with a verified region: doc_id, item_id,
    start, stop (code points of the shared q-grams' extent), edits (of the best window)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // p.block_bytes))
    out = None
    for i in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        rows = sorted(((r[0], r[1]) for r in mine.collect()), key=lambda r: (r[0] is None, r))
        index = spark.sparkContext.broadcast(Index(rows, p))
        part = docs.mapInArrow(_run(index, p), "doc_id long, item_id long, start long, stop long, edits long")
        out = part if out is None else out.unionAll(part)
    return out


def drop_leaks(docs: DataFrame, bench: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns. A row is judged by its own text, whether it
    has a doc_id, shares one or not."""
    key = F.xxhash64("doc_id", "text")
    found = leaks(docs.select(key.alias("doc_id"), "text"), bench, p).select(F.col("doc_id").alias("key")).distinct()
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"))
    return rows.join(found, "key", "left_anti").select("row.*")


def op2_qgram_lemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
