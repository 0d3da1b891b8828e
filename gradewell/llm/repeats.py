"""Repeated strings by common-prefix interval trees over a sparse suffix array (operator 6).

A byte is removed if a string of ``length`` bytes that covers it also starts earlier
(smaller doc_id, or earlier in the document); texts are UTF-8 bytes.

1. Anchors: of every window of ``length`` bytes the place with the least hash of
   ``gram`` bytes, leftmost on ties. Equal windows have equal anchors at equal places,
   so all that can repeat meets under an anchor's hash; about one place in forty is one.
2. Only anchors that may share a window with another go on. Every window reaches half of
   its bytes besides the anchor to the right of it or to the left, so two anchors that
   share one agree in a print of that much right or left context. What a task sees to be
   repeated goes on spread by salt, and one row for each pair of prints stands for it, so
   a passage that every document holds is no hot key.
3. An anchor's record is its suffix, up to the end of its last window, and the bytes
   before it, back to its first window. Equal records of a task are sent once; the later
   ones are spans already.
4. Spark sorts the records by (anchor, suffix): a suffix array of the anchors in pieces,
   each complete for its anchors. A scan adds the common prefixes of neighbours and a
   stack yields the intervals of the common-prefix tree. In an interval, a second such
   tree over the reversed left contexts tests left extensions: each of its nodes of at
   least the length, not all from one child interval, is a maximal repeat within the
   records, given with all its occurrences.
5. Spans of all but an occurrence's first are merged by document and cut out.

Defined cases: null text is empty; texts shorter than ``length`` keep all; repeated rows
(same doc_id and text) count as one document and get one result row each; rows that
share a doc_id but not the text are documents of their own, in the order of a hash of the
text; a null doc_id comes before all others; a text of any length is worked on in blocks;
further columns are ignored. Hash clashes only add work: repeats are compared
byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm.common import documents, partitions, store

LENGTH, GRAM = 100, 24
STARTS = 1 << 18   # window starts that are worked on at once
RECORDS = 20_000   # records that are held at once
INVERSE = pow(int(K.BASE), -1, 1 << 64)


class Spans:
    """Hashes of byte spans."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(K.BYTE[data] * K.powers(n), out=self.total[1:])
        back = np.full(n + 1, INVERSE, np.uint64)
        back[0] = 1
        self.back = np.multiply.accumulate(back)

    def grams(self, gram: int) -> np.ndarray:
        """Of the ``gram`` bytes at every place."""
        m = max(0, len(self.total) - gram)
        return K.mix((self.total[gram:] - self.total[:m]) * self.back[:m])

    def of(self, start, end) -> np.ndarray:
        return K.mix((self.total[end] - self.total[start]) * self.back[start])


def window_least(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value of each window of ``w`` values."""
    n = len(h)
    rows = -(-n // w) + 1
    full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = h
    place = np.arange(rows * w).reshape(rows, w)
    full = full.reshape(rows, w)
    pre = np.minimum.accumulate(full, axis=1)
    fresh = np.ones_like(full, bool)
    fresh[:, 1:] = full[:, 1:] < pre[:, :-1]
    pre_at = np.maximum.accumulate(np.where(fresh, place, 0), axis=1).reshape(-1)
    back = full[:, ::-1]
    suf = np.minimum.accumulate(back, axis=1)
    fresh = np.ones_like(full, bool)
    fresh[:, 1:] = back[:, 1:] <= suf[:, :-1]
    suf_at = np.minimum.accumulate(np.where(fresh, place[:, ::-1], rows * w), axis=1)[:, ::-1].reshape(-1)
    pre, suf = pre.reshape(-1), suf[:, ::-1].reshape(-1)
    s = np.arange(max(0, n - w + 1))
    return np.where(suf[s] <= pre[s + w - 1], suf_at[s], pre_at[s + w - 1])


def anchors(data: np.ndarray, off: np.ndarray, length: int, gram: int):
    """(hash, document, place, first start, last start, prints of the right and left context,
    0 for none) of the anchors; places in ``data``. Windows go by blocks of starts, so that the
    temporaries are those of a block; an anchor of windows in two blocks comes twice, each time
    with its own."""
    found = [_anchors(data[x:x + STARTS + length - 1], x, off, length, gram) for x in range(0, max(1, len(data) - length + 1), STARTS)]
    return tuple(np.concatenate(c) for c in zip(*found))


def _anchors(data: np.ndarray, base: int, off: np.ndarray, length: int, gram: int):
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.uint64), none, none, none, none, none, none
    spans = Spans(data)
    h = spans.grams(gram)
    at = window_least(h, length - gram + 1)
    start = np.arange(len(at))
    doc = np.searchsorted(off, start + base, "right") - 1
    ok = start + base + length <= off[doc + 1]
    start, at, doc = start[ok], at[ok], doc[ok]
    head = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])))) if len(at) else none
    last = np.append(head[1:], len(at))[:len(head)] - 1
    at, doc, s1, s2 = at[head], doc[head], start[head], start[last]
    half = (length - gram) // 2
    prints = []
    for a, b, ok in ((at, at + gram + half, s2 + length >= at + gram + half), (at - half, at + gram, s1 <= at - half)):
        v = np.zeros(len(at), np.int64)
        v[ok] = 1 + (spans.of(a[ok], b[ok]) % np.uint64(65535)).astype(np.int64)
        prints.append(v)
    return h[at], doc, at + base, s1 + base, s2 + base, *prints


ASKS, TOLD, SENT = 0, 1, 2  # not repeated here; stands for those sent; known to be repeated


def shared(a: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Which rows share their anchor and one of their prints with another row."""
    out = np.zeros(len(a), bool)
    for p in (prints >> 16, prints & 65535):
        key = K.mix(a.view(np.uint64)) + p.astype(np.uint64)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        out |= (count[inverse] > 1) & (p > 0)
    return out


def _anchor_rows(length: int, gram: int):
    def run(batches):
        for b in K.slices(batches):
            data, off = K.buffer(b.column("text"))
            h, doc, at, _, _, right, left = anchors(data, off, length, gram)
            # half of the hash will do to bring anchors together: a clash has to hit a print, too, and only adds work
            a, prints, names = (h >> np.uint64(32)).astype(np.int64), (right << 16) | left, b.column("d").to_numpy()
            sent = shared(a, prints)
            many = np.flatnonzero(sent)
            _, first = np.unique(K.mix(h[many]) ^ prints[many].astype(np.uint64), return_index=True)
            rep = many[first]
            place = at - off[doc]
            kind = (prints << 2) | np.where(sent, SENT, ASKS)
            cols = ((a, a[rep]), (names[doc], names[doc[rep]]), (place, place[rep]), (kind, (prints[rep] << 2) | TOLD))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], ["a", "d", "at", "kind"])
    return run


def _repeated(batches):
    """Rows that were sent, and rows that ask and share a print with another row of their
    anchor; those come sorted by anchor."""
    held = None
    for b in batches:
        cols = [b.column(k).to_numpy() for k in ("a", "d", "at", "kind")]
        sent = cols[3] & 3 == SENT
        if sent.any():
            yield _occurrences(*(c[sent] for c in cols[1:3]))
        cols = [c[~sent] for c in cols]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        # the last anchor waits for the rest of its rows
        done = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
        held = [c[done:] for c in cols]
        yield _asked([c[:done] for c in cols])
    if held is not None:
        yield _asked(held)


def _asked(cols):
    a, d, at, kind = cols
    keep = shared(a, kind >> 2) & (kind & 3 == ASKS)
    return _occurrences(d[keep], at[keep])


def _occurrences(d, at):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, at)], ["d", "at"])


def _records(length: int, gram: int):
    """Records (a, suffix, left, d, at) and, with an empty suffix, spans (d, at .. a). Anchors
    are worked out anew, as that costs less than carrying them along."""
    def run(batches):
        for b in K.slices(batches):
            data, off = K.buffer(b.column("text"))
            raw, names = data.tobytes(), b.column("d").to_numpy()
            h, doc, at, s1, s2, _, _ = anchors(data, off, length, gram)
            lists = b.column("places")
            wanted = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            go = np.flatnonzero(np.isin((doc << 40) | (at - off[doc]), (owner << 40) | wanted))
            for piece in range(0, len(go), RECORDS):
                yield _distinct(raw, *(x[go[piece:piece + RECORDS]] for x in (h.view(np.int64), names[doc], at, off[doc], s1, s2 + length)))
    return run


def _distinct(raw: bytes, anchor, name, at, base, first, end) -> pa.RecordBatch:
    """Records of anchors, equal ones once; the later ones are spans already."""
    found: dict = {}
    spans = set()
    for a, d, y, o, x, z in zip(*(c.tolist() for c in (anchor, name, at, base, first, end))):
        key, own = (a, raw[y:z], raw[x:y]), (d, y - o)
        old = found.setdefault(key, own)
        if old != own:
            late = max(old, own)
            found[key] = min(old, own)
            spans.add((late[0], late[1] - (y - x), late[1] + z - y))
    rows = [(a, s, x, d, p) for (a, s, x), (d, p) in found.items()]
    rows += [(e, b"", b"", d, s) for d, s, e in spans]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], ["a", "suffix", "left", "d", "at"])


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if x[lo:mid] == y[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def intervals(lcp: list[int]):
    """(common prefix, first, last, whether all come from one child) of the tree's inner
    nodes; lcp[i] is that of entries i and i + 1. Children come before their parents."""
    stack: list[tuple[int, int]] = []  # (value, first)
    for i, v in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > v:
            value, first = stack.pop()
            yield value, first, i
        if v >= 0 and (not stack or stack[-1][0] < v):
            stack.append((v, first))


def maximal_repeats(records: list, length: int):
    """Maximal repeats of one anchor: (left extension, right extension, record numbers).
    records: (suffix, left, document, place), sorted by suffix."""
    m = len(records)
    lcp = [common(records[i][0], records[i + 1][0]) for i in range(m - 1)]
    back = [r[1][::-1] for r in records]
    for right, lo, hi in intervals(lcp):
        need = length - right
        inside = sorted((i for i in range(lo, hi + 1) if len(back[i]) >= need), key=lambda i: back[i])
        if len(inside) < 2:
            continue
        lefts = [common(back[x], back[y]) for x, y in zip(inside, inside[1:])]
        child, at = {}, 0  # number of the child interval (or leaf) that each record is in
        for i in range(lo, hi + 1):
            child[i] = at
            at += i < hi and lcp[i] == right
        for left, a, b in intervals(lefts):
            if left >= need:
                members = inside[a:b + 1]
                if any(child[i] != child[members[0]] for i in members):
                    yield left, right, members


def _spans(length: int):
    def run(batches):
        for out in _by_anchor(batches):
            d, s, e = [], [], []
            for kind, rows in out:
                if kind:
                    for x in rows:
                        d.append(x[3]), s.append(x[4]), e.append(x[0])
                    continue
                records = [(suffix, left, name, at) for _, suffix, left, name, at in rows]
                for left, right, members in maximal_repeats(records, length):
                    first = min((records[i][2], records[i][3]) for i in members)
                    for i in members:
                        name, at = records[i][2:]
                        if (name, at) != first:
                            d.append(name), s.append(at - left), e.append(at + right)
            code = (np.array(s, np.int64) << BITS) | (np.array(e, np.int64) - np.array(s, np.int64))
            d, code = np.unique(np.stack((np.array(d, np.int64), code)), axis=1) if len(s) else (code, code)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(code)], ["d", "span"])
    return run


def _by_anchor(batches):
    """Lists of (True, spans) and (False, the records of an anchor), one list a batch."""
    rows = []
    for b in batches:
        out, spans = [], []
        for x in zip(*(b.column(k).to_pylist() for k in ("a", "suffix", "left", "d", "at"))):
            if not x[1]:
                spans.append(x)
                continue
            if rows and rows[0][0] != x[0]:
                if len(rows) > 1:
                    out.append((False, rows))
                rows = []
            rows.append(x)
        if spans:
            out.append((True, spans))
        yield out
    if len(rows) > 1:
        yield [(False, rows)]


BITS = 24  # of a span's length in its code


def merged(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(batches):
    for b in K.slices(batches):
        data, off = K.buffer(b.column("text"))
        raw = data.tobytes()
        rows = []
        for i, spans in enumerate(b.column("spans").to_pylist()):
            text = raw[off[i]:off[i + 1]]
            gone = [(s, min(e, len(text))) for s, e in merged((x >> BITS, (x >> BITS) + (x & ((1 << BITS) - 1))) for x in spans or ()) if s < len(text)]
            kept, at = [], 0
            for s, e in gone:
                kept.append(text[at:s])
                at = e
            kept = b"".join([*kept, text[at:]])
            rows.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
        kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds))],
                                         ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def repeat_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans to remove as (d, start << BITS | length), in bytes; docs: (d, text) with d the document's
    number, in the order of the documents."""
    n = partitions(docs.sparkSession)
    rows = docs.select("d", "text").mapInArrow(_anchor_rows(length, gram), "a long, d long, at long, kind long")
    salt = F.when(F.col("kind").bitwiseAND(3) == SENT, F.col("d")).otherwise(F.lit(0))
    seen = (rows.repartition(n, "a", salt).sortWithinPartitions("a")
            .mapInArrow(_repeated, "d long, at long"))
    places = seen.groupBy("d").agg(F.collect_list("at").alias("places"))  # of one document
    records = docs.join(places, "d").select("d", "text", "places").mapInArrow(_records(length, gram), "a long, suffix binary, left binary, d long, at long")
    spread = F.when(F.length("suffix") > 0, F.lit(0)).otherwise(F.col("d"))
    return records.repartition(n, "a", spread).sortWithinPartitions("a", "suffix").mapInArrow(_spans(length), "d long, span long")


def numbered(docs: DataFrame):
    """(d, text) with a number d of each document, in the order of the ids, and (d, doc_id) or None: ids that
    are unique are their own numbers; else rows are numbered by (doc_id, hash of the text), nulls first."""
    own = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    n = own.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("d").alias("ids")).first()
    if n["rows"] == n["ids"]:  # never null, and known to be: so both joins read one exchange of the texts
        return own.select(F.coalesce("d", F.lit(0)).alias("d"), "text"), None
    own = own.select("text", F.struct(F.col("d").isNotNull().alias("named"), F.coalesce("d", F.lit(0)).alias("id"), F.xxhash64("text").alias("h")).alias("id"))
    order = store(own.select("id").distinct().repartitionByRange(partitions(docs.sparkSession), "id").sortWithinPartitions("id")
                  .select("id", F.monotonically_increasing_id().alias("d")), "numbers")
    return own.join(order, "id").select("d", "text"), order.select("d", F.when(F.col("id.named"), F.col("id.id")).alias("doc_id"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes) of every row."""
    own, names = numbered(docs)
    spans = repeat_spans(own, length, gram).groupBy("d").agg(F.collect_list("span").alias("spans"))
    out = own.join(spans, "d", "left").select(F.col("d").alias("doc_id"), "text", "spans").mapInArrow(  # the texts' exchange serves both joins
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    if names is None:
        return out
    return out.withColumnRenamed("doc_id", "d").join(names, "d").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op6_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
