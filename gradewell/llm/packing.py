"""Hierarchical best-fit packing of documents into token sequences (operator 7).

Documents longer than a sequence are cut into pieces of ``size`` tokens, the first
being shorter; whole pieces are sequences already. The other pieces are dealt by hash
into groups of about ``group_items``; each group packs best-fit, longest first, emits
the bins that are nearly full and hands the rest up. ``fan`` groups meet in the next
round, where underfull bins are the items, until one group is left. A group hands up
at most ``carry`` bins, the emptiest; the others are final as they stand, so no task
ever takes more than fan * carry bins.

Only (doc_id, piece, start, length, crc32) of a piece travels; rounds are written to
the shared folder. ``sequences`` joins the ids back where they are wanted.

Defined cases: null or empty text is the end id alone; no rows give no pieces; repeated
rows are packed as often as they occur; a null doc_id is packed like any other;
further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm import tokens as T
from gradewell.llm.common import documents, store

SIZE = 2048
SLICE = 1 << 20  # bytes of texts that are encoded at a time
GROUP_ITEMS = 1 << 16
FAN = 8
CARRY = 1 << 13
FULL = 0.98

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, fill long, open boolean, grp long"


def _cut(doc_ids: list, ids: np.ndarray, off: np.ndarray, size: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces of the documents ``doc_ids``, whose ids stand between the offsets."""
    rows = []
    for name, a, e in zip(doc_ids, off[:-1].tolist(), off[1:].tolist()):
        own = np.append(ids[a:e], 0).astype("<u4")
        first = len(own) % size or size
        cuts = [0, *range(first, len(own), size), len(own)]
        for k, (s, t) in enumerate(zip(cuts, cuts[1:])):
            raw = own[s:t].tobytes()
            rows.append((name, k, s, t - s, zlib.crc32(raw), *[raw] * with_ids))
    n = 5 + with_ids
    cols = list(zip(*rows)) or [()] * n
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[:n])


def _pieces(path: str, size: int, with_ids: bool):
    def run(batches):
        enc = T.encoder(path)
        for b in K.slices(batches, SLICE):
            # no ids are held between slices, so that all but what the encoder knows is freed when they end
            yield _cut(b.column("doc_id").to_pylist(), *enc.encode(b.column("text")), size, with_ids)
    return run


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids, with the ids themselves (little-endian u32) if wanted."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(path or T.default_path(), size, with_ids), PIECES + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, size: int):
    """(bin of each item, offset there, fill of each bin); longest items first, each to the
    bin with the least room that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    have = 0  # bit r: a bin with room r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fit = have >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                have &= ~(1 << room)
        else:
            b, room = len(fill), size
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        rooms[room - n].append(b)
        have |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def _pack(level: int, size: int, full: float, carry: int, last: bool):
    """One round over groups; a group's rows come together."""
    def pack(rows: dict, grp: int):
        seq, at = np.unique(rows["sequence_id"], return_inverse=True)
        lengths = np.zeros(len(seq), np.int64)
        lengths[at] = rows["fill"]
        bins, offsets, fill = best_fit(lengths, size)
        low = np.flatnonzero(fill < full * size)
        is_open = np.zeros(len(fill), bool)
        if not last:
            is_open[low[np.argsort(fill[low], kind="stable")][:carry]] = True
        b = bins[at]
        out = [*(rows[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")),
               pa.array((level << 56) + (grp << 28) + b), pa.array(rows["offset"] + offsets[at]), pa.array(fill[b]),
               pa.array(is_open[b]), pa.array(np.full(len(b), grp // FAN))]
        return pa.RecordBatch.from_arrays(out, [x.split()[0] for x in PLACED.split(", ")])

    def run(batches):
        held, key = [], None
        for b in batches:
            groups = b.column("grp").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for s, e in zip(cut, cut[1:]):
                if s == e:
                    continue
                if held and groups[s] != key:
                    yield pack(_together(held), key)
                    held = []
                key = int(groups[s])
                held.append(b.slice(s, e - s))
        if held:
            yield pack(_together(held), key)
    return run


def _together(held):
    t = pa.Table.from_batches(held).combine_chunks()
    numbers = ("sequence_id", "offset", "fill")
    return {k: t[k].to_numpy() if k in numbers else t[k].chunk(0) for k in t.column_names}


def pack(parts: DataFrame, size: int = SIZE, group_items: int = GROUP_ITEMS, fan: int = FAN, carry: int = CARRY,
         full: float = FULL) -> DataFrame:
    """Pieces with sequence_id and offset."""
    assert fan == FAN
    whole = parts.where(F.col("length") >= size).withColumn("sequence_id", F.lit(127 << 56) + F.monotonically_increasing_id())
    done = [whole.withColumn("offset", F.lit(0).cast("long"))]
    rest = parts.where(F.col("length") < size)
    groups = max(1, -(-rest.count() // group_items))
    item = F.monotonically_increasing_id()
    todo = rest.select("*", item.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill"),
                       F.lit(True).alias("open"), F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)).alias("grp"))
    level = 0
    while True:
        level += 1
        last = groups == 1
        dealt = todo.repartition(groups, "grp").sortWithinPartitions("grp", "doc_id", "piece", "sequence_id")
        todo = store(dealt.mapInArrow(_pack(level, size, full, carry, last), PLACED), f"pack{level}")
        done.append(todo.where("NOT open"))
        todo = todo.where("open")
        if last:
            break
        groups = -(-groups // fan)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = done[0].select(*cols)
    for d in done[1:]:
        out = out.unionAll(d.select(*cols))
    return out


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    return pack(store(pieces(docs, path, size), "pieces"), size)


def sequences(docs: DataFrame, packed: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """sequence_id, ids (little-endian u32): the packed sequences themselves, for documents
    with distinct non-null ids. A sequence gathers at most ``size`` tokens."""
    own = pieces(docs, path, size, with_ids=True).select("doc_id", "piece", "ids")
    parts = packed.join(own, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op7_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
