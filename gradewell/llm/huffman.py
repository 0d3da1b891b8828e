"""Token ids in canonical length-limited Huffman code (operator 5).

File format, one block after another (Parquet is only the container, so that any
store Spark reads will do): a block holds whole documents in ascending doc_id order,

    magic "GWHF", version u16 (2), interval u16, documents u32, tokens u64, checkpoints u32
    tokens of each document, u32 each
    bit offset of every interval-th token, u64 each
    code bits, padded by 4 bytes

with little-endian numbers. Block -1 holds the code length of each id, one byte each;
a canonical code needs no more. Every block decodes alone, and within a block every
checkpoint: a decoder runs all checkpoints of a block side by side, one table look-up
a token.

Job: rows are range-partitioned and sorted by doc_id (equal ids by a hash of the text, so that
many rows of one id are several ranges), tokenised once and kept as
blocks of ids in the shared folder; ids are counted (at most the vocabulary reaches
the driver), code lengths come from package-merge, blocks are coded and written, and
read back for the result.

Defined cases: null or empty text is the end id alone; no rows give no blocks and no
result; repeated rows and rows that share a doc_id follow each other by a hash of the
text; a null doc_id sorts first; a text of any length stays in one block; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm import tokens as T
from gradewell.llm.common import documents, partitions, store

LONGEST = 18          # bits of the longest code
INTERVAL = 256        # tokens from checkpoint to checkpoint
BLOCK_TOKENS = 1 << 19
HEAD = np.dtype([("magic", "S4"), ("version", "<u2"), ("interval", "<u2"), ("docs", "<u4"), ("tokens", "<u8"), ("points", "<u4")])


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code length of each id by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        out[used] = 1
    if len(used) < 2:
        return out
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids don't fit codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(object) if counts.sum() > 2**62 else counts[order].astype(np.int64)
    n = len(order)
    # Level by level: leaves merged with the pairs of the level before. What counts in the
    # end is how many of the cheapest 2n - 2 entries are leaves, and so on downwards.
    is_leaf = []
    pairs = leaf[:0]
    for _ in range(longest):
        weights = np.concatenate((leaf, pairs))
        rank = np.argsort(weights, kind="stable")
        is_leaf.append(rank < n)
        weights = weights[rank]
        m = len(weights) // 2
        pairs = weights[0:2 * m:2] + weights[1:2 * m:2]
    take = 2 * n - 2
    length = np.zeros(n, np.int64)
    for level in reversed(is_leaf):
        leaves = int(level[:take].sum())
        length[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: shorter codes first, equal lengths by id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        ln = lengths[order].astype(np.int64)
        top = int(ln[-1])
        step = np.left_shift(np.int64(1), top - ln)
        codes[order] = np.concatenate(([0], np.cumsum(step)[:-1])) >> (top - ln)
    return codes


def decode_table(lengths: np.ndarray):
    """(id << 5 | code length of every window of the longest code's bits, and that length)."""
    top = int(lengths.max()) if len(lengths) else 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = np.left_shift(np.int64(1), top - lengths[order].astype(np.int64))
    entry = np.ones(1 << top, np.uint32)
    used = int(span.sum())
    entry[:used] = np.repeat((order << 5) | lengths[order], span)
    return entry, top


def encode_block(ids: np.ndarray, docs: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """ids of whole documents of ``docs`` tokens each, as one block."""
    ln = lengths[ids].astype(np.int64)
    if len(ids) and not ln.min():
        raise ValueError("an id has no code")
    end = np.cumsum(ln)
    start = end - ln
    total = int(end[-1]) if len(ids) else 0
    head = np.array([(b"GWHF", 2, INTERVAL, len(docs), len(ids), len(range(0, len(ids), INTERVAL)))], HEAD)
    return b"".join((head.tobytes(), docs.astype("<u4").tobytes(), start[::INTERVAL].astype("<u8").tobytes(),
                     packed(codes[ids].astype(np.uint64), start, ln)[:(total + 7) // 8], bytes(4)))


def packed(codes: np.ndarray, start: np.ndarray, ln: np.ndarray) -> bytes:
    """Codes that follow each other without gaps, as bits in words of 64."""
    if not len(codes):
        return b""
    word = start >> 6
    room = 64 - (start & 63) - ln  # bits left of the code's word; negative: that many belong to the next
    head = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))  # a word has a code's start, as no code fills one
    over = np.flatnonzero(room < 0)
    own = codes << np.maximum(room, 0).astype(np.uint64)
    own[over] = codes[over] >> (-room[over]).astype(np.uint64)
    words = np.append(np.add.reduceat(own, head), np.uint64(0))
    words[word[over] + 1] |= codes[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()


def decode_block(raw: bytes, table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens of each document) of a block."""
    head = np.frombuffer(raw, HEAD, 1)[0]
    if head["magic"] != b"GWHF" or head["version"] != 2:
        raise ValueError("not a block of this format")
    at, n, step = HEAD.itemsize, int(head["tokens"]), int(head["interval"])
    docs = np.frombuffer(raw, "<u4", int(head["docs"]), at)
    pos = np.frombuffer(raw, "<u8", int(head["points"]), at + 4 * len(docs)).astype(np.int64)
    data = np.frombuffer(raw, np.uint8, offset=at + 4 * len(docs) + 8 * len(pos)).astype(np.uint32)
    entry, top = table
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]  # the 32 bits from each byte on
    out = np.zeros((step, len(pos)), np.uint32)
    mask, last, shift = np.uint32((1 << top) - 1), len(window) - 1, 32 - top
    for k in range(min(step, n)):
        w = window[np.minimum(pos >> 3, last)] >> (shift - (pos & 7)).astype(np.uint32)
        found = entry[w & mask]
        out[k] = found
        pos += found & 31
    return (out.T.reshape(-1)[:n] >> 5), docs


def _tokenise(path: str, block_tokens: int):
    """Blocks of ids of a sorted partition."""
    def run(batches):
        enc, part = T.encoder(path), TaskContext.get().partitionId()
        at, held, size = 0, [], 0

        def block():
            ids, docs, names = (np.concatenate([h[k] for h in held]) for k in range(3))
            keys = pa.array(names[:, 0], pa.int64(), mask=names[:, 1] == 1)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([at], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                 pa.array([docs.astype("<u4").tobytes()], pa.binary()), pa.array([ids.astype("<u4" if ids.max() > 65535 else "<u2").tobytes()], pa.binary()),
                 pa.array([len(ids)], pa.int64())], ["part", "at", "doc_ids", "docs", "ids", "n"])
        for b in K.slices(batches, T.BATCH):
            ids, off = enc.encode(b.column("text"))
            count = np.diff(off)
            ends = off[1:] + np.arange(len(count))
            full = np.zeros(len(ids) + len(count), np.uint32)  # with the end id 0 after each
            full[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
            name = np.stack((b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False)), 1).astype(np.int64)
            a, start = 0, 0
            for i, e in enumerate(ends.tolist()):
                if size + e + 1 - start >= block_tokens or i == len(ends) - 1:
                    held.append((full[start:e + 1], count[a:i + 1] + 1, name[a:i + 1]))
                    size += e + 1 - start
                    a, start = i + 1, e + 1
                    if size >= block_tokens:
                        yield block()
                        at += size
                        held, size = [], 0
        if held:
            yield block()
    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _count(batches):
    total = np.zeros(0, np.int64)
    for b in batches:
        for raw, n in zip(b.column("ids").to_pylist(), b.column("n").to_pylist()):
            c = np.bincount(_ids(raw, n))
            if len(c) > len(total):
                total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
            total[:len(c)] += c
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "c"])


def _encode(lengths: np.ndarray):
    codes = canonical(lengths)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {k: b.column(k)[i].as_py() for k in ("docs", "ids", "n")}
                raw = encode_block(_ids(r["ids"], r["n"]), np.frombuffer(r["docs"], "<u4"), lengths, codes)
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(i, 1) for k in ("part", "at", "doc_ids")), pa.array([raw], pa.binary())],
                                                 ["part", "at", "doc_ids", "block"])
    return run


def write(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``docs`` in the file format; returns the written blocks (part, at, doc_ids, block).
    A block's place: its partition in doc_id order, and the ids of that partition before it."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    key = ["doc_id", "h", "row"]
    rows = rows.repartitionByRange(partitions(spark), *key).sortWithinPartitions(*key).select("doc_id", "text")
    ids = store(rows.mapInArrow(_tokenise(path or T.default_path(), block_tokens),
                                "part long, at long, doc_ids array<long>, docs binary, ids binary, n long"), "ids")
    found = ids.select("ids", "n").mapInArrow(_count, "id long, c long").groupBy("id").agg(F.sum("c").alias("c")).collect()
    counts = np.zeros(max((r[0] for r in found), default=-1) + 1, np.int64)
    for r in found:  # at most one row for each id of the vocabulary
        counts[r[0]] = r[1]
    lengths = code_lengths(counts)
    blocks = ids.select("part", "at", "doc_ids", "docs", "ids", "n").mapInArrow(
        _encode(lengths), "part long, at long, doc_ids array<long>, block binary")
    head = spark.createDataFrame([(-1, 0, [], bytearray(lengths.tobytes()))], blocks.schema)
    return store(blocks.unionAll(head.coalesce(1)), "huffman")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian u32) of written blocks."""
    spark = blocks.sparkSession
    lengths = np.frombuffer(blocks.where("part < 0").select("block").first()[0], np.uint8)
    own = blocks.where("part >= 0")
    tail = F.max(F.struct("at", F.substring("block", 1, HEAD.itemsize).alias("head")))
    ends = own.groupBy("part").agg(tail.alias("t")).collect()  # one row for each partition
    before, total = {}, 0
    for r in sorted(ends):
        before[r["part"]] = total
        total += r["t"]["at"] + int(np.frombuffer(bytes(r["t"]["head"]), HEAD, 1)[0]["tokens"])
    known = spark.sparkContext.broadcast((decode_table(lengths), before))

    def run(batches):
        table, first = known.value
        for b in batches:
            for part, at, names, raw in zip(*(b.column(k).to_pylist() for k in ("part", "at", "doc_ids", "block"))):
                ids, docs = decode_block(raw, table)
                end = np.cumsum(docs, dtype=np.int64)
                off = np.concatenate(([0], end)) * 4
                data = pa.BinaryArray.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first[part] + at + end - docs, pa.int64()), data],
                                                 ["doc_id", "start", "ids"])
    return own.mapInArrow(run, "doc_id long, start long, ids binary")


def op5_canonical_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read(write(documents(spark, sf_dir)))
    return back.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
