"""Python workers stand beside the executor's JVM: what a task takes is bounded, and freed memory goes back when it ends."""

import ctypes
import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gradewell.llm import kernels as K
from gradewell.llm import packing
from gradewell.llm import tokens as T


def held() -> float:
    """MB of this process without mapped files."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def batch(n_bytes: int, words: int) -> pa.RecordBatch:
    r = random.Random(words)
    known = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(3, 9))) for _ in range(words)]
    texts = [" ".join(r.choice(known) for _ in range(400)) for _ in range(n_bytes // 2800)]
    return pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists() or not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="Linux with glibc")
def test_freed_memory_goes_back():
    own = batch(16 << 20, 100_000)
    n = sum(b.num_rows for b in packing._pieces(T.default_path(), 2048, False)(iter([own])))
    at_end = held()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    assert n == own.num_rows and at_end - held() < 16


def test_encoding_takes_a_bounded_multiple_of_the_text():
    column = batch(4 << 20, 2000).column("text")
    enc = T.encoder(T.default_path())
    enc.encode(column)  # the spans are known now
    tracemalloc.start()
    enc.encode(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * K.buffer(column)[0].nbytes


def test_hashes_by_blocks(monkeypatch):
    data, off = K.buffer(pa.array(["one two  three", "", "x" * 90 + " four", "five " * 30]))
    start, end = K.bounds(data, off)
    whole = K.span_hash(data, start, end, True)
    for size in (1, 7, 64, 1 << 19):
        monkeypatch.setattr(K, "HASHED", size)
        assert (K.hashes(data, start, end, True) == whole).all()
        assert (K.words(data, off)[2] == whole).all()
    assert len(K.hashes(data[:0], start[:0], end[:0], True)) == 0


def test_pieces_do_not_depend_on_slices(monkeypatch):
    own = batch(1 << 20, 500)
    rows = []
    for size in (1 << 20, 10_000):
        monkeypatch.setattr(packing, "SLICE", size)
        got = pa.Table.from_batches(list(packing._pieces(T.default_path(), 256, True)(iter([own]))))
        rows.append(got.to_pylist())
        assert np.frombuffer(rows[-1][0]["ids"], "<u4").size == rows[-1][0]["length"]
    assert rows[0] == rows[1]
