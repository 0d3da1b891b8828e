"""Spans that the encoder remembers stand in two sorted arrays, and give the ids of whole texts."""

import numpy as np
import pyarrow as pa

from gradewell.llm import tokens as T


def test_remembered_spans(monkeypatch):
    enc = T.Encoder(T.default_path())
    texts = [f"word{i} of{i % 7}, and\n\nmore {'é' * (i % 5)} x{i * i}" for i in range(400)]
    for known in (1_000_000, 50):  # all remembered; forgotten between batches
        monkeypatch.setattr(T, "KNOWN", known)
        enc._clear()
        for a in (0, 100, 50, 300):
            part = texts[a:a + 100]
            ids, off = enc.encode(pa.array(part))
            assert [ids[x:y].tolist() for x, y in zip(off[:-1], off[1:])] == [enc.whole(t) for t in part]
            assert len(enc.known) == len(enc.slot) == len(enc.offset) - 1 and (np.diff(enc.known.astype(object)) > 0).all()
            assert enc.known.nbytes + enc.slot.nbytes == 12 * len(enc.known)
