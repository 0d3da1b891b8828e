"""Vectorised parts against plain Python."""
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from gradewell.llm import decontaminate, huffman, jaccard, kernels, langid, lm, packing, pii, repeats, tokens, toxicity

from .conftest import prose


def test_words_and_ngrams():
    texts = ["The  cat\nsat on", None, "", "the Cat sat", "a b", "x", "\v\f\r"]
    data, off = kernels.buffer(pa.array(texts))
    s, e, h, woff = kernels.words(data, off)
    got = [[bytes(data[s[i]:e[i]]).decode() for i in range(a, b)] for a, b in zip(woff, woff[1:])]
    assert got == [(t or "").split() for t in texts]
    assert h[woff[0]:woff[1]][:3].tolist() == h[woff[3]:woff[4]].tolist()
    assert int(h[0]) == kernels.word_hash("the")
    v, goff = kernels.ngrams(h, woff, 3)
    assert np.diff(goff).tolist() == [2, 0, 0, 1, 1, 1, 0]
    assert v[0] == v[goff[3]] and len(set(v.tolist())) == 4


def test_words_survive_blocks(monkeypatch):
    text = prose(9, 400)
    data, off = kernels.buffer(pa.array([text, text]))
    one = kernels.words(data, off)
    monkeypatch.setattr(kernels, "BLOCK", 50)
    two = kernels.words(data, off)
    assert all((a == b).all() for a, b in zip(one, two))


def test_token_ids_equal_whole_texts():
    r, enc = random.Random(3), tokens.Encoder(tokens.default_path())
    alphabet = ["a", "b ", " ", "  ", "\n", "\n\n", " \n", "\t", "the", "'s", "é", " 12", ".", " ", "　", "漢字", "😀", "\r\n",
                "<|endoftext|>", "​", "\x1c", "\x85", "\0"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, "", " ", prose(1, 300)]
    for _ in range(2):  # new and known spans
        ids, off = enc.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[off[i]:off[i + 1]].tolist() == enc.whole(t or ""), t


@pytest.mark.parametrize("n,longest", [(1, 18), (2, 18), (5, 3), (300, 10), (5000, 18)])
def test_huffman_round_trip(n, longest):
    rng = np.random.default_rng(n)
    counts = (rng.zipf(1.3, n) % 10**9 + 1).astype(np.int64)
    lengths = huffman.code_lengths(counts, longest)
    assert lengths.max() <= longest and (n == 1 or (2.0 ** -lengths.astype(float)).sum() == 1)
    for size in (0, 1, 255, 256, 3000):
        ids, docs = rng.integers(0, n, size), np.array([0, size // 3, size - size // 3])
        back, cut = huffman.decode_block(huffman.encode_block(ids, docs, lengths, huffman.canonical(lengths)), huffman.decode_table(lengths))
        assert (back == ids).all() and (cut == docs).all()


def test_huffman_is_optimal_when_free():
    import heapq
    counts = np.array([50, 1, 3, 9, 27, 2, 2, 8])
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert (counts * huffman.code_lengths(counts)).sum() == cost


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 100), (1, 10), (3000, 4000), (4000, 1 << 50), (3000, 1 << 64)):
        v = np.unique(rng.integers(0, min(u - 1, 2**63), n, dtype=np.uint64))
        ef = lm.ef_encode(v, u)
        q = np.concatenate((v, rng.integers(0, min(u - 1, 2**63), 500, dtype=np.uint64)))
        assert (lm.ef_find(ef, q) == np.where(np.isin(q, v), np.searchsorted(v, q), -1)).all()


def test_least_of_windows():
    h = np.random.default_rng(0).integers(0, 20, 500, dtype=np.uint64)
    for w in (1, 7, 77):
        assert (repeats.window_least(h, w) == [i + int(np.argmin(h[i:i + w])) for i in range(500 - w + 1)]).all()


def test_maximal_repeats_cover_all_windows():
    """Per anchor: a window that two records share lies in a repeat that holds both."""
    r = random.Random(5)
    for _ in range(300):
        length, records = 8, []
        for i in range(r.randint(2, 7)):
            left, right = ("".join(r.choice("ab") for _ in range(n)).encode() for n in (r.randint(0, 5), r.randint(0, 5)))
            records.append((b"zzz" + right, left, i, 10))
        records.sort()
        found = list(repeats.maximal_repeats(records, length))
        for x in range(len(records)):
            for y in range(x):
                right = repeats.common(records[x][0], records[y][0])
                left = repeats.common(records[x][1][::-1], records[y][1][::-1])
                if left + right >= length:
                    assert any(a >= left and b >= right or (a, b) == (left, right) for a, b, m in found if x in m and y in m)
        for left, right, members in found:
            strings = {records[i][1][len(records[i][1]) - left:] + records[i][0][:right] for i in members}
            assert len(strings) == 1 and len(strings.pop()) >= length


def test_trie_links_find_all_components():
    rng = np.random.default_rng(2)
    for percent in (50, 80, 90):
        sets = []
        for _ in range(12):
            base = np.unique(rng.integers(0, 10**6, 40, dtype=np.uint64))
            for _ in range(4):
                keep = rng.random(len(base)) > rng.choice([0.0, 0.05, 0.15])
                sets.append(np.unique(np.concatenate(([np.uint64(0)], base[keep], rng.integers(0, 10**6, 2, dtype=np.uint64)))))
        links = {(a, b) for a, b in jaccard.trie_links(range(len(sets)), sets, percent)}
        parent = list(range(len(sets)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x
        comp = [parent.copy(), None]
        for a, b in links:
            parent[root(a)] = root(b)
        comp[1] = [root(i) for i in range(len(sets))]
        off = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        sketches = jaccard._sketches(np.concatenate(sets), off, percent).to_pylist()
        parts = [set(p.tolist()) for p in jaccard.screened([len(s) for s in sets], sketches, range(len(sets)), percent)]
        label, at = jaccard.screened_small(np.array([0]), np.array([len(sets)]), np.array([len(s) for s in sets]), sketches, np.arange(len(sets)), percent)
        assert {frozenset(at[label == x].tolist()) for x in label} == {frozenset(p) for p in parts}
        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                    assert comp[1][a] == comp[1][b] and any({a, b} <= p for p in parts)
        for a, b in links:
            i = len(np.intersect1d(sets[a], sets[b]))
            assert 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i)


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"\D", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_pii_equals_plain_patterns():
    r = random.Random(0)
    for _ in range(8000):
        t = "".join(r.choice("ab@@..1123 -+()%") for _ in range(r.randint(0, 40)))
        assert pii.detect(t) == base_spans(t), t


@pytest.mark.parametrize("text,found", [
    ("mail bob.s (at) mail [dot] example [dot] com now", "bob.s (at) mail [dot] example [dot] com"),
    ("write to bob at example dot com please", "bob at example dot com"),
    ("ring plus four nine one seven two five five five one two three", "plus four nine one seven two five five five one two three"),
    ("ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ ok", "ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("see bоb@examplе.com", "bоb@examplе.com"), ("ip one nine two dot one six eight dot one dot seven", "one nine two dot one six eight dot one dot seven"),
    ("look at the com boom, one two three", None), ("meet me at noon", None), ("plain a@b.co", None)])
def test_disguises(text, found):
    _, added = pii.spans(text)
    assert [text[a:b] for _, a, b in added] == ([found] if found else [])


def test_pii_is_linear():
    import time
    t0 = time.process_time()
    for t in ("1" * 200000, "a" * 200000, " " * 200000, "+1" + "(" * 100000, "one " * 30000, "@" * 100000, "[at]" * 30000):
        pii.spans(t)
    assert time.process_time() - t0 < 20


def test_edits_within_budget_are_found():
    r, p = random.Random(1), decontaminate.Params()
    bench = [(i, prose(100 + i, 20)) for i in range(20)]
    ix = decontaminate.Index(bench, p)
    for n in range(60):
        i, text = bench[n % 20]
        s = list(text)
        for _ in range(r.randint(0, 3)):
            x = r.randrange(len(s))
            s[x:x + 1] = r.choice([[], ["q"], [s[x], "q"]])
        doc = prose(500 + n, 50) + "\n" + "".join(s).upper() + "  " + prose(900 + n, 50)
        data, off = kernels.buffer(pa.array([prose(1, 5), doc]))
        data, _, off = decontaminate.fold(data, off)
        d, item, *_ = ix.search(data, off, p)
        assert (1, i) in set(zip(d.tolist(), item.tolist())) and set(item.tolist()) == {i} and set(d.tolist()) == {1}


def test_best_fit():
    r = np.random.default_rng(3)
    lengths = r.integers(1, 101, 500)
    bins, offsets, fill = packing.best_fit(lengths, 100)
    assert fill.max() <= 100 and fill.sum() == lengths.sum() and len(fill) <= 1.1 * -(-lengths.sum() // 100) + 1
    for b in range(len(fill)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]]


def test_noisy_or_learns_the_sentence():
    r = random.Random(0)
    texts, labels = [], []
    for i in range(400):
        s = [prose(1000 * i + k, 8) for k in range(r.randint(1, 6))]
        if i % 5 == 0:
            s[r.randrange(len(s))] += " rotten"
        texts.append(". ".join(s))
        labels.append(int(i % 5 == 0))
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(labels, pa.int32())], ["text", "y"])
    rows = [x for b in toxicity._features([batch]) for x in b.to_pylist()]
    model = toxicity.fit([(np.array(x["f"]), np.array(x["s"]), x["y"]) for x in rows])
    test = pa.array(["a fine day. you are rotten. good", "a fine day. good", "", None])
    f, first, soff, *_ = toxicity.bags(test)
    z = model.sentences(f, first)
    score = [-np.expm1(-toxicity.softplus(z[a:b]).sum()) for a, b in zip(soff, soff[1:])]
    assert score[0] > 0.5 > 0.2 > score[1] and score[2:] == [0, 0] and int(np.argmax(z[:3])) == 1


def test_language_grams_stay_within_texts():
    c, ok, zero = langid.letters(["Ab1", None, "", "\0x", "漢"])
    f, inside = langid.grams(c, 2)
    assert len(zero) == 6 and int(inside.sum()) == 2 + 1
    assert (np.add.reduceat(ok.astype(int), zero[:-1]) > 0).tolist() == [True, False, False, True, True]


def test_crc_of_ids_is_little_endian():
    assert zlib.crc32(np.array([1, 256], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\0\1\0\0")
