"""Clustering, WARC archives and collocations against plain Python."""
import base64
import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gradewell.llm import clustering, collocations, warc
from gradewell.session import scratch_path

from .conftest import CLASH, prose

# --- op11


def brute_clusters(rows, k, dim, scale, rounds, seed=1):
    whole = lambda v: int(v) * scale if abs(v) > 2**60 else math.floor(scale * v)
    kept = [(i, [whole(v) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    by = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), ",".join(map(str, r[1]))))
    cen = [x for _, x in by[:k]]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min(range(len(cen)), key=lambda c: (dist(x, cen[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[near(x)].append(x)
        cen = [[sum(v) // len(groups[c]) for v in zip(*groups[c])] if groups[c] else old for c, old in enumerate(cen)]
    out = [(i, near(x), dist(x, cen[near(x)])) for i, x in kept]
    cap = 2**63 - 1
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += min(d, cap)
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cen]
    return sorted(((i, c, min(d, cap), min(inertia[c], cap), min(sum(inertia.values()), cap), name[c]) for i, c, d in out), key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 0, "c", 1) for i, x in rows], "vec_id long, embedding array<double>, cluster int, distance string, h int")


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("centroid").collect()), key=str)


@pytest.mark.parametrize("spread", [1.0, 1e5, 1e9, 1e200])
def test_clusters_equal_brute_force(spark, spread):
    r = np.random.default_rng(int(math.log10(spread)))
    rows = [(i % 230, [float(v) for v in r.normal(0, spread, 6)]) for i in range(260)]
    rows += [(500 + i, list(rows[7][1])) for i in range(40)]  # repeated vectors
    rows += [(600, None), (601, [1.0]), (602, [1.0] * 5 + [None]), (603, [1.0] * 5 + [float("nan")]), (604, [float("inf")] * 6), (None, [0.5] * 6), (605, [])]
    got = rows_of(clustering.cluster(vectors(spark, rows), 5, 6, 64, 3))
    assert got == brute_clusters(rows, 5, 6, 64, 3)


def test_few_vectors(spark):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [4.0, 4.0])]
    assert rows_of(clustering.cluster(vectors(spark, rows), 9, 2)) == brute_clusters(rows, 9, 2, 64, 3)
    none = clustering.cluster(vectors(spark, [(1, None)]), 9, 2)
    assert none.count() == 0 and none.columns == clustering.cluster(vectors(spark, rows), 9, 2).columns


def test_zero_test_favours_the_smaller_number():
    model = clustering.Bisectors([[0, 0], [4, 0], [2, 2], [0, 0]])
    x = np.array([[2, 0], [2, -9], [0, 0], [4, 1]])
    assert model.nearest(x)[0].tolist() == [0, 0, 0, 1]


# --- op12


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "z") for r in rows], "page_id long, url string, html string, digest string, keeper int, file string")


PAGES = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (5, "http://a/5", "<p>one</p>"), (3, None, None), (4, "u\r\nX: y z", ""),
         (6, "", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nb\n"), (7, "http://ü/", "漢字 😀" * 3000), (None, "n", "<p>one</p>"), (None, "m", "lone"),
         (8, "same", "again"), (8, "same", "again")]


def expected(rows, least):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            top[h or ""] = max(i, top.get(h or "", i))
    out = []
    for i, _, h in rows:
        keep = top.get(h or "")
        revisit = keep is not None and keep != i
        out.append((i, len((h or "").encode()), digest(h), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,roll", [(0, 1 << 20), (8, 300)])
def test_archives(spark, least, roll):
    top = scratch_path(spark, f"test-warc-{os.urandom(6).hex()}")
    files = warc.write_archives(pages(spark, PAGES), f"{top}/one", least, roll)
    for r in files.collect():  # each is one gzip stream
        z = zlib.decompressobj(31)
        raw = z.decompress(open(f"{top}/one/{r.file}", "rb").read())
        assert z.eof and not z.unused_data and raw.count(b"WARC/1.1\r\nWARC-Type") == r.records
    members = warc.normalise(files, f"{top}/one", f"{top}/each")
    got = warc.read_archives(members, f"{top}/each").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == expected(PAGES, least)
    text = {(i, u): h for i, u, h in PAGES}
    for r in got:
        raw = open(f"{top}/each/{r.file}", "rb").read()[r.offset:r.offset + r.length]
        z = zlib.decompressobj(31)
        assert z.decompress(raw).startswith(b"WARC/1.1\r\n") and z.eof and not z.unused_data
        if r.record_type == "response" and r.page_id not in (4,):
            assert bytes(r.payload).decode() == (text[(r.page_id, r.url)] or "")
    ends = defaultdict(list)
    for r in got:
        ends[r.file].append((r.offset, r.offset + r.length))
    for file, spans in ends.items():  # members cover the file
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] == os.path.getsize(f"{top}/each/{file}")


def test_no_pages_and_damaged_archives(spark, tmp_path):
    top = scratch_path(spark, f"test-warc-{os.urandom(6).hex()}")
    files = warc.write_archives(pages(spark, PAGES).limit(0), f"{top}/one")
    assert warc.read_archives(warc.normalise(files, f"{top}/one", f"{top}/each"), f"{top}/each").count() == 0
    m = warc.Monolith(str(tmp_path))
    m.add(warc.record(1, "u", b"x" * 5000, None, False))
    name, _ = m.close()
    raw = (tmp_path / name).read_bytes()
    (tmp_path / "cut").write_bytes(raw[:-20])
    with open(tmp_path / "cut", "rb") as f, open(tmp_path / "out", "wb") as out, pytest.raises(ValueError, match="cut"):
        warc.normalise_file(f, out, "cut")


def test_archive_of_several_members(tmp_path):
    parts = [b"".join(warc.record(i, "u", str(i).encode() * 10, None, False)) for i in range(5)]
    raw = b"".join(parts)
    cuts = [0, 10, 400, 401, len(raw)]
    (tmp_path / "in").write_bytes(b"".join((z := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(raw[a:b]) + z.flush() for a, b in zip(cuts, cuts[1:])))
    with open(tmp_path / "in", "rb") as f, open(tmp_path / "out", "wb") as out:
        rows = warc.normalise_file(f, out, "in")
    done = (tmp_path / "out").read_bytes()
    assert [zlib.decompress(done[r[0]:r[0] + r[1]], 31) for r in rows] == parts


# --- op13


def brute_phrases(rows, least, longest, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang or "und"][tuple(w[i:i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((score, a, " ".join(p), c[p[:k]], c[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, l, r, n[lang], s) for i, (s, a, p, l, r) in enumerate(rows[:top], 1)]
    return sorted(out)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, lg) for i, (t, lg) in enumerate(rows)], "doc_id long, text string, lang string").selectExpr(
        "*", *(f"CAST(NULL AS {x.split()[1]}) AS {x.split()[0]}" for x in CLASH.split(", ")), "1 AS a", "2 AS key", "3 AS part", "4 AS words")


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(spark, top):
    import random
    r = random.Random(4)
    words = ["alpha", "Beta", "gam-ma", "δ", "the", "of", "漢字", "x" * 300]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  "]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und"]))
            for _ in range(150)]
    rows += [("New York City hall of the people", "en")] * 9 + [(None, "en"), ("", None), (" ,. ", "fr"), ("a a a a a a a", "fr"), ("b b", "fr"), ("new york new york", "en")]
    rows += [(prose(3, 3000), "en")]
    got = collocations.collocations(texts(spark, rows), 4, 5, top).drop("words")
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 4, 5, top)


def test_collocations_of_nothing(spark):
    df = texts(spark, [("a b", "en")])
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df).count() == 0
    assert collocations.collocations(df, 1, 3).drop("words").collect()[0].asDict()["score"] == 2000


def test_stripes_merge_over_batches():
    import pyarrow as pa
    held = [(np.array([3, 3, 1, 3], np.uint64), np.array([16, 32, 5, 16], np.uint64), np.array([9, 9, 8, 9], np.uint64), np.array([2, 1, 4, 1]))]
    rows = pa.Table.from_batches(list(collocations._sent(held)))
    twice = pa.concat_tables([rows, rows]).sort_by([("prefix", "ascending"), ("part", "ascending")])
    want = {(1, 5): 8, (3, 16): 6, (3, 32): 2}
    for size in (1, 2, 100):
        out = pa.Table.from_batches(list(collocations._merge(2)(iter(twice.combine_chunks().to_batches(size)))))
        key = {int(collocations.extended(np.array([p], np.uint64), np.array([x], np.uint64)).view(np.int64)[0]): (p, x) for p, x in itertools.product((1, 3), (5, 16, 32))}
        assert {key[r["key"]]: r["a"] for r in out.to_pylist()} == want
