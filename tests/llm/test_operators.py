"""Every operator and stage on a small table with nulls, empty and long texts, copies,
repeated rows and clashing columns, and on an empty table; results against plain Python."""
import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gradewell.llm import common, decontaminate, huffman, jaccard, langid, lm, packing, pii, quality, registry, repeats, tokens, toxicity

from .conftest import edge_rows, prose

ROWS = edge_rows()
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(t):
    return (t or "").encode().translate(LOW).split()


def ids_of(t, enc=tokens.Encoder(tokens.default_path())):
    return [*enc.whole(t or ""), 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_quality(edge, empty):
    got = quality.quality(edge).toPandas()
    assert len(got) == len(ROWS) and quality.quality(empty).count() == 0
    by = {r.doc_id: r for r in got.itertuples()}
    t = ROWS[13 + 2][1]
    assert by[14].n_symbols == sum(c in "#*$%&|<>" for c in t) and by[14].base_failed and not by[14].kept
    assert by[1].kept and by[5].n_words == 0 and by[5].base_failed and by[7].word_chars == 0
    kept = quality.keep_documents(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} >= {1, 4, 10}


@pytest.mark.parametrize("text,n", [("a b c a b c", 6), ("a b c d a b c", 6), ("a a a a", 4), ("a b c", 0), ("a b", 0), ("x a b c y a b c z", 6)])
def test_repeated_words(spark, text, n):
    df = spark.createDataFrame([(1, text, None), (2, text + "\n" + text + "\n \n", None)], "doc_id long, text string, lang string")
    rows = {r.doc_id: r for r in quality.quality(df).collect()}
    assert rows[1].n_repeat_words == n and rows[2].n_dup_lines == 1 and rows[1].char_distance is None


def test_jaccard(edge, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(edge, 3, 90, block=2).collect()]
    assert len(got) == len(ROWS) and jaccard.classes(empty).count() == 0
    sets = {}
    for i, t, *_ in ROWS:
        w = words(t)
        sets[i] = frozenset(tuple(w[k:k + 3]) for k in range(len(w) - 2)) or (frozenset([tuple(w)]) if w else frozenset())
    comp = {i: i for i in sets if i is not None}
    for _ in range(5):
        for a in comp:
            for b in comp:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert comp[2] == comp[3] == 1 and comp[9] == 8 and comp[6] == 6
    for i, n, c in got:
        assert n == len(sets[i]) and c == (comp[i] if i is not None else 1)


def test_jaccard_keeps_one(edge, empty):
    kept = jaccard.keep_one(edge)
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert kept.columns == edge.columns and ids == sorted([None, 1, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15], key=str)
    assert jaccard.keep_one(empty).count() == 0


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_components(spark, empty, monkeypatch, local):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    common.cut(spark.range(1))
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 2), (7, None), (10, 9), (10, 9)], "a long, b long")
    assert sorted(map(tuple, common.components(edges).collect())) == [(2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8), (10, 8)]
    assert common.components(edges.limit(0)).count() == 0


def test_decontamination(spark, edge, empty):
    bench = spark.createDataFrame([(7, prose(3, 60), 1), (8, None, 1), (9, "", 1), (10, "tiny", 1), (None, prose(50, 30), 1), (7, prose(3, 60), 1)],
                                  "item_id long, text string, doc_id long")
    got = decontaminate.leaks(edge, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(10, 7), (11, 7)} and all(r.edits == 0 for r in got)
    text = {i: t for i, t, *_ in ROWS}
    passage = prose(3, 60)
    for r in got:
        assert text[r.doc_id].index(passage) <= r.start <= r.stop <= text[r.doc_id].index(passage) + len(passage)
    kept = decontaminate.drop_leaks(edge, bench)
    assert kept.columns == edge.columns and kept.count() == len(ROWS) - 2
    assert decontaminate.drop_leaks(edge, bench.limit(0)).count() == len(ROWS) and decontaminate.leaks(empty, bench).count() == 0
    many = decontaminate.leaks(edge, bench, decontaminate.Params(block_bytes=100))  # several blocks
    assert {(r.doc_id, r.item_id) for r in many.collect()} == {(10, 7), (11, 7)}


def test_pii(edge, empty):
    got = {r.doc_id: r for r in pii.find(edge).collect()}
    r, t = got[15], ROWS[-1][1]
    base = [f"email:{t.index('a.b@')}:{t.index('a.b@') + 15}", f"ip:{t.index('10.0.0.30', t.index('300'))+ 0}:{len(t)}"]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.n_added) == (1, 1, 0, 0, 1)
    assert [x for x in r.spans.split(",") if "c (at)" not in t[int(x.split(":")[1]):int(x.split(":")[2])]] == base
    assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert got[5].spans == "" and got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = pii.mask(edge)
    assert masked.columns == edge.columns and masked.count() == len(ROWS) and pii.find(empty).count() == pii.mask(empty).count() == 0
    assert {x.doc_id: x.text for x in masked.collect()}[15] == "mail <EMAIL> or <EMAIL>, ip 10.0.0.300 <IP>"


def test_huffman_files(edge, empty):
    got = sorted(map(tuple, huffman.read(huffman.write(edge, block_tokens=64)).collect()), key=lambda r: r[1])
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r[0] for r in got] == [r[0] for r in order]
    at = 0
    for (i, start, raw), row in zip(got, order):
        ids = ids_of(row[1])
        assert start == at and np.frombuffer(raw, "<u4").tolist() == ids
        at += len(ids)
    assert huffman.read(huffman.write(empty)).count() == 0


def test_packing(spark, edge, empty):
    got = packing.pack_documents(edge).toPandas()
    want = {}
    for i, t, *_ in ROWS:
        want[i] = ids_of(t)
    for r in got.itertuples():
        own = want[None if np.isnan(r.doc_id) else r.doc_id]
        assert r.ids_crc32 == crc(own[r.start:r.start + r.length]) and 0 < r.length <= 2048
    assert got.length.sum() == sum(len(ids_of(t)) for _, t, *_ in ROWS)
    check_sequences(got, 2048)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1
    assert packing.pack_documents(empty).count() == 0
    one = edge.where("doc_id in (1, 10, 11)")
    packed = packing.pack_documents(one)
    back = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(one, packed).collect()}
    for r in packed.collect():
        assert back[r.sequence_id][r.offset:r.offset + r.length] == want[r.doc_id][r.start:r.start + r.length]


def check_sequences(got, size):
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= size


def test_packing_rounds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(1, 2049, 900))]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), group_items=40, carry=30).toPandas()
    assert sorted(got.doc_id) == list(range(900))
    check_sequences(got, 2048)


def test_repeats(spark, edge, empty):
    got = {r.doc_id: r for r in repeats.remove_repeats(edge).collect()}
    assert repeats.remove_repeats(empty).count() == 0
    seen = {}
    for i, t in sorted({(-1 if i is None else i, t or "") for i, t, *_ in ROWS}):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 99):
            if b[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.setdefault(b[s:s + 100], i)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        r = got[None if i == -1 else i]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert r.n_spans == int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) and bytes(r.kept) == kept


def test_language_model(spark, edge, empty):
    train = edge.where("doc_id < 12")
    model = lm.build(train)
    got = lm.score(edge, model).collect()
    uni, bi = {}, {}
    for i, t, *_ in ROWS:
        if i is not None and i < 12:
            w = [*words(t), 0]
            for c, x in zip([1, *w[:-1]], w):
                uni[x] = uni.get(x, 0) + 1
                bi[c, x] = bi.get((c, x), 0) + 1
    total, distinct = sum(uni.values()), len(uni)
    text = {i: t for i, t, *_ in ROWS}
    p0 = lambda x: (uni.get(x, 0) + 0.5) / (total + 0.5 * (distinct + 1))
    for r in got:
        w = [*words(text[r.doc_id]), 0]
        ctx = lambda c: uni.get(0 if c == 1 else c, 0)
        want = sum(np.log10(bi.get((c, x), 0) / (ctx(c) + lm.MU) + lm.MU / (ctx(c) + lm.MU) * p0(x)) for c, x in zip([1, *w[:-1]], w))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in uni for x in w), total)
        assert abs(r.base_score - sum(np.log10(p0(x)) for x in w)) < 1e-6 * len(w) and abs(r.score - want) <= 0.03 * abs(want)
    nothing = lm.score(edge, lm.build(empty)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in nothing) and lm.score(empty, model).count() == 0


def test_toxicity(spark, edge, empty):
    labels = spark.createDataFrame([(i, 1 if i == 1 else None if i == 4 else 0) for i in (1, 3, 4, 10, 11)], "doc_id long, toxic int")
    got = toxicity.score(edge, toxicity.train(edge, labels)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert {r.doc_id: r.score for r in got}[5] == 0
    none = toxicity.score(edge, toxicity.train(edge, labels.limit(0)))
    assert all(r.predicted == 0 for r in none.collect()) and toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_language(spark, edge, empty):
    rows = [(i, prose(i, 30, "de" if i % 2 else "en"), "de" if i % 2 else "en") for i in range(200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.predict(edge, model).collect()}
    assert got[4].lang_pred == "de" and got[1].lang_pred == got[10].lang_pred == "en" and got[1].score > 0.9
    assert [(got[i].lang_pred, got[i].score) for i in (5, 6, 7, 14)] == [("und", 0.0)] * 4
    assert {r.lang_pred for r in langid.predict(edge, langid.train(empty)).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_stages(spark, edge, empty, tmp_path):
    spark.createDataFrame([(7, prose(3, 60))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = edge
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        none = stage(spark, empty, str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns
        out.write.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == edge.columns
        docs = spark.read.parquet(str(tmp_path / str(k)))
    ids = {r.doc_id for r in docs.collect()}
    assert {1, 4} <= ids and not ids & {2, 3, 10, 11, 14}


def test_registry():
    names = [*registry.queries()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(registry.oracle_sql()) <= set(names)


def brute_components(texts, n, percent):
    """Smallest id that each text reaches, texts being {id: text}."""
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    inverted = {}
    for i, s in sets.items():
        for g in s:
            inverted.setdefault(g, []).append(i)
    for i, s in sets.items():
        common = {}
        for g in s:
            for j in inverted[g]:
                common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in texts}


def family_texts(seed, families, members):
    """Families of copies, each with a few words changed, a passage that all share, and lone texts."""
    import random
    r = random.Random(seed)
    passage = prose(99, 15)
    out = []
    for f in range(families):
        base = prose(1000 + f, r.randint(30, 120)).split() + passage.split()
        for _ in range(members if f else 6 * members):
            w = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(["changed", "other", f"w{r.random()}"])
            out.append(" ".join(w))
    out += [prose(5000 + i, 80) + " " + passage for i in range(200)] + ["one two", "one two", "", "x"] * 3
    r.shuffle(out)
    return out


@pytest.mark.parametrize("n,percent,block,whole,local", [(3, 90, 8192, 1 << 24, 1 << 20), (3, 90, 17, 9000, 1 << 20), (5, 80, 40, 1 << 24, 0), (2, 50, 60, 20000, 1 << 20)])
def test_join_equals_brute_force(spark, monkeypatch, n, percent, block, whole, local):
    monkeypatch.setattr(jaccard, "WHOLE", whole)
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    texts = dict(enumerate(family_texts(n * percent, 36, 40)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.classes(df, n, percent, block).collect()}
    assert got == brute_components(texts, n, percent)


def test_rows_that_share_an_id(spark):
    t, u, v = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, t, 1), (5, t, 1), (5, u, 2), (5, u, 2), (6, v, 3), (6, v + " more", 4), (None, u, 5), (7, "", 6), (7, None, 7), (7, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, t long")
    kept = sorted(((r.doc_id, r.text, r.t) for r in jaccard.keep_one(df, 5, 80).collect()), key=str)
    first = min(((6, v, 3), (6, v + " more", 4)), key=lambda r: [x for x in kept if x[1] == r[1]] == [])
    assert kept == sorted([(1, t, 1), (5, u, 2), first, (None, u, 5), (7, "", 6), (7, None, 7)], key=str)
    by = sorted((r.doc_id, r.component_id) for r in jaccard.classes(df, 5, 80).collect() if r.doc_id == 5)
    assert by == [(5, 1), (5, 5), (5, 5)]


def brute_repeats(rows, length=100):
    """(doc_id, kept bytes) of (doc_id, text), documents in the given order; repeated rows are one document."""
    seen, out = set(), []
    for i, t in dict.fromkeys((i, t or "") for i, t in rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if b[s:s + length] in seen:
                gone[s:s + length] = True
            seen.add(b[s:s + length])
        out += [(i, bytes(x for x, g in zip(b, gone) if not g))] * sum((j, u or "") == (i, t) for j, u in rows)
    return out


@pytest.mark.parametrize("starts,records", [(1 << 18, 20_000), (64, 3)])
def test_repeats_in_blocks_and_rows_that_share_an_id(spark, monkeypatch, starts, records):
    monkeypatch.setattr(repeats, "STARTS", starts)
    monkeypatch.setattr(repeats, "RECORDS", records)
    a, b, c = prose(21, 90), prose(22, 400), prose(23, 60)
    unique = [(1, a), (2, b + " " + a), (3, prose(24, 30) + a[50:300] + c), (4, "ab" * 400), (5, c + b[100:900]), (6, "x" * 700)]
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, bytes(r.kept)) for r in repeats.remove_repeats(df(unique)).collect()) == sorted(brute_repeats(unique))
    alone = [(None, prose(31, 70)), (None, prose(32, 80)), (7, prose(33, 60)), (7, prose(34, 60)), (8, None)]
    got = repeats.remove_repeats(df(alone)).collect()
    assert sorted(bytes(r.kept).decode() for r in got) == sorted(t or "" for _, t in alone) and all(r.n_removed == 0 for r in got)
    # one shared id: the order of its rows is open, so one of both
    rows = [(None, c), (3, a), (9, b), (9, b + a), (9, b), (10, c)]
    got = sorted(((str(r.doc_id), bytes(r.kept)) for r in repeats.remove_repeats(df(rows)).collect()))
    orders = [rows, [rows[0], rows[1], rows[3], rows[2], *rows[4:]]]
    assert got in [sorted((str(i), k) for i, k in brute_repeats(o)) for o in orders]


def test_rare_language_is_learned(spark):
    rows = [(i, prose(i, 40), "en") for i in range(3000)] + [(10_000 + i, prose(i, 120, "de"), "de") for i in range(40)]
    rows += [(20_000 + i, "pqzw xkqj zzqw " * 12, "zz") for i in range(3)]
    p = langid.Params(sample=600, least=8)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, p)
    assert model.langs == ["de", "en", "zz"]
    new = spark.createDataFrame([(1, prose(90, 200, "de")), (2, prose(91, 200)), (3, "pqzw zzqw xkqj " * 9)], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(new, model, p=p).collect()} == {1: "de", 2: "en", 3: "zz"}
