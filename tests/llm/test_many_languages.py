"""More languages than a plan could hold one expression each for."""
import random

from gradewell.llm import quality


def text(lang, seed, n):
    r, own = random.Random(seed), [f"{chr(97 + lang // 26)}{chr(97 + lang % 26)}{x}" for x in "abcdefghij"]
    return " ".join(r.choice(own) + r.choice(["", "", "e", "o"]) for _ in range(n))


def test_every_language_has_a_reference(spark):
    rows = [(i, text(i, i, 300 - i), f"l{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.references(docs, quality.Params(reference_documents=1, reference_letters=0))
    assert refs["chars"].keys() == refs["words"].keys() == {r[2] for r in rows} and all(refs["words"].values())
    got = {r.doc_id: r for r in quality.quality(docs, refs=refs).collect()}
    assert all(r.word_distance < 0.3 and r.kept for r in got.values() if not r.base_failed)
    assert not got[89].base_failed


def test_query_and_sql_agree_on_many_languages(spark):
    import duckdb
    rows = [(90 * k + i, text(i, 7 * i + k, 60 + 3 * i), f"l{i}") for i in range(90) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    params = quality.Params(reference_documents=3, reference_letters=100)
    got = sorted(map(tuple, quality.quality(docs, params).collect()))
    con = duckdb.connect()
    pdf = docs.toPandas()
    con.register("documents", pdf)
    cols = ", ".join(quality.quality(docs, params, {"chars": {}, "words": {}}).columns)
    assert got == sorted(con.execute(f"SELECT {cols} FROM ({quality.oracle(params=params)})").fetchall())
    assert len({r[0] for r in got}) == 270


def test_lone_junk_is_not_its_own_reference(spark):
    from .conftest import prose
    rows = [(i, prose(i, 300), "en") for i in range(30)]
    junk = " ".join(f"q{chr(97 + i % 26)}x{chr(97 + i // 26)}" for i in range(600))
    rows += [(100, junk, "zz"), (101, junk, "en"), (102, prose(77, 300), None)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[100].kept and not got[101].kept and got[102].kept and got[3].kept
    assert got[100].word_distance > 0.42
