"""The derived corpus carries whole texts: every template and shape, lines and nulls."""
from gradewell.sources.corpus import responses


def test_every_text_reaches_its_answer(spark, tmp_path):
    texts = {i: None if i % 48 == 47 else "" if i % 48 == 46 else f"alpha beta {i} first.\nline two of {i} ends here" for i in range(12 * 4 * 7)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["idx"] * 4 + r["pos"]: r["response"] for r in responses(spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert (got[i] is None) == (not text and i % 7 == 4), i
        assert not text or all(line in got[i] for line in text.split("\n")), (i, got[i])
