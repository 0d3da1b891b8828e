"""The corpus does not follow the files of the input; dimensions work out what an answer's language reads."""

from pyspark.sql import functions as F

from gradewell.functions.text import count_sub
from gradewell.operators.rules import java_regex
from gradewell.plans import comment, efficiency, modularity, robustness, standardization
from gradewell.sources import corpus


def test_one_row_group_becomes_many_files(spark, tmp_path):
    words = F.concat_ws(" ", *[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(k))), 512) for k in range(8)])
    docs = spark.range(4000).select(F.when(F.col("id") % 50 > 0, F.col("id")).alias("doc_id"), words.alias("text"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    r = corpus.responses(spark, str(tmp_path))
    assert len(r.inputFiles()) >= 4
    assert r.count() == 4000 and r.where("idx IS NULL").count() == 80
    sizes = [x["count"] for x in r.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 2 * 4000 / len(sizes)


def test_files_follow_the_input():
    assert corpus.slices(0, 12) == corpus.slices(1000, 12) == 1
    assert corpus.slices(16 << 20, 12) == 24 and corpus.slices(4 << 30, 12) == 256


def test_estimates_of_the_own_language_only(spark):
    rows = [(i, 0, "gpt", lang, f"```{lang}\n{code}\n```") for i, (lang, code) in enumerate(
        [("python", "import os\ndef f(x):\n    return x + 1"), ("java", "import java.util.List;\npublic class A { private int x; }"),
         ("cpp", "#include <x>\nint main() { std::cout << 1; return 0; }")])]
    df = spark.createDataFrame(rows, "idx long, pos int, model string, programming_language string, response string")
    own, every = ({r["lang"]: r for r in f(df, own_only=o).collect()} for f, o in ((robustness.robustness_components, True), (robustness.robustness_components, False)))
    for lang, name in (("python", "mi_python_fallback"), ("java", "mi_java"), ("cpp", "mi_cpp")):
        assert own[lang][name] == every[lang][name] is not None
        assert [n for n in ("mi_python_fallback", "mi_java", "mi_cpp") if own[lang][n] is not None] == [name]
    m = {r["lang"]: r for r in modularity.modularity_inputs(df, own_only=True).collect()}
    assert (m["python"]["py_regex_ce"], m["java"]["java_ce"], m["c++"]["cpp_ce"]) == (1, 1, 1)
    assert m["java"]["feature_ce"] is None and m["python"]["java_ce"] is None


def test_fences_of_efficiency_and_comments(spark):
    texts = ["a\n```Py\nx = 1\n``` b ```\ny\n```", "no ```x = 1``` end", "``````", "text\nx = 1\ndef f", "``` only one\nx = 2", "", "a\n    b", "```\n```", "prose only"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx long, response string")
    got = [tuple(r[0]) for r in df.orderBy("idx").select(efficiency.extract_eff(F.col("response"))).collect()]
    assert got == [("x = 1\n", "py"), ("x = 1", ""), ("", ""), ("x = 1\ndef f", "python"), ("x = 2", ""), ("", ""), ("", ""), ("", ""), ("", "")]
    codes = [r["code"] for r in comment.with_code(df).orderBy("idx").collect()]
    assert codes[:2] == ["x = 1", "x = 1"] and codes[6:] == ["b", None, None]


def test_rule_hits_by_the_cheap_patterns(spark):
    texts = ["a=1", "a1b2 \t= 3", "9 = 1", "_9=", "=", "aB", "a9B", "AB", "a_B", "aéB", "é=", "x é = 1", "A9", "fooBar", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for slow, fast in standardization.SAME_HITS.items():
        assert all(a == b for a, b in df.select(F.col("t").rlike(java_regex(slow)), F.col("t").rlike(java_regex(fast))).collect())
    n = df.select(count_sub(F.concat(F.col("t"), F.lit("aaé aaé")), "é")).collect()
    assert [r[0] for r in n] == [t.count("é") + 2 for t in texts]


def test_lines_of_distinct_rows_of_many_files(spark, tmp_path):
    from gradewell.sources.jsonl import with_line_ordinal
    spark.range(40).select((F.col("id") % 10).alias("idx")).repartition(4).write.parquet(str(tmp_path / "t"))
    lines = spark.read.parquet(str(tmp_path / "t")).select("idx").distinct().repartitionByRange("idx").sortWithinPartitions("idx")
    rows = with_line_ordinal(lines.select(F.col("idx").cast("string").alias("value"))).collect()
    assert sorted((r["line_no"], r["value"]) for r in rows) == [(i, str(i)) for i in range(10)]
