"""Searches in answers: one pass over the text, worked out once per answer, with the matches of the plain patterns."""

import random
import re

from pyspark.sql import functions as F

from gradewell.functions.text import indent, lstrip, rstrip, strip, until
from gradewell.operators.extract import CODE_LIKE, CODE_LIKE_FIRST, INNER, _join_all, extract_std
from gradewell.operators.facts import FACT_SCHEMA, code_facts
from gradewell.operators.metrics import MI_WORDS, mi_estimate
from gradewell.plans import comment as COM
from gradewell.plans import efficiency as EFF
from gradewell.plans import standardization as STD

PLAIN = {  # pattern of the scorers, the one in use
    r"```(?:python|java|cpp|c\+\+)?\n([\s\S]*?)\n```": r"```(?:python|java|cpp|c\+\+)?\n(" + until("\n```") + r")\n```",
    r"```([\s\S]*?)```": f"```{INNER}```",
    r"```(?:python)?\s*([\s\S]*?)```": rf"```(?:python)?\s*{INNER}```",
    r"(/\*[\s\S]*?\*/)": rf"(/\*{until('*/')}\*/)",
    r"('''[\s\S]*?''')": f"('''{until(COM.SINGLE)}''')",
    **dict(zip(COM.FENCE_PATTERNS, COM.ONE_PASS_FENCES)),
}


def texts(n=1500):
    rng = random.Random(5)
    pieces = ["`", "``", "```", "\n", "\n```", "python", "a", "é", " ", "/*", "*", "*/", "'", "'''", "def ", "if", "(", " ", "#"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(n)]


def matches(spark, rows, patterns):
    cols = [F.regexp_extract_all("v", F.lit(p), F.lit(1)).alias(f"c{i}") for i, p in enumerate(patterns)]
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, v string").select("i", *cols).orderBy("i").collect()


def test_one_pass_patterns_find_what_the_plain_ones_find(spark):
    rows = texts()
    assert [r[1:] for r in matches(spark, rows, PLAIN)] == [r[1:] for r in matches(spark, rows, PLAIN.values())]


def test_efficiency_fences(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "v string")
    for plain, fast in ((EFF.EFF_TAGGED, EFF.TAGGED_ONE_PASS), (EFF.EFF_BARE, EFF.BARE_ONE_PASS)):
        assert df.where(F.regexp_extract("v", plain, 0) != F.regexp_extract("v", fast, 0)).count() == 0


def test_long_runs_keep_no_way_back(spark):
    text = "```\n" + "`\n" * 300_000 + "x\n```"
    got = spark.createDataFrame([(text,)], "v string").select(F.length(extract_std(F.col("v"))).alias("n")).first()["n"]
    assert got == len(text) - 8


def test_white_space_is_that_of_the_pattern(spark):
    chars = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.expr("chr(65)").alias("a"), "id")
    v = F.udf(chr, "string")("id")
    df = chars.select(F.concat(v, F.lit("x y"), v).alias("v"))
    old = F.regexp_replace("v", r"(?U)^\s+|(?<!\s)\s+$", "")
    wrong = ((strip("v") != old) | (lstrip("v") != F.regexp_replace("v", r"(?U)^\s+", "")) | (rstrip("v") != F.regexp_replace("v", r"(?U)(?<!\s)\s+$", ""))
             | (indent("v") != F.length(F.regexp_extract("v", r"(?U)^\s*", 0))))
    assert df.where(wrong).count() == 0


def test_code_like_lines(spark):
    lines = [x for t in texts() for x in t.split("\n")] + ["xdef a", "def", "a for b", "import", "ifs", "_if", "é while"]
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    v = F.col("v")
    assert df.where(v.rlike(CODE_LIKE) != v.rlike(CODE_LIKE_FIRST)).count() == 0
    assert df.where(v.rlike(COM.CODE_LIKE_COM[0]) != v.rlike(COM.WORDS_FIRST)).count() == 0


def test_maintainability_counts_all_words(spark):
    text = "if for while notif classdef instanceof\n" * 3
    for words in MI_WORDS.values():
        got = spark.createDataFrame([(text,)], "v string").select(mi_estimate(F.col("v"), words).alias("r")).first()["r"]
        assert got == round(100 - (0.2 * 4 + 0.5 * len(re.findall(words, text))), 1)


def searches(df):
    """Pattern searches of fences in the plan of a query."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all")


def test_extraction_is_worked_out_once(spark):
    r = spark.createDataFrame([(1, "gpt", "```\ndef f(x): pass\n```")], "idx long, model string, response string")
    assert searches(STD.code_languages(r)) == 2  # one for each fence pattern
    assert searches(STD.indent_break_counts(r)) == 2
    assert searches(r.select(_join_all(F.col("response"), "(a)").alias("x"))) == 1


def test_facts_come_in_bounded_batches(spark):
    code = "\n".join(f"x{i} = {i}" for i in range(4000))
    df = spark.createDataFrame([(1, "a", code), (2, "b", "def f(:"), (3, None, "x = 1"), (None, "c", "y"), (4, "d", None), (5, "e", "")],
                               "idx long, model string, code string")
    facts = code_facts(df)
    assert facts.dtypes == spark.createDataFrame([], FACT_SCHEMA).dtypes
    n = {(r["idx"], r["model"]): r["count"] for r in facts.groupBy("idx", "model").count().collect()}
    assert n == {(1, "a"): 1 + 4000 * 4, (2, "b"): 1, (3, None): 5, (None, "c"): 4}
