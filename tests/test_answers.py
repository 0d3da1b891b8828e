"""Answers of other JSON kinds than text."""
import json

from pyspark.sql import functions as F

from gradewell.plans.functionality import extract_fun
from gradewell.plans.robustness import robustness_components
from gradewell.sources import answers as A

CODE = "```python\ndef f(x):\n    return x + 1\n```"


def python_text(v):
    """What the rules make of an answer."""
    if not v:
        return None
    if isinstance(v, dict):
        return next((python_text(v[k]) for k in A.FIELDS if k in v), None)
    return v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False) if isinstance(v, list) else str(v)


VALUES = {"plain": CODE, "number": 5, "zero": 0, "half": 2.5, "yes": True, "no": False, "none": None, "empty": "", "list": [1, "q", {"a": 2}], "nolist": [],
          "object": {"content": CODE}, "deep": {"response": {"text": {"content": {"content": "x"}}}}, "order": {"text": "t", "content": None, "response": "r"},
          "lost": {"other": CODE}, "hollow": {}, "inner": {"content": {"other": 1}}, "count": {"text": 7}, "ünï": {"text": "ü\n\"😀\""}}


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def test_kinds_and_unwrapping(spark):
    got = A.typed_answers(lines(spark, {"index": 1, "results": VALUES}, "{broken", {"index": 2}))
    by = {r.model: r for r in got.select("pos", "model", "kind", A.text_of(A.unwrapped(F.col("answer"))).alias("t")).collect()}
    assert {m: r.t or None for m, r in by.items()} == {m: python_text(v) for m, v in VALUES.items()}
    assert [m for m, _ in sorted(by.items(), key=lambda p: p[1].pos)] == list(VALUES)
    kinds = {"plain": "text", "number": "number", "half": "number", "yes": "boolean", "none": "null", "list": "list", "deep": "object", "empty": "text"}
    assert {m: by[m].kind for m in kinds} == kinds


def test_deep_nesting_and_repeated_keys(spark):
    deep = '{"content":' * 200 + '"x"' + "}" * 200
    rows = A.typed_answers(lines(spark, '{"index":1,"results":{"a":' + deep + "}}", '{"index":2,"results":{"a":"one","a":"two"}}'))
    got = {r.idx: r.response for r in A.responses_of(rows, "unwrap").collect()}
    assert got == {"1": "x", "2": "two"}


def test_plans_read_either_policy(spark):
    rows = A.typed_answers(lines(spark, {"index": 1, "results": {"a": {"content": CODE}, "b": CODE, "c": 12}}))
    un, text = A.responses_of(rows, "unwrap"), A.responses_of(rows, "text")
    code = {r.model: r.c for r in un.select("model", extract_fun(F.col("response"), F.col("model")).alias("c")).collect()}
    assert code["a"] == code["b"] and code["a"].startswith("def f") and code["c"] is None
    rob = {r.model: r.code for r in robustness_components(text).collect()}
    assert rob["b"].startswith("def f") and rob["a"] == rob["c"] == ""
