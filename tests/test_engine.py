"""Line filters against plain Python models, syntax facts, reshaping and scans on hard rows."""
import random
import re

from pyspark.sql import functions as F

from gradewell.operators.explode import dedupe_last, explode_models, regroup
from gradewell.operators.extract import CODE_LIKE, _rob_lines
from gradewell.operators.facts import code_facts
from gradewell.plans import comment as COM
from gradewell.plans.modularity import extract_mod, python_structure
from gradewell.plans.standardization import standardization_report
from gradewell.sources import jsonl as J


def rob_model(text):
    on, out = False, []
    for line in text.split("\n"):
        like, blank = re.search(CODE_LIKE.replace("(?U)", ""), line), not line.strip()
        if like or (on and not blank):
            out.append(line)
        if like:
            on = True
        elif on and blank and len(out) > 3:
            on = False
    return "\n".join(out)


def com_model(text):
    on, out = False, []
    for line in text.split("\n"):
        like, blank = any(re.search(p.replace("(?U)", ""), line) for p in COM.CODE_LIKE_COM), not line.strip()
        if like or (on and not blank):
            out.append(line)
        on = True if like else False if blank else on
    return "\n".join(out) or None


def test_line_filters_equal_the_loop(spark):
    r = random.Random(4)
    texts = ["\n".join(r.choice(["", " ", "\t", "plain words", "x = 1", "if a", "more prose", "结果", "  f(x)"]) for _ in range(r.randint(0, 14)))
             for _ in range(400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in rows.select("t", _rob_lines(F.col("t")).alias("rob"), COM._com_lines(F.col("t")).alias("com")).collect():
        assert r["rob"] == rob_model(r["t"]) and r["com"] == com_model(r["t"]), repr(r["t"])


def test_long_answers_take_linear_time(spark):
    text = "\n".join(["x = 1", "plain words", ""] * 35000)
    row = spark.createDataFrame([(text, "```python\n" + text)], "t string, f string")
    got = row.select(F.length(_rob_lines(F.col("t"))), F.length(COM._com_lines(F.col("t"))), extract_mod(F.col("f"))).first()
    assert got[0] > 500000 and got[1] > 500000 and got[2] == text  # an open fence: the run of code-like lines


def structure(spark, code):
    return python_structure(code_facts(spark.createDataFrame([(1, "m", code)], "idx long, model string, code string"))).first()


def test_cohesion_counts_empty_classes_and_nested_functions(spark):
    two = "class A:\n    def a(self):\n        self.x = 1\n    def b(self):\n        self.y = 2\n"
    assert structure(spark, two).lcom2 == 1.0
    assert structure(spark, two + "class B:\n    pass\n").lcom2 == 0.5
    nested = "def f():\n    def g():\n        return a\n    return g\ndef h():\n    return a\n"
    assert structure(spark, nested).lcom2 == 0.0  # f also loads a, through g


def test_null_index_reaches_the_facts(spark):
    df = spark.createDataFrame([(None, "m", "x = 1")], "idx long, model string, code string")
    assert {r.kind for r in code_facts(df).collect()} >= {"Module", "Assign"}


def test_repeated_model_keys(spark):
    lines = spark.createDataFrame([('{"index": 1, "results": {"gpt": "a", "qwen": "q", "gpt": "b"}}',)], "value string")
    tasks = J.scan_lenient(lines)
    got = [(r.pos, r.model, r.response) for r in explode_models(tasks).orderBy("pos").collect()]
    assert got == [(0, "gpt", "b"), (1, "qwen", "q")]


def test_scan_reasons(spark):
    rows = ["", " \t ", "{oops", '{"index": 1, "results": [1]}', '[1, 2]', '{"index": "007", "code-instruction": "", "instruction": "do", "results": {"gpt": "a"}}']
    c = [r.reason for r in J.classify(spark.createDataFrame([(x,) for x in rows], "value string")).collect()]
    assert c == ["blank", "blank", "malformed", "bad_shape", "bad_shape", "ok"]
    task = J.scan_lenient(spark.createDataFrame([(rows[-1],)], "value string")).first()
    assert (task["index"], task["instruction"]) == ("007", "do")


def test_strict_scan_and_sink(spark, tmp_path):
    import pytest
    good = '{"index": "007", "results": {"gpt": "a"}}'
    assert J.scan_strict(spark.createDataFrame([(good,)], "value string")).count() == 1
    with pytest.raises(ValueError):
        J.scan_strict(spark.createDataFrame([(good,), ("{",)], "value string"))
    scores = spark.createDataFrame([("007", 0, "gpt", "python", 1.5), ("MERGED_1", 0, "gpt", "python", None)],
                                   "idx string, pos int, model string, programming_language string, score double")
    for _ in range(2):
        J.sink_jsonl(regroup(scores), str(tmp_path / "out"), "append")
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines[0] == lines[1] and lines[0].startswith('{"index":"MERGED_1"') and lines[2].startswith('{"index":7,') and '"gpt":1.5' in lines[2]
    assert J.preview(J.read_lines(spark, str(tmp_path / "out"))).count() == 0  # only *.jsonl files are input


def test_last_line_wins(spark):
    df = spark.createDataFrame([("a", 1, {"gpt": "x"}), ("a", 2, {"gpt": "y"}), ("b", 3, None)], "k string, n int, results map<string,string>")
    assert {r.k: (r.n, r.results) for r in dedupe_last(df, "k", "n").collect()} == {"a": (2, {"gpt": "y"}), "b": (3, None)}


def test_tasks_of_empty_answers_stay_in_the_report(spark):
    rows = [(1, 0, "gpt", "python", "do it", ""), (1, 1, "qwen", "python", "do it", None), (2, 0, "gpt", "python", "do it", "x = 1")]
    got = standardization_report(spark.createDataFrame(rows, "idx long, pos int, model string, programming_language string, instruction string, response string"))
    by = {r.idx: r for r in got.collect()}
    assert set(by) == {1, 2} and by[1].gpt is None and by[2].gpt > 0
