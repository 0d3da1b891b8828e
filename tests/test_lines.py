"""Line numbers in file order without Python, and completeness of a run."""
import json
import os

from pyspark.sql import functions as F

from gradewell.plans.simplicity import simplicity_report
from gradewell.sources import jsonl as J


def test_line_numbers_follow_the_files(spark, tmp_path):
    want, n = [], 0
    for f in range(7):
        with open(tmp_path / f"part-{f}.jsonl", "w") as out:
            for k in range(0 if f == 3 else 40 + 300 * (f % 3)):
                line = f"file {f} line {k} " + "x" * (k % 57) if k % 11 else ""
                out.write(line + "\n")
                want.append((n, line))
                n += 1
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("700b", "5kb", old):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = J.with_line_ordinal(J.read_lines(spark, str(tmp_path)))
            assert sorted((r.line_no, r.value) for r in df.collect()) == want
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan and "Arrow" not in plan and "Scan ExistingRDD" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_of_other_rows(spark):
    df = J.with_line_ordinal(spark.range(100).repartition(7).select(F.col("id").cast("string").alias("value")))
    assert sorted(r.line_no for r in df.collect()) == list(range(100))
    assert J.with_line_ordinal(df.select("value").limit(0)).count() == 0


def test_completeness_of_a_run(spark, tmp_path):
    task = lambda i: json.dumps({"index": i, "results": {"base": "```python\nx = 1\n```"}})
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.jsonl").write_text("\n".join([task(1), "", "{broken", task(2), task(3)]) + "\n")
    lines = J.read_lines(spark, str(tmp_path / "in"))
    got = J.completeness(lines, simplicity_report, str(tmp_path / "out")).first().asDict()
    assert got == {"lines_read": 5, "valid_tasks": 3, "rows_written": 3, "missing": 0, "complete": True}
    lossy = J.completeness(lines, lambda t: simplicity_report(t.where("idx <> '2'")), str(tmp_path / "out2")).first()
    assert (lossy.missing, lossy.complete) == (1, False)
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_bad_tasks_yield_their_own_lines(spark, tmp_path):
    good = json.dumps({"index": 1, "results": {"base": "```python\nx = 1\n```"}})
    rows = [good, '{"index":7,"results":"text"}', '{"index":"k","programming_language":"Java"}', "[1]", "{broken", "", good.replace("1,", "2,", 1)]
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    errors = J.error_records(lines)
    assert sorted(map(tuple, errors.collect()), key=str) == sorted([("7", "python", "results is string"), ("k", "Java", "results missing"), (None, "python", "task is array")], key=str)
    scored = simplicity_report(J.scan_lenient(lines).withColumnRenamed("index", "idx"))
    out = [json.loads(r.value) for r in J.with_error_lines(scored, errors).collect()]
    assert sorted((str(r.get("index")), "error" in r["results"]) for r in out) == [("1", False), ("2", False), ("7", True), ("None", True), ("k", True)]


def test_input_is_found(spark, tmp_path):
    import pytest
    with pytest.raises(FileNotFoundError):
        J.find_input(spark, str(tmp_path), ["a.jsonl"])
    for name in ("z.jsonl", "b.jsonl", "c.txt"):
        (tmp_path / name).write_text("")
    assert J.find_input(spark, str(tmp_path), ["a.jsonl", "z.jsonl"]).endswith("/z.jsonl")
    assert J.find_input(spark, str(tmp_path), ["a.jsonl"]).endswith("/b.jsonl")
