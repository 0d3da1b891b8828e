"""Streams with state: running totals, and the last line of every key, over batches and restarts; typed keys."""
import json
import os
import time

from pyspark.sql import functions as F

from gradewell.plans.simplicity import simplicity_report
from gradewell.sources import jsonl as J
from gradewell.sources import keys as K
from gradewell.streaming import stream_score as S


def task(i, n):
    return json.dumps({"index": i, "programming_language": "python", "results": {"base": "```python\n" + "x = 1\n" * n + "```"}})


BATCHES = [[task(1, 3), "", task(2, 5), "{broken"], [task(2, 90), task(3, 4), task(3, 200)], ["{}", task(1, 400), task("k", 7)]]


def put(folder, k):
    path = folder / f"f{k}.jsonl"
    path.write_text("\n".join(BATCHES[k]) + "\n")
    at = time.time() - 100 + k
    os.utime(path, (at, at))


def test_totals_and_reports_survive_restarts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    totals, reports = (str(tmp_path / x) for x in ("totals", "reports"))
    for k in range(3):  # every round is a restart
        put(src, k)
        S.stream_totals(spark, str(src), totals, str(tmp_path / "c1")).awaitTermination()
        S.stream_reports(spark, str(src), reports, str(tmp_path / "c2"), simplicity_report).awaitTermination()
    lines = [x for b in BATCHES for x in b]
    want = {r: n for r, n in J.classify(spark.createDataFrame([(x,) for x in lines], "value string")).groupBy("reason").count().collect()}
    assert {r.reason: r.lines for r in S.read_totals(spark, totals).collect()} == want == {"ok": 7, "blank": 1, "malformed": 1, "bad_shape": 1}
    last = {}
    for x in lines:
        if x and x[0] == "{" and "results" in x:
            last[json.loads(x)["index"]] = x
    batch = J.result_lines(simplicity_report(J.scan_lenient(spark.createDataFrame([(x,) for x in last.values()], "value string")).withColumnRenamed("index", "idx")))
    assert sorted(r.value for r in S.read_reports(spark, reports).collect()) == sorted(r.value for r in batch.collect())
    assert len(last) == 4


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    write = S._by_batch(str(tmp_path / "out"))
    for batch, n in ((0, 3), (1, 5), (1, 5)):
        write(spark.range(n).select(F.lit("ok").alias("reason"), F.lit(n).alias("lines")).limit(1), batch)
    assert [tuple(r) for r in S.read_totals(spark, str(tmp_path / "out")).collect()] == [("ok", 5)]


def test_keys_keep_their_kind(spark):
    rows = ['{"index":41,"results":{}}', '{"index":"41","results":{}}', "", '{"index":41.0,"results":{}}', '{"id":"MERGED_000001_cpp","results":{}}',
            '{"index":"a_java","results":{}}', '{"index":null,"id":7,"results":{}}', '{"results":{},"programming_language":"PHP"}', '{"index":833,"results":{}}']
    lines = spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1)
    got = {(r.line_no, r.dimension): (r.kind, r.key, r.skipped, r.language) for r in K.task_keys(K.keyed_tasks(lines)).collect()}
    assert got[0, "robustness"][:3] == ("number", "41", True) and got[1, "robustness"][:3] == ("text", "41", False)
    assert got[3, "functionality"][2] and not got[0, "comment"][2] and got[8, "efficiency"][2]
    assert got[4, "modularity"] == ("text", "MERGED_000001_cpp", False, "cpp") and got[5, "modularity"][3] == "python"
    assert got[4, "comment"][:2] == ("number", "3") and got[4, "simplicity"][:2] == ("null", None) and got[4, "standardization"][:2] == ("number", "0")
    assert got[6, "modularity"][:2] == ("number", "7") and got[6, "standardization"][:2] == ("null", None)
    assert got[7, "modularity"] == ("number", "8", False, "php")
