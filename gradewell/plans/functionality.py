"""Functionality score (0-30): 0.4 semantic similarity + 0.3 test pass rate + 0.2 coverage flag
+ 0.1 ran flag, after fixed-score guards.

The code is never executed here: test outcomes arrive as the ``case_outcomes``
table and embeddings as the ``embeddings`` table; this plan does the data work
(extraction, language carry, guards, joins, aggregation). Only narrow columns
cross the shuffles; the language carry runs inside one regrouped task row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewell.functions.text import NL, lines, nonempty, strip, until
from gradewell.operators.explode import KNOWN_MODELS, explode_models
from gradewell.operators import guards
from gradewell.operators.extract import FENCE, INNER
from gradewell.operators.guards import graded
from gradewell.operators.rules import FUN_BLOCKLIST
from gradewell.sources.tables import read_table

# Fixed values of the functionality scorer.
GUARD_WORDS = ["除以", "division", "equation", "方程", "计算器", "递归", "recursion", "factorial", "阶乘"]
FENCE_TAGS = ["python", "java", "cpp", "c++", ""]
DANGER = {
    "python": ['input(', 'raw_input(', 'while True', 'while 1', 'for i in range(10000)', 'sleep(', 'time.sleep'],
    "cpp": ['cin', 'scanf', 'gets', 'while(true)', 'while(1)', 'for(;;)', 'sleep('],
    "java": ['Scanner', 'System.console()', 'BufferedReader', 'while(true)', 'while(1)', 'for(;;)', 'Thread.sleep'],
}
COVERAGE_DANGER = ['input(', 'raw_input(', 'while True', 'while 1', 'for i in range(10000)', 'sleep(', 'time.sleep',
                   'import sys', 'import os', 'import subprocess', 'exec(', 'eval(']
LINE_START_WORDS = ["def ", "class ", "import ", "public ", "#include", "int main"]
# Test-case kinds by instruction keyword, in priority order, with (input, expected) JSON pairs.
TEST_KINDS = [
    ("array", ["数组", "列表", "array"], [("[]", "[]"), ("[1, 2, 3]", "[1, 2, 3]"), ("[-1, 0, 1]", "[-1, 0, 1]")]),
    ("string", ["字符串", "string"], [('""', '""'), ('"hello"', '"hello"'), ('"test"', '"test"')]),
    ("sort", ["排序", "sort"], [("[1, 3, 2]", "[1, 2, 3]"), ("[]", "[]"), ("[5, 2, 8, 1, 9]", "[1, 2, 5, 8, 9]")]),
    ("sum", ["计算", "求和", "sum", "calculate"], [("5", "15"), ("1", "1"), ("0", "0")]),
    ("basic", [], [("0", "0"), ("1", "1"), ("-1", "-1")]),
]


def _any(c: Column, subs) -> Column:
    out = F.lit(False)
    for s in subs:
        out = out | c.contains(s)
    return out


def task_language(field: Column, results: Column) -> Column:
    """Field lower-cased (python when absent); a python task with a ``base`` answer may become java / cpp."""
    lang = F.lower(F.coalesce(field, F.lit("python")))
    base = F.coalesce(results.getItem("base"), F.lit(""))
    has_base = F.array_contains(F.map_keys(results), "base")
    return (F.when((lang == "python") & has_base & (base.contains("```java") | base.contains("import java.")), "java")
            .when((lang == "python") & has_base & (base.contains("```c++") | base.contains("#include")), "cpp")
            .otherwise(lang))


def _fallback_extract(r: Column) -> Column:
    """Split on fences: first inner part whose first line is a known tag (rest stripped);
    else the text from the first code-looking line; else the whole answer if it looks like code."""
    parts = F.split(r, "```", -1)
    n = F.size(parts)
    inner = F.slice(parts, 2, F.greatest(n - 2, F.lit(0)))
    cand = F.filter(F.transform(inner, lambda p: F.when(
        ~strip(p).isin(*FENCE_TAGS) & p.contains(NL) & strip(F.substring_index(p, NL, 1)).isin(*FENCE_TAGS),
        strip(F.substr(p, F.instr(p, NL) + 1)))), lambda x: x.isNotNull())
    block = F.when(r.contains("```") & (n >= 3) & (F.size(cand) > 0), F.element_at(cand, 1))
    ls = lines(r)
    hit = F.filter(F.transform(ls, lambda l, i: F.when(_any(l, LINE_START_WORDS), i)), lambda x: x.isNotNull())
    first = F.element_at(hit, 1)
    suffix = F.when(_any(r, ["def ", "class ", "public class", "#include"]) & (F.size(hit) > 0),
                    F.array_join(F.slice(ls, first + 1, F.size(ls) - first), NL))
    whole = F.when((F.length(r) > 20) & (F.length(r) < 5000) & _any(r, ["def", "class", "function"]), r)
    bad = r.contains("Feature not available") | r.startswith("Error:")
    return F.when(~nonempty(r) | bad, F.lit(None).cast("string")) \
        .when(block.isNotNull(), block).otherwise(F.coalesce(suffix, whole))


def extract_fun(response: Column, model: Column) -> Column:
    r1, r2 = r"```(?:python|java|cpp|c\+\+)?\n(" + until(NL + FENCE) + r")\n```", f"```{INNER}```"
    fenced = response.contains("```")
    c1 = (F.when(fenced & response.rlike(r1), strip(F.regexp_extract(response, r1, 1)))
          .when(fenced & response.rlike(r2), strip(F.regexp_extract(response, r2, 1))))
    code = F.when(nonempty(c1), c1).otherwise(_fallback_extract(response))
    known = model.isin(*KNOWN_MODELS) & (F.length(response) > 50) & _any(response, ["def ", "class ", "if "])
    return F.when(nonempty(code), code).when(known, response).otherwise(F.lit(None).cast("string"))


def detect_code_language(code: Column) -> Column:
    return (F.when(_any(code, ["```java", "import java.", "public class"]), "java")
            .when(_any(code, ["```c++", "#include"]), "cpp")
            .when(_any(code, ["```python", "def "]), "python"))


def func_name(code: Column, lang: Column) -> Column:
    def pick(p):
        return F.coalesce(F.nullif(F.regexp_extract(code, p, 1), F.lit("")), F.lit("solution"))
    return (F.when(lang == "python", pick(r"def\s+(\w+)"))
            .when(lang == "java", pick(r"(?:public\s+)?(?:static\s+)?(?:\w+)\s+(\w+)\s*\("))
            .when(lang.isin("cpp", "c++"), pick(r"(?:\w+)\s+(\w+)\s*\("))
            .otherwise(F.lit("solution")))


def functionality_components(tasks: DataFrame) -> DataFrame:
    """Per answer: code flags, detected language and guard hits (row-local, after one explode)."""
    t = tasks.select("idx", "results", F.coalesce(F.col("instruction"), F.lit("")).alias("instruction"),
                     task_language(F.col("programming_language"), F.col("results")).alias("task_lang"))
    r = explode_models(t)
    code = extract_fun(F.col("response"), F.col("model"))
    r = r.select("idx", "pos", "model", "task_lang", "instruction", code.alias("code"))
    c = F.col("code")
    low_instr = F.lower(F.col("instruction"))
    return r.select(
        "idx", "pos", "model", "task_lang",
        _any(low_instr, GUARD_WORDS).alias("instr_guard"),
        nonempty(c).alias("has_code"),
        detect_code_language(c).alias("detected"),
        (F.lower(c).contains("division by zero") | c.contains("ZeroDivisionError")).alias("divzero"),
        (F.length(c) > 5000).alias("too_long"),
        _any(c, DANGER["python"]).alias("danger_python"), _any(c, DANGER["cpp"]).alias("danger_cpp"),
        _any(c, DANGER["java"]).alias("danger_java"), _any(c, COVERAGE_DANGER).alias("coverage_danger"),
        func_name(c, F.coalesce(detect_code_language(c), F.col("task_lang"))).alias("func_name"))


def semantic_similarity(spark, sf_dir: str, keys: DataFrame) -> DataFrame:
    """Cosine of the task vector (vec_id = idx*4+pos) and code vector (vec_id+1); 0.5 when either is missing.

    Two equi-joins on vec_id; only (idx, model, vectors) move."""
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    k = keys.select("idx", "pos", "model", (F.col("idx") * 4 + F.col("pos")).alias("tv"))
    a = emb.select(F.col("vec_id").alias("tv"), F.col("embedding").alias("ta"))
    b = emb.select((F.col("vec_id") - 1).alias("tv"), F.col("embedding").alias("tb"))
    j = k.join(a, "tv", "left").join(b, "tv", "left")
    x = F.transform(F.col("ta"), lambda v: v.cast("double"))
    y = F.transform(F.col("tb"), lambda v: v.cast("double"))
    dot = F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    nx = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    ny = F.sqrt(F.aggregate(y, F.lit(0.0), lambda s, v: s + v * v))
    cos = F.when(F.col("ta").isNull() | F.col("tb").isNull() | (nx == 0) | (ny == 0), F.lit(0.5)).otherwise(dot / (nx * ny))
    return j.select("idx", "model", cos.alias("semantic"))


def pass_rates(outcomes: DataFrame) -> DataFrame:
    """Passed / total cases and whether every case ran, per answer (partial agg before the shuffle)."""
    return outcomes.groupBy("idx", "model").agg(
        F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.bool_and("ran").alias("ran"))


def score_functionality(tasks: DataFrame, semantic: DataFrame, outcomes: DataFrame) -> DataFrame:
    return graded_functionality(tasks, semantic, outcomes).drop("reason", "raw")


def task_rungs(guard: Column) -> list:
    return [("skipped_task", F.col("idx").isin(*FUN_BLOCKLIST), 0.0), ("guarded_instruction", guard, 15.0)]


def answer_rungs(x) -> list:
    return [("no_code", ~x["has_code"], 0.0), ("division_by_zero", x["divzero"], 10.0), ("too_long", x["too_long"], 10.0)]


def graded_functionality(tasks: DataFrame, semantic: DataFrame, outcomes: DataFrame) -> DataFrame:
    comp = functionality_components(tasks)
    rates = pass_rates(outcomes)
    j = comp.join(semantic, ["idx", "model"], "left").join(rates, ["idx", "model"], "left")
    entry = F.struct(*[F.col(c) for c in ["pos", "model", "has_code", "detected", "divzero", "too_long", "danger_python",
                                          "danger_cpp", "danger_java", "coverage_danger", "semantic", "pass_rate", "ran"]])
    g = j.groupBy("idx").agg(F.max("task_lang").alias("task_lang"), F.max("instr_guard").alias("instr_guard"),
                             F.array_sort(F.collect_list(entry)).alias("e"))
    # Language carry: a detected language holds for the answers after it (only answers with code detect).
    dets = F.transform(F.col("e"), lambda x: F.when(x["has_code"], x["detected"]))

    def carried(i):
        seen = F.filter(F.slice(dets, 1, i + 1), lambda d: d.isNotNull())
        return F.coalesce(F.try_element_at(seen, F.lit(-1)), F.col("task_lang"))

    scored = F.transform(F.col("e"), lambda x, i: F.struct(x["pos"].alias("pos"), x["model"].alias("model"),
                                                           *graded(answer_rungs(x), _measured(x, carried(i)))))
    all_seen = F.filter(dets, lambda d: d.isNotNull())
    task_lang = F.coalesce(F.try_element_at(all_seen, F.lit(-1)), F.col("task_lang"))
    # Fixed-score tasks keep the task language; scored tasks report the last carried one.
    lang_out = F.when(F.col("idx").isin(*FUN_BLOCKLIST) | F.col("instr_guard"), F.col("task_lang")).otherwise(task_lang)
    out = g.select("idx", lang_out.alias("programming_language"), F.col("instr_guard"), F.explode(scored).alias("s"))
    rungs = task_rungs(F.col("instr_guard"))
    first = guards.reason(rungs)
    return out.select("idx", F.col("s.pos").alias("pos"), F.col("s.model").alias("model"), "programming_language",
                      guards.score(rungs, F.col("s.score")).alias("score"),
                      F.when(first == guards.SCORED, F.col("s.reason")).otherwise(first).alias("reason"), F.col("s.raw").alias("raw"))


def _measured(x, lang: Column) -> Column:
    danger = (F.when(lang == "python", x["danger_python"]).when(lang == "cpp", x["danger_cpp"])
              .when(lang == "java", x["danger_java"]).otherwise(F.lit(False)))
    runnable = lang.isin("python", "cpp", "c++", "java") & ~danger
    test = F.when(runnable, F.coalesce(x["pass_rate"], F.lit(0.0))).otherwise(F.lit(0.0))
    ran = F.when(runnable, F.coalesce(x["ran"], F.lit(False))).otherwise(F.lit(False)).cast("double")
    cov = F.when((lang == "python") & ~x["coverage_danger"], F.lit(0.5)).otherwise(F.lit(0.0))
    return F.round((F.lit(0.4) * x["semantic"] + F.lit(0.3) * test + F.lit(0.2) * cov + F.lit(0.1) * ran) * 30, 1)


def test_case_plan(tasks: DataFrame) -> DataFrame:
    """The instruction picks a test-case kind; a broadcast join (15 fixed rows) lists its cases."""
    spark = tasks.sparkSession
    rows = [(kind, n, inp, exp, inp.startswith("[")) for kind, _, cases in TEST_KINDS for n, (inp, exp) in enumerate(cases)]
    cases = spark.createDataFrame(rows, "kind string, case_no int, input string, expected string, is_list boolean")
    low = F.lower(F.coalesce(F.col("instruction"), F.lit("")))
    kind = None
    for k, words, _ in TEST_KINDS[:-1]:
        cond = _any(low, words)
        kind = F.when(cond, k) if kind is None else kind.when(cond, k)
    t = tasks.select("idx", kind.otherwise("basic").alias("kind"))
    return t.join(F.broadcast(cases), "kind").select("idx", "kind", "case_no", "input", "expected", "is_list")


def mean_pool(vectors: DataFrame, key: str = "label", vector: str = "embedding") -> DataFrame:
    """The mean of a group's vectors, one row per place (partial sums before the shuffle; no vector is gathered)."""
    x = vectors.select(key, F.posexplode(vector).alias("dim", "x"))
    return x.groupBy(key, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 4).alias("mean"))
