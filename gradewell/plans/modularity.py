"""Modularity score (10-30, 0 without code): bands of efferent coupling (CE), afferent
coupling (CA) and cohesion (LCOM2), weighted .4/.2/.4, times six, times a size factor.

Python answers use the syntax-facts table: distinct imports, classes, methods and
their ``self.`` attributes. Cohesion compares method pairs inside one answer's
aggregated row (array functions), so no pair rows are ever emitted. Java and C++
use regex counts with fixed CA / LCOM2 values. Randomised terms of the original
are replaced by neutral constants (factor jitter 1.0, hash term 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewell.functions.text import indent, let, lines, strip
from gradewell.operators.blocks import code_blocks, longest_fence, loose_text, repaired
from gradewell.operators.explode import regroup
from gradewell.operators.extract import FENCE, INNER
from gradewell.operators.facts import code_facts
from gradewell.operators.guards import graded
from gradewell.session import checkpoint_dir

# Fence patterns tried in order (longest match of the first that qualifies); the first
# two are found line by line (operators/blocks.py).
MOD_FENCES = [r"(?s)```(?:python|java|cpp|c\+\+|javascript|js|.*?)?\s*\n([\s\S]*?)\n\s*```",
              r"(?s)```\s*\n([\s\S]*?)\n\s*```", r"(?s)```([\s\S]*?)```"]
# Language aliases of the modularity scorer (alias -> parser).
MOD_ALIASES = {
    "python": "python", "py": "python", "python3": "python", "java": "java", "cpp": "c++", "c++": "c++", "c": "c++",
    "javascript": "java", "js": "java", "typescript": "java", "ts": "java", "csharp": "java", "c#": "java",
    "php": "java", "go": "java", "ruby": "python", "rust": "c++", "swift": "java", "kotlin": "java", "scala": "java",
}
API_WORDS = r"@api|@public|public\s+interface|API|public\s+class"
JAVA_IMPORT = r"import\s+([^;]+);"
CPP_INCLUDE = r"#include\s+[<\"]([^>\"]+)[>\"]"
PY_IMPORT_RE = r"import\s+(\w+)|from\s+(\w+)\s+import"
# Neutral constants replacing random fill-ins (syntax-error path).
FALLBACK_CE, FALLBACK_CA, FALLBACK_LCOM2 = 5, 5, 0.4


def _longest(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(None).cast("string"),
                       lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc)), x).otherwise(acc))


def extract_mod(response: Column) -> Column:
    """First fence pattern whose longest match is >10 chars stripped and spans a newline; else the longest
    run of code-like lines; else the text without markup if it looks like code; else ''."""
    def fits(best):
        return let(best, lambda b: F.when((F.length(strip(b)) > 10) & b.contains("\n"), strip(b)))
    fences = [longest_fence(response, False), longest_fence(response, True), _longest(F.regexp_extract_all(response, F.lit(f"```{INNER}```"), 1))]
    fenced = F.when(response.contains(FENCE), F.coalesce(*map(fits, fences)))
    return F.coalesce(fenced, code_blocks(response), loose_text(response), F.lit(""))


def mod_language(field: Column) -> Column:
    low = F.lower(F.coalesce(field, F.lit("")))
    m = F.create_map(*[F.lit(x) for kv in MOD_ALIASES.items() for x in kv])
    return F.when(low == "", "python").otherwise(F.coalesce(m[low], F.lit("python")))


def complexity_factor(code: Column) -> Column:
    cl = F.filter(lines(code), lambda l: (strip(l) != "") & ~strip(l).startswith("#"))
    n = F.size(cl)
    max_indent = F.coalesce(F.array_max(F.transform(cl, indent)),
                            F.lit(0))
    funcs = F.regexp_count(code, F.lit(r"def\s+\w+\s*\("))
    classes = F.regexp_count(code, F.lit(r"class\s+\w+"))
    f = F.when(n < 20, F.lit(0.85)).when(n > 100, F.lit(1.05)).otherwise(F.lit(1.0))
    f = f * F.when(max_indent > 16, F.lit(0.95)).otherwise(F.lit(1.0))
    f = f * F.when((funcs > 5) | (classes > 2), F.lit(1.08)).when((funcs <= 1) & (classes == 0), F.lit(0.9)).otherwise(F.lit(1.0))
    return f


def feature_metrics(imports: Column, code: Column) -> list[Column]:
    """CE, CA and LCOM2 estimated from a text that no parser takes."""
    funcs, classes = F.regexp_count(code, F.lit(r"(?U)def\s+\w+\s*\(")), F.regexp_count(code, F.lit(r"(?U)class\s+\w+"))
    ce = F.when(imports > 0, imports).otherwise(F.greatest(F.lit(1), F.least(F.lit(15), F.floor(F.size(lines(code)) / 20))))
    ca = (F.lit(4) + F.when(classes > 0, F.least(classes * 2, F.lit(6))).otherwise(0)
          + F.when(funcs > 3, F.least(F.floor(funcs / 2), F.lit(4))).otherwise(0))
    each = funcs / F.greatest(classes, F.lit(1))
    lcom2 = F.when(classes == 0, 0.4 + funcs / 20).when(each < 3, F.lit(0.2)).otherwise(0.3 + each / 20)
    return [ce.cast("long").alias("feature_ce"), ca.cast("long").alias("feature_ca"),
            F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.9), lcom2)), 6).alias("feature_lcom2")]


def modularity_inputs(responses: DataFrame, own_only: bool = False) -> DataFrame:
    """Per answer: code, what is parsed of it, parser language, size factor, the regex metrics and the
    estimates for code that no parser takes (all SQL-expressible); ``own_only``: those that the language reads."""
    def own(lang, metric):
        return F.when(F.col("lang") == lang, metric) if own_only else metric
    r = responses.select("idx", "pos", "model", "programming_language",
                         mod_language(F.col("programming_language")).alias("lang"),
                         extract_mod(F.col("response")).alias("code"))
    r = r.select("*", F.when(F.col("lang") == "python", repaired(F.col("code"))).otherwise(F.col("code")).alias("parsed_code"))
    c, p = F.col("code"), F.col("parsed_code")
    py_imports = F.array_distinct(F.filter(F.concat(F.regexp_extract_all(p, F.lit(PY_IMPORT_RE), 1),
                                                    F.regexp_extract_all(p, F.lit(PY_IMPORT_RE), 2)), lambda x: x != ""))
    return r.select(
        "*", F.round(complexity_factor(c), 6).alias("factor"),
        own("java", F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(JAVA_IMPORT), 1))).cast("long")).alias("java_ce"),
        own("c++", F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(CPP_INCLUDE), 1))).cast("long")).alias("cpp_ce"),
        own("python", F.size(py_imports).cast("long")).alias("py_regex_ce"),
        own("python", F.regexp_count(p, F.lit(r"def\s+(\w+)\s*\(")).cast("long")).alias("def_count"),
        own("python", p.rlike(API_WORDS)).alias("api_words"),
        *(own("python", m).alias(n) for m, n in zip(feature_metrics(F.size(py_imports), p), ("feature_ce", "feature_ca", "feature_lcom2"))))


def balance_repair(responses: DataFrame) -> DataFrame:
    """Per Python answer: its code's lines, how many the repair drops, and the brackets that it adds."""
    m = modularity_inputs(responses).where("lang = 'python'").select("idx", "model", "code", "parsed_code")
    tail = lambda x: F.length(x) - F.length(F.rtrim(x, F.lit(")")))
    return m.select("idx", "model", "parsed_code", F.size(lines(F.col("code"))).cast("long").alias("code_lines"),
                    (F.size(lines(F.col("code"))) - F.size(lines(F.col("parsed_code")))).cast("long").alias("dropped_lines"),
                    tail(F.col("parsed_code")).cast("long").alias("closing_brackets"))


def python_structure(facts: DataFrame) -> DataFrame:
    """Per answer from facts: parses, CE, class/method counts, LCOM2 (classes) or function cohesion."""
    k = F.col("kind")
    meth = facts.filter((k == "FunctionDef") & (F.col("parent_kind") == "ClassDef")) \
        .select("idx", "model", F.col("parent_id").alias("class_id"), F.col("node_id").alias("fid"))
    attrs = facts.filter((k == "Attribute") & (F.col("base") == "self")) \
        .select("idx", "model", "name", F.explode("func_path").alias("fid")) \
        .groupBy("idx", "model", "fid").agg(F.collect_set("name").alias("attrs"))
    loads = facts.filter((k == "Name") & (F.col("ctx") == "Load")) \
        .select("idx", "model", "name", F.explode("func_path").alias("fid")) \
        .groupBy("idx", "model", "fid").agg(F.collect_set("name").alias("loads"))
    funcs = facts.filter(k == "FunctionDef").select("idx", "model", F.col("node_id").alias("fid"))
    m = meth.join(attrs, ["idx", "model", "fid"], "left") \
        .groupBy("idx", "model", "class_id") \
        .agg(F.collect_list(F.coalesce(F.col("attrs"), F.array().cast("array<string>"))).alias("ms"))
    f = funcs.join(loads, ["idx", "model", "fid"], "left").groupBy("idx", "model") \
        .agg(F.collect_list(F.coalesce(F.col("loads"), F.array().cast("array<string>"))).alias("fs"))
    base = facts.groupBy("idx", "model").agg(
        (F.count_if(k.isin("SyntaxError", "ParseError")) == 0).alias("parses"),
        (F.count_if(k == "ParseError") > 0).alias("unparsable"),
        F.count_distinct(F.when(((k == "alias") & (F.col("parent_kind") == "Import")) | (k == "ImportFrom"),
                                F.col("name"))).alias("ce"),
        F.count_if(k == "ClassDef").alias("n_classes"))
    per_class = m.select("idx", "model", F.size("ms").alias("n_methods"), _disjoint_share(F.col("ms"), 0.0).alias("lcom2"))
    cls_agg = per_class.groupBy("idx", "model").agg(F.sum("n_methods").alias("class_methods"), F.sum("lcom2").alias("lcom2_sum"))
    out = base.join(cls_agg, ["idx", "model"], "left").join(f, ["idx", "model"], "left")
    return out.select("idx", "model", "parses", "unparsable", "ce", "n_classes", F.coalesce("class_methods", F.lit(0)).alias("class_methods"),
                      F.when(F.col("n_classes") > 0, F.coalesce("lcom2_sum", F.lit(0.0)) / F.col("n_classes"))
                      .otherwise(_disjoint_share(F.coalesce(F.col("fs"), F.array().cast("array<array<string>>")), 0.3))
                      .alias("lcom2"))


def _disjoint_share(sets: Column, few: float) -> Column:
    """Share of (i < j) pairs whose sets do not overlap; ``few`` when fewer than two sets.
    Computed inside one answer's row (bounded by that answer's size)."""
    n = F.size(sets)
    idx = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    disjoint = F.aggregate(idx, F.lit(0), lambda acc, i: acc + F.size(F.filter(
        F.slice(sets, i + 1, F.greatest(n - i, F.lit(0))), lambda s: ~F.arrays_overlap(F.element_at(sets, i), s)
        | (F.size(s) == 0) | (F.size(F.element_at(sets, i)) == 0))))
    total = n * (n - 1) / 2
    return F.when(n < 2, F.lit(few)).otherwise(disjoint / total)


def ce_band(ce: Column) -> Column:
    return F.when(ce <= 5, 5).when(ce <= 8, 4).when(ce <= 12, 3).when(ce <= 15, 2).otherwise(1)


def ca_band(ca: Column) -> Column:
    return (F.when((ca >= 3) & (ca <= 7), 5).when((ca >= 8) & (ca <= 10), 4).when((ca >= 11) & (ca <= 14), 3)
            .when((ca >= 1) & (ca <= 2), 2).otherwise(1))


def lcom2_band(v: Column) -> Column:
    return F.when(v <= 0.2, 5).when(v <= 0.35, 4).when(v <= 0.5, 3).when(v <= 0.7, 2).otherwise(1)


def score_modularity(responses: DataFrame) -> DataFrame:
    return graded_modularity(responses).drop("reason", "raw")


def modularity_rungs() -> list:
    return [("no_code", F.col("no_code"), 0.0)]


def graded_modularity(responses: DataFrame) -> DataFrame:
    checkpoint_dir(responses.sparkSession)
    inp = modularity_inputs(responses, own_only=True).checkpoint()  # read by the facts and by the score
    py = inp.filter((F.col("lang") == "python") & (F.col("code") != "")).select("idx", "model", F.col("parsed_code").alias("code"))
    st = python_structure(code_facts(py).checkpoint())  # five aggregations read the facts; the trees are walked once
    j = inp.select("idx", "pos", "model", "programming_language", "lang", (F.col("code") == "").alias("no_code"),
                   "factor", "java_ce", "cpp_ce", "py_regex_ce", "def_count", "api_words", "feature_ce", "feature_ca", "feature_lcom2") \
        .join(st, ["idx", "model"], "left")
    lg = F.col("lang")
    parsed = (lg == "python") & F.coalesce(F.col("parses"), F.lit(False))
    guessed = (lg == "python") & F.coalesce(F.col("unparsable"), F.lit(False))
    methods = F.when(F.col("n_classes") > 0, F.col("class_methods")).otherwise(F.col("def_count"))
    ca_py = F.greatest(F.lit(1), F.lit(4) + F.when(F.col("n_classes") > 2, F.col("n_classes")).otherwise(0)
                       + F.when(methods > 5, F.least(F.floor(methods / 3), F.lit(5))).otherwise(0)
                       + F.when(F.col("api_words"), 2).otherwise(0))
    ce = (F.when(parsed, F.col("ce")).when(guessed, F.col("feature_ce")).when(lg == "python", F.when(F.col("py_regex_ce") > 0, F.col("py_regex_ce"))
                                           .otherwise(FALLBACK_CE))
          .when(lg == "java", F.col("java_ce")).otherwise(F.col("cpp_ce")))
    ca = F.when(parsed, ca_py).when(guessed, F.col("feature_ca")).when(lg == "python", F.lit(FALLBACK_CA)).when(lg == "java", F.lit(6)).otherwise(F.lit(4))
    lcom = (F.when(parsed, F.col("lcom2")).when(guessed, F.col("feature_lcom2")).when(lg == "python", F.lit(FALLBACK_LCOM2))
            .when(lg == "java", F.lit(0.3)).otherwise(F.lit(0.4)))
    base = ce_band(ce) * 0.4 + ca_band(ca) * 0.2 + lcom2_band(lcom) * 0.4
    total = F.greatest(F.lit(10.0), F.least(F.lit(30.0), F.round(base * 6 * F.col("factor"), 1)))
    return j.select("idx", "pos", "model", lg.alias("programming_language"),
                    *graded(modularity_rungs(), total))


def modularity_report(responses: DataFrame) -> DataFrame:
    return regroup(score_modularity(responses))
