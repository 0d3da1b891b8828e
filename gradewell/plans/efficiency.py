"""Efficiency score (0-30) from an enhanced cyclomatic complexity:
ECC = (methods + executable statements + max inputs + max outputs) / lines of code.

Java and C++ are measured with regex counts (row-local); Python with the
syntax-facts table (one mapInArrow stage, then a partial aggregation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewell.functions.text import NL, count_sub, let, lines, strip
from gradewell.operators.explode import regroup
from gradewell.operators.extract import FENCE, INNER
from gradewell.operators.facts import code_facts, efficiency_facts
from gradewell.operators.guards import graded
from gradewell.operators.rules import EFF_BLOCKLIST
from gradewell.session import checkpoint_dir

# Regexes of the Java / C++ analyzers (Python spelling).
JAVA_METHOD = r"(public|private|protected|static|\s) +[\w\<\>\[\]]+\s+(\w+) *\([^\)]*\) *(\{?|[^;])"
# The C++ method regex with its nested repetition removed: same matches, linear time.
CPP_METHOD = r"[\w*]\s+(\w+)\s*\([^)]*\)\s*[{:]"
STATEMENT_PATTERNS = [r"\bif\s*\(", r"\bfor\s*\(", r"\bwhile\s*\(", r"\bswitch\s*\(", r"\breturn\s+", r"\bthrow\s+", r"="]
PARAMS = r"\([^)]*\)"
JAVA_OUT = r"System\.out\.print"
CPP_OUT = r"std::cout|printf|cout"
RETURN = r"\breturn\s+"
EFF_TAGGED = r"(?s)```(\w+)?\n(.*?)```"
EFF_BARE = r"(?s)```(.*?)```"
TAGGED_ONE_PASS, BARE_ONE_PASS = rf"```(\w+)?\n{INNER}```", f"```{INNER}```"  # the same matches
EFF_LINE_START = [r"^\s*\w+\s*[=({:]", r"^\s*(def|class|if|for|while|import)\s+"]
GUESS = [("python", r"\bdef\s+|import\s+|class\s+.*:"), ("java", r"public\s+class|void\s+main|System\.out"),
         ("cpp", r"#include|std::|int\s+main")]


def _cnt(code: Column, pattern: str) -> Column:
    return F.regexp_count(code, F.lit("(?U)" + pattern)).cast("long")


def lang_guess(code: Column) -> Column:
    out = None
    for lang, pat in GUESS:
        out = F.when(code.rlike(pat), lang) if out is None else out.when(code.rlike(pat), lang)
    return out.otherwise("")


def extract_eff(response: Column) -> Column:
    """struct(code, tag): first tagged block; else first fence pair (tag ''); else the text from
    the first code-looking line, tag guessed from it; else ('', '')."""
    def pair(code, tag):
        return F.struct(code.alias("code"), tag.alias("tag"))

    def tagged(m):  # the match: three marks, the tag, a line end, the code, three marks
        at = F.instr(m, NL)
        return F.when(m != "", pair(F.substring(m, at + 1, F.length(m) - at - 3), F.lower(F.substring(m, F.lit(4), at - 4))))

    def tail(ls):
        like = F.transform(ls, lambda l: l.rlike(EFF_LINE_START[0]) | l.rlike(EFF_LINE_START[1]))
        suffix = let(F.array_position(like, F.lit(True)).cast("int"), lambda k: F.when(k > 0, F.array_join(F.slice(ls, k, F.size(ls)), NL)))
        return let(suffix, lambda c: F.when(c.isNotNull(), pair(c, lang_guess(c))))
    fenced = F.coalesce(let(F.regexp_extract(response, TAGGED_ONE_PASS, 0), tagged), let(
        F.regexp_extract(response, BARE_ONE_PASS, 0), lambda m: F.when(m != "", pair(F.substring(m, F.lit(4), F.length(m) - 6), F.lit("")))))
    return F.coalesce(F.when(response.contains(FENCE), fenced), let(lines(response), tail), pair(F.lit(""), F.lit("")))


def loc_eff(code: Column) -> Column:
    ls = lines(strip(code))
    return F.size(F.filter(ls, lambda l: (strip(l) != "") & ~l.rlike(r"^\s*[{}()\[\]]*\s*$"))).cast("long")


def max_inputs_regex(code: Column) -> Column:
    ps = F.regexp_extract_all(code, F.lit(PARAMS), 0)
    counts = F.transform(F.filter(ps, lambda p: F.regexp_replace(p, r"^[()]+|[()]+$", "") != ""),
                         lambda p: count_sub(p, ",") + 1)
    return F.coalesce(F.array_max(counts), F.lit(0).cast("long")).cast("long")


def _answers(responses: DataFrame) -> DataFrame:
    """Extraction, language and analyzer of every answer."""
    r = responses.select("idx", "pos", "model", "programming_language", "response",
                         F.when(F.col("response").isNull(), F.struct(F.lit("").alias("code"), F.lit("").alias("tag")))
                         .otherwise(extract_eff(F.col("response"))).alias("x"))
    field = F.coalesce(F.col("programming_language"), F.lit("python"))
    lang0 = F.when(F.col("x.tag") != "", F.col("x.tag")).otherwise(field)
    lang = F.lower(F.when(lang0 == "", lang_guess(F.col("x.code"))).otherwise(lang0))
    r = r.select("idx", "pos", "model", "programming_language", "response",
                 F.col("x.code").alias("code"), F.col("x.tag").alias("tag"), lang.alias("lang"))
    return r.select(
        "*", F.when(F.col("lang") == "python", "python").when(F.col("lang") == "java", "java")
        .when(F.col("lang").isin("cpp", "c++"), "cpp").otherwise("base").alias("analyzer"))


def _statements(c: Column) -> Column:
    return sum((_cnt(c, p) for p in STATEMENT_PATTERNS), F.lit(0).cast("long"))


def efficiency_inputs(responses: DataFrame) -> DataFrame:
    """Extraction, language and the regex metrics of every answer (all SQL-expressible)."""
    c = F.col("code")
    return _answers(responses).select(
        "*", loc_eff(c).alias("loc"),
        _cnt(c, JAVA_METHOD).alias("java_methods"), _cnt(c, CPP_METHOD).alias("cpp_methods"),
        _statements(c).alias("regex_statements"), max_inputs_regex(c).alias("regex_max_inputs"),
        (_cnt(c, JAVA_OUT) + _cnt(c, RETURN)).alias("java_outputs"),
        (_cnt(c, CPP_OUT) + _cnt(c, RETURN)).alias("cpp_outputs"))


def ecc_score(ecc: Column) -> Column:
    return F.round(F.when(ecc >= 3, 10.0).when(ecc <= 0.5, 30.0)
                   .otherwise(F.lit(30.0) - ((ecc - F.lit(0.5)) / F.lit(2.5)) * F.lit(20.0)), 1)


def risk_level(ecc: Column) -> Column:
    return F.when(ecc < 1, "low").when(ecc < 2, "medium").otherwise("high")


def regex_ecc(responses: DataFrame) -> DataFrame:
    """M13-M16 for Java and C++ answers: the enhanced complexity, its risk level and its score."""
    a = F.col("analyzer")
    inp = efficiency_inputs(responses).filter(a.isin("java", "cpp"))
    num = F.when(a == "java", F.col("java_methods") + F.col("java_outputs")).otherwise(F.col("cpp_methods") + F.col("cpp_outputs"))
    total = num + F.col("regex_statements") + F.col("regex_max_inputs")
    inp = inp.select("idx", "model", "analyzer", F.when(F.col("loc") == 0, F.lit(0.0)).otherwise(total / F.col("loc")).alias("ecc"))
    return inp.select("idx", "model", "analyzer", F.round("ecc", 6).alias("ecc"), risk_level(F.col("ecc")).alias("risk"),
                      ecc_score(F.col("ecc")).alias("ecc_score"))


def efficiency_rungs() -> list:
    return [("skipped_task", F.col("idx").isin(*EFF_BLOCKLIST), 0.0), ("error_response", F.col("is_error"), 0.0), ("no_code", F.col("no_code"), 0.0)]


def score_efficiency(responses: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    return graded_efficiency(responses, facts).drop("reason", "raw")


def graded_efficiency(responses: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Final score. Python answers join their syntax facts; unknown languages score 30. The inputs are worked out
    once and cut from their lineage: the facts and the score both read them. Of the regex metrics each answer gets
    those that its analyzer reads."""
    checkpoint_dir(responses.sparkSession)
    a, c = F.col("analyzer"), F.col("code")
    java = _cnt(c, JAVA_METHOD) + _cnt(c, JAVA_OUT) + _cnt(c, RETURN) + _statements(c) + max_inputs_regex(c)
    cpp = _cnt(c, CPP_METHOD) + _cnt(c, CPP_OUT) + _cnt(c, RETURN) + _statements(c) + max_inputs_regex(c)
    inp = _answers(responses).select(
        "idx", "pos", "model", "programming_language", "analyzer", F.when(a == "python", c).alias("code"), loc_eff(c).alias("loc"),
        F.when(a == "java", java).when(a == "cpp", cpp).alias("regex_total"),
        F.coalesce(F.col("response").startswith("Error:"), F.lit(False)).alias("is_error"), (c == "").alias("no_code")).checkpoint()
    if facts is None:
        py = inp.filter((F.col("analyzer") == "python") & (F.col("code") != "")).select("idx", "model", "code")
        facts = code_facts(py)
    ef = efficiency_facts(facts)
    # Only small columns cross the join's shuffle: flags and counts, never the text.
    j = inp.drop("code").join(ef, ["idx", "model"], "left")
    num = (F.when(a == "python", F.col("num_methods") + F.col("exec_statements") + F.col("max_inputs") + F.col("max_outputs"))
           .when(a.isin("java", "cpp"), F.col("regex_total"))
           .otherwise(F.lit(0)))
    ecc = F.when(F.col("loc") == 0, F.lit(0.0)).otherwise(num / F.col("loc"))
    rungs = [*efficiency_rungs(), ("unparsable", (a == "python") & ~F.coalesce(F.col("parses"), F.lit(False)), 0.0)]
    return j.select("idx", "pos", "model", F.coalesce(F.col("programming_language"), F.lit("python")).alias("programming_language"),
                    *graded(rungs, ecc_score(ecc)))


def efficiency_report(responses: DataFrame) -> DataFrame:
    return regroup(score_efficiency(responses))
