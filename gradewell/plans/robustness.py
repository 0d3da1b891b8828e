"""Robustness score (0-30): mean of a maintainability estimate and a 50-100 robustness
tally (error handling, input validation, resource management), mapped to 30."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradewell.functions.text import strip
from gradewell.operators.explode import regroup
from gradewell.operators.extract import extract_rob
from gradewell.operators.metrics import (MI_WORDS, braces_balanced, error_handling, input_validation,
                                         lang_feature_vote, mi_estimate, resource_mgmt)
from gradewell.operators.guards import graded
from gradewell.operators.rules import ROB_BLOCKLIST

# Fixed value: the mixed-language label some task files carry.
MIXED_LABEL = "python或Java或C++"


def lang_choice_rob(field: F.Column, code: F.Column) -> F.Column:
    """Detect from code when the field is empty, mixed, or names python/java/c++; else the field.

    Then c++/c -> cpp; anything outside python/java/cpp is 'unknown'."""
    low = F.lower(F.coalesce(field, F.lit("")))
    detect = (low == "") | (F.coalesce(field, F.lit("")) == MIXED_LABEL) | low.contains("python") \
        | low.contains("java") | low.contains("c++")
    lang = F.when(detect, lang_feature_vote(code)).otherwise(low)
    return (F.when(lang.isin("c++", "c", "cpp"), "cpp").when(lang.isin("python", "java"), lang)
            .otherwise("unknown"))


def robustness_components(responses: DataFrame, own_only: bool = False) -> DataFrame:
    """Every SQL-expressible input of the score, per answer; ``own_only``: of the estimates the one that the
    answer's language reads."""
    r = responses.select("idx", "pos", "model", "programming_language", "response",
                         extract_rob(F.col("response")).alias("code"))
    r = r.select("*", lang_choice_rob(F.col("programming_language"), F.col("code")).alias("lang"))
    c, lg = F.col("code"), F.col("lang")
    own = (lambda known, estimate: F.when(known, estimate)) if own_only else (lambda known, estimate: estimate)
    return r.select(
        "idx", "pos", "model", "programming_language", "lang", "code",
        (F.length(strip(c)) < 20).alias("too_short"),
        error_handling(c, lg).cast("int").alias("error_handling"),
        input_validation(c, lg).cast("int").alias("input_validation"),
        resource_mgmt(c, lg).cast("int").alias("resource_mgmt"),
        own(lg == "python", mi_estimate(c, MI_WORDS["python_fallback"])).alias("mi_python_fallback"),
        own(lg == "java", F.when(braces_balanced(c), mi_estimate(c, MI_WORDS["java_parsed"]))
            .otherwise(mi_estimate(c, MI_WORDS["short"]))).alias("mi_java"),
        own(~lg.isin("python", "java"), mi_estimate(c, MI_WORDS["short"])).alias("mi_cpp"))


def graded_robustness(responses: DataFrame, py_facts: DataFrame | None = None,
                      comp: DataFrame | None = None) -> DataFrame:
    """Final score. ``py_facts`` (idx, model, parses, mi) supplies the Python-parse branch;
    without it every Python answer takes the syntax-error estimate."""
    comp = robustness_components(responses) if comp is None else comp
    # A NULL answer extracts to '' and scores 0 like any answer without code; the
    # text itself never crosses the join below.
    comp = comp.select("idx", "pos", "model", "programming_language", "lang", (F.col("code") == "").alias("no_code"),
                       "too_short", "error_handling", "input_validation", "resource_mgmt", "mi_python_fallback",
                       "mi_java", "mi_cpp")
    if py_facts is not None:
        comp = comp.join(py_facts.select("idx", "model", "parses", F.col("mi").alias("mi_parsed")),
                         ["idx", "model"], "left")
    else:
        comp = comp.select("*", F.lit(False).alias("parses"), F.lit(None).cast("double").alias("mi_parsed"))
    lg = F.col("lang")
    mi = (F.when(lg == "python", F.when(F.col("parses"), F.least(F.round(F.col("mi_parsed"), 1), F.lit(100.0)))
                 .otherwise(F.col("mi_python_fallback")))
          .when(lg == "java", F.col("mi_java")).otherwise(F.col("mi_cpp")))
    rob = F.least(F.lit(50) + F.col("error_handling") + F.col("input_validation") + F.col("resource_mgmt"), F.lit(100))
    final = F.round((mi + rob) / 2 / 100 * 30, 1)
    rungs = [*robustness_rungs(), ("no_maintainability", mi <= 0, 0.0)]
    return comp.select("idx", "pos", "model", "programming_language", *graded(rungs, final))


def robustness_rungs() -> list:
    return [("skipped_task", F.col("idx").isin(*ROB_BLOCKLIST), 0.0), ("no_code", F.col("no_code"), 0.0),
            ("too_short", F.col("too_short"), 0.0), ("unknown_language", F.col("lang") == "unknown", 0.0)]


def score_robustness(responses: DataFrame, py_facts: DataFrame | None = None, comp: DataFrame | None = None) -> DataFrame:
    return graded_robustness(responses, py_facts, comp).drop("reason", "raw")


def python_mi(responses: DataFrame, comp: DataFrame | None = None) -> DataFrame:
    """(idx, model, parses, mi) for the answers the robustness score reads as Python."""
    from gradewell.functions.text import lines
    from gradewell.operators.facts import code_facts, maintainability_facts
    comp = robustness_components(responses) if comp is None else comp
    comp = comp.filter((F.col("lang") == "python") & (F.col("code") != ""))
    comp = comp.select("idx", "model", "code")
    comments = comp.select("idx", "model", F.size(F.filter(lines(F.col("code")), lambda l: strip(l).startswith("#")))
                           .alias("n_comment_lines"))
    return maintainability_facts(code_facts(comp), comments)


def score_robustness_full(responses: DataFrame) -> DataFrame:
    """Components are computed once and cut from their lineage (reliable checkpoint in the
    shared checkpoint dir): the score, the facts stage and the comment counts all read them."""
    from gradewell.session import checkpoint_dir
    checkpoint_dir(responses.sparkSession)
    comp = robustness_components(responses, own_only=True).checkpoint(eager=True)
    return score_robustness(responses, python_mi(responses, comp), comp)


def robustness_report(responses: DataFrame) -> DataFrame:
    return regroup(score_robustness_full(responses))
