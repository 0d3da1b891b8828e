"""Simplicity score (0-30): band of an estimated maintainability index, times six."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradewell.functions.text import nonempty
from gradewell.operators.explode import explode_models, regroup
from gradewell.operators.extract import extract_sim
from gradewell.operators.guards import graded
from gradewell.operators.metrics import cc_sim, halstead_est, loc_sim, mi_band, mi_sim


def lang_base_only(results: F.Column) -> F.Column:
    """Task language from the ``base`` answer only: java, c++ or python."""
    base = F.coalesce(results.getItem("base"), F.lit(""))
    return (F.when(base.contains("```java") | base.contains("import java."), "java")
            .when(base.contains("```c++") | base.contains("#include"), "c++")
            .otherwise("python"))


def simplicity_metrics(tasks: DataFrame) -> DataFrame:
    """Per answer: code, loc, cc, hv, mi, band. Language is fixed per task before exploding."""
    t = tasks.select("idx", "results", lang_base_only(F.col("results")).alias("programming_language"))
    r = explode_models(t)
    code = extract_sim(F.col("response"), F.col("programming_language"))
    r = r.select("idx", "pos", "model", "programming_language", "response", code.alias("code"))
    loc, cc = loc_sim(F.col("code")), cc_sim(F.col("code"), F.col("programming_language"))
    r = r.select("*", loc.alias("loc"), cc.alias("cc"))
    r = r.select("*", halstead_est(F.col("loc")).alias("hv"))
    return r.select("*", mi_sim(F.col("loc"), F.col("cc"), F.col("hv")).alias("mi"))


def graded_simplicity(tasks: DataFrame) -> DataFrame:
    m = simplicity_metrics(tasks)
    rungs = [("empty_answer", ~nonempty(F.col("response")), 0.0), ("no_code", F.col("code") == "", 0.0)]
    return m.select("idx", "pos", "model", "programming_language", *graded(rungs, F.round(mi_band(F.col("mi")) * 6, 1)))


def score_simplicity(tasks: DataFrame) -> DataFrame:
    return graded_simplicity(tasks).drop("reason", "raw")


def simplicity_report(tasks: DataFrame) -> DataFrame:
    return regroup(score_simplicity(tasks))
