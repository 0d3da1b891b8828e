"""Why answers got their scores: the guards that decide before anything is measured, counted per dimension.

The ladders are those of the seven plans (``operators/guards.py``). Rungs that need a syntax tree
(``unparsable``, ``no_maintainability``) stand in the plans' graded frames only; such answers count as
``scored`` here, so that the report needs no tree and no join of texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gradewell.functions.text import nonempty
from gradewell.operators.explode import tasks_from_responses
from gradewell.operators.guards import reason
from gradewell.plans import comment, efficiency, functionality, modularity, robustness, simplicity, standardization
from gradewell.sources.corpus import responses


def _functionality(tasks: DataFrame) -> DataFrame:
    """The task's guard comes first: it holds for all of its answers if it holds for one."""
    comp = functionality.functionality_components(tasks)
    guarded = comp.groupBy("idx").agg(F.max("instr_guard").alias("guard"))
    flags = {c: F.col(c) for c in ("has_code", "divzero", "too_long")}
    return comp.join(guarded, "idx").select(reason([*functionality.task_rungs(F.col("guard")), *functionality.answer_rungs(flags)]).alias("reason"))


def _standardization(r: DataFrame) -> DataFrame:
    omitted = r.where(~nonempty(F.col("response"))).select(F.lit("empty_answer").alias("reason"))
    return standardization.graded_standardization(r).select("reason").unionAll(omitted)


def score_reasons(spark, sf_dir: str) -> DataFrame:
    """dimension, reason, n_answers."""
    r = responses(spark, sf_dir)
    tasks = tasks_from_responses(r)
    no_code = (F.col("code") == "").alias("no_code")
    rob = robustness.robustness_components(r).select("idx", no_code, "too_short", "lang")
    eff = efficiency.efficiency_inputs(r).select("idx", no_code, F.coalesce(F.col("response").startswith("Error:"), F.lit(False)).alias("is_error"))
    mod = r.select((modularity.extract_mod(F.col("response")) == "").alias("no_code"))
    parts = {
        "functionality": _functionality(tasks),
        "modularity": mod.select(reason(modularity.modularity_rungs()).alias("reason")),
        "simplicity": simplicity.graded_simplicity(tasks).select("reason"),
        "standardization": _standardization(r),
        "robustness": rob.select(reason(robustness.robustness_rungs()).alias("reason")),
        "efficiency": eff.select(reason(efficiency.efficiency_rungs()).alias("reason")),
        "comment": comment.graded_comment(r).select("reason"),
    }
    rows = reduce(DataFrame.unionAll, (p.select(F.lit(d).alias("dimension"), "reason") for d, p in parts.items()))
    return rows.groupBy("dimension", "reason").agg(F.count(F.lit(1)).alias("n_answers"))
