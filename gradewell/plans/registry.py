"""Registered queries: name -> (Spark builder over (spark, sf_dir), DuckDB oracle SQL or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gradewell.plans import oracle as O
from gradewell.plans import standardization as STD
from gradewell.plans import simplicity as SIM
from gradewell.plans import robustness as ROB
from gradewell.plans import efficiency as EFF
from gradewell.plans import comment as COM
from gradewell.plans import functionality as FUN
from gradewell.plans import modularity as MOD
from gradewell.plans import scorecard as SC
from gradewell.plans.reasons import score_reasons
from gradewell.sources import jsonl as J
from gradewell.operators.explode import dedupe_last, explode_models, regroup, tasks_from_responses
from gradewell.sources.answers import answer_kinds
from gradewell.sources.keys import key_report
from gradewell.sources.corpus import responses, case_outcomes
from gradewell.session import scratch_path
from gradewell.sources.tables import read_table

Builder = Callable[[SparkSession, str], DataFrame]


def _on_responses(fn) -> Builder:
    return lambda spark, sf_dir: fn(responses(spark, sf_dir))


def _on_tasks(fn) -> Builder:
    return lambda spark, sf_dir: fn(tasks_from_responses(responses(spark, sf_dir)))


def _sim_metrics(tasks):
    from pyspark.sql import functions as F
    m = SIM.simplicity_metrics(tasks)
    return m.select("idx", "model", "loc", "cc", F.round("hv", 6).alias("hv"), F.round("mi", 6).alias("mi"))


def _fun_semantic(spark, sf_dir):
    from pyspark.sql import functions as F
    s = FUN.semantic_similarity(spark, sf_dir, responses(spark, sf_dir).select("idx", "pos", "model"))
    return s.select("idx", "model", F.round("semantic", 6).alias("semantic"))


def _fun_score(spark, sf_dir):
    r = responses(spark, sf_dir)
    sem = FUN.semantic_similarity(spark, sf_dir, r.select("idx", "pos", "model"))
    return FUN.score_functionality(tasks_from_responses(r), sem, case_outcomes(spark, sf_dir))


def _regrouped(spark, sf_dir):
    from pyspark.sql import functions as F
    g = regroup(STD.score_standardization(responses(spark, sf_dir)))
    r = F.col("results")
    return g.select("idx", F.size(r).alias("n_models"), F.array_join(F.map_keys(r), ",").alias("models"),
                    F.aggregate(F.map_values(r), F.lit(0.0), lambda a, x: a + x).alias("total"))


def _last_answers(spark, sf_dir):
    from pyspark.sql import functions as F
    r = responses(spark, sf_dir).select("model", "idx", F.coalesce("response", F.lit("")).alias("response"), "pos")
    return dedupe_last(r, "model", "idx")


def _corpus_lines(spark, sf_dir):
    return J.task_lines(tasks_from_responses(responses(spark, sf_dir)))


def _scan_lenient(spark, sf_dir):
    t = J.scan_lenient(_corpus_lines(spark, sf_dir))
    from pyspark.sql import functions as F
    return t.select("index", "programming_language", "instruction", F.size("results").alias("n_models"))


def _error_records(spark, sf_dir):
    """Lines of four shapes by idx mod 4: a task, one without results, one whose results are a list, a list."""
    from pyspark.sql import functions as F
    i = F.col("idx").cast("string")
    shape = F.pmod(F.col("idx"), F.lit(4))
    line = (F.when(shape == 0, F.concat(F.lit('{"index":'), i, F.lit(',"results":{"base":"x"}}'))).when(shape == 1, F.concat(F.lit('{"index":"'), i, F.lit('"}')))
            .when(shape == 2, F.concat(F.lit('{"index":'), i, F.lit(',"programming_language":"Java","results":[1]}'))).otherwise(F.concat(F.lit("["), i, F.lit("]"))))
    return J.error_records(responses(spark, sf_dir).select("idx").distinct().select(line.alias("value")))


def _completeness(spark, sf_dir):
    path = scratch_path(spark, f"completeness-{uuid.uuid4().hex[:12]}")
    return J.completeness(_corpus_lines(spark, sf_dir), SIM.simplicity_report, path)


REGISTRY: dict[str, tuple[Builder, Callable[[], str] | None]] = {
    "responses": (lambda spark, sf: responses(spark, sf),
                  lambda: O.oracle_with() + "SELECT * FROM responses"),
    "score_standardization": (_on_responses(STD.score_standardization), O.score_standardization),
    "standardization_report": (_on_responses(STD.standardization_report), O.standardization_report),
    "rule_hits": (_on_responses(STD.rule_violations), O.rule_violations),
    "indent_breaks": (_on_responses(STD.indent_break_counts), O.indent_break_counts),
    "score_simplicity": (_on_tasks(SIM.score_simplicity), O.score_simplicity),
    "simplicity_metrics": (_on_tasks(_sim_metrics), O.simplicity_metrics),
    "robustness_components": (_on_responses(ROB.robustness_components), O.robustness_components),
    "score_robustness": (_on_responses(ROB.score_robustness_full), None),
    "efficiency_inputs": (_on_responses(EFF.efficiency_inputs), O.efficiency_inputs),
    "score_efficiency": (_on_responses(EFF.score_efficiency), None),
    "functionality_components": (_on_tasks(FUN.functionality_components), O.functionality_components),
    "semantic_similarity": (_fun_semantic, O.semantic_similarity),
    "pass_rate": (lambda spark, sf: FUN.pass_rates(case_outcomes(spark, sf)), O.pass_rates),
    "score_functionality": (_fun_score, O.score_functionality),
    "test_case_plan": (_on_tasks(FUN.test_case_plan), O.test_case_plan),
    "modularity_inputs": (_on_responses(MOD.modularity_inputs), O.modularity_inputs),
    "balance_repair": (_on_responses(MOD.balance_repair), O.balance_repair),
    "score_modularity": (_on_responses(MOD.score_modularity), None),
    "score_reasons": (score_reasons, O.score_reasons),
    "scorecard": (SC.scorecard, None),
    "model_ranking": (SC.model_ranking, None),
    "scan_lenient": (_scan_lenient, O.scan_lenient),
    "scan_quarantine": (lambda spark, sf: J.scan_counts(_corpus_lines(spark, sf)), O.scan_counts),
    "error_records": (_error_records, O.error_records),
    "code_languages": (_on_responses(STD.code_languages), O.code_languages),
    "task_keys": (_on_responses(key_report), O.task_keys),
    "answer_kinds": (_on_responses(answer_kinds), O.answer_kinds),
    "completeness_check": (_completeness, O.completeness_check),
    "comment_metrics": (_on_responses(COM.comment_metrics), O.comment_metrics),
    "comment_ratio": (_on_responses(COM.comment_ratio), O.comment_ratio),
    "regex_ecc": (_on_responses(EFF.regex_ecc), O.regex_ecc),
    "mean_pool": (lambda spark, sf: FUN.mean_pool(read_table(spark, sf, "embeddings")), O.mean_pool),
    "explode_models": (lambda spark, sf: explode_models(tasks_from_responses(responses(spark, sf))).select("idx", "pos", "model", "response"),
                       O.explode_models),
    "regroup": (_regrouped, O.regroup_scores),
    "dedupe_last": (_last_answers, O.dedupe_last),
    "score_comment": (_on_responses(COM.score_comment), O.score_comment),
}


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1]() for k, v in REGISTRY.items() if v[1] is not None}
