"""Standardization score (0-30): 10 minus rule penalties and indent breaks, times three.

Exact in decimals: penalties are multiples of 0.1, so the score never needs
rounding. Everything is row-local; only the regroup shuffles (idx, score).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from gradewell.functions.text import indent, let, lines, nonempty, strip
from gradewell.operators.explode import regroup, flatten_known
from gradewell.operators.extract import extract_std
from gradewell.operators.guards import graded
from gradewell.operators.language import lang_code_rules, lang_instruction
from gradewell.operators.rules import STD_RULES, java_regex

DEC = "decimal(6,1)"
# Patterns that occur in the same texts as a rule's own and don't go over a word from each of its letters.
SAME_HITS = {r"[a-zA-Z_][a-zA-Z0-9_]*\s*=": r"[a-zA-Z_][0-9]*\s*=", r"[a-z][a-zA-Z0-9]*[A-Z]": r"[a-z][0-9]*[A-Z]"}


def rule_hits(code: Column, lang: Column) -> Column:
    """Array of (rule_no, penalty) of the rules of ``lang`` that match at least once."""
    branches = None
    for lg, rules in STD_RULES.items():
        hits = F.array(*[F.when(code.rlike(java_regex(p)),
                                F.struct(F.lit(n).alias("rule_no"), F.lit(Decimal(pen)).cast(DEC).alias("penalty")))
                         for n, (p, pen, _) in enumerate(rules, start=1)])
        hits = F.filter(hits, lambda h: h.isNotNull())
        branches = (F.when(lang == lg, hits) if branches is None else branches.when(lang == lg, hits))
    empty = F.array().cast("array<struct<rule_no:int,penalty:decimal(6,1)>>")
    return branches.otherwise(empty)


def rule_penalty(code: Column, lang: Column) -> Column:
    """Sum of the penalties of every rule that hits (once per rule, however often it matches)."""
    total = None
    for lg, rules in STD_RULES.items():
        s = sum((F.when(code.rlike(java_regex(SAME_HITS.get(p, p))), F.lit(Decimal(pen))).otherwise(F.lit(Decimal("0.0")))
                 for p, pen, _ in rules), F.lit(Decimal("0.0")))
        total = F.when(lang == lg, s) if total is None else total.when(lang == lg, s)
    return total.otherwise(F.lit(Decimal("0.0"))).cast(DEC)


def indent_breaks(code: Column) -> Column:
    """Adjacent non-blank line pairs whose indents differ by neither 0 nor 4."""
    def broken(at):  # the indent of each line, null where it is blank
        n = F.size(at)
        pairs = F.zip_with(F.slice(at, 1, n - 1), F.slice(at, 2, n - 1), lambda a, b: ~F.abs(a - b).isin(0, 4))
        return F.size(F.filter(pairs, lambda x: x)).cast("long")
    return let(F.transform(lines(code), lambda l: F.when(strip(l) != "", indent(l))), broken)


def std_score(code: Column, lang: Column) -> Column:
    base = F.lit(Decimal("10.0")) - rule_penalty(code, lang) - F.lit(Decimal("0.2")) * indent_breaks(code)
    clamped = F.greatest(F.lit(Decimal("0.0")), F.least(F.lit(Decimal("10.0")), base))
    return F.when(code == "", F.lit(0.0)).otherwise((clamped * 3).cast("double"))


def graded_standardization(responses: DataFrame) -> DataFrame:
    """Long form: idx, pos, model, programming_language, score, reason, raw — answers that are empty are omitted."""
    lang = lang_instruction(F.col("instruction"))
    df = (responses.filter(nonempty(F.col("response")))
          .select("idx", "pos", "model",
                  F.coalesce(F.col("programming_language"), lang).alias("programming_language"),
                  lang.alias("lang"), extract_std(F.col("response")).alias("code")))
    return df.select("idx", "pos", "model", "programming_language",
                     *graded([("no_code", F.col("code") == "", 0.0)], std_score(F.col("code"), F.col("lang"))))


def score_standardization(responses: DataFrame) -> DataFrame:
    return graded_standardization(responses).drop("reason", "raw")


def standardization_report(responses: DataFrame) -> DataFrame:
    """Per-task output (known models in fixed order), one column per model."""
    scored = score_standardization(responses)
    skipped = responses.filter(~nonempty(F.col("response"))).select(
        "idx", "pos", "model", F.coalesce(F.col("programming_language"), lang_instruction(F.col("instruction"))).alias("programming_language"),
        F.lit(None).cast("double").alias("score"))
    return flatten_known(regroup(scored.unionByName(skipped), known_models_only=True))


def rule_violations(responses: DataFrame) -> DataFrame:
    """How many answers break each rule, per language (partial aggregation before the shuffle)."""
    lang = lang_instruction(F.col("instruction"))
    code = extract_std(F.col("response"))
    hits = (responses.filter(nonempty(F.col("response")))
            .select(lang.alias("lang"), code.alias("code"))
            .filter(F.col("code") != "")
            .select("lang", F.explode(rule_hits(F.col("code"), F.col("lang"))).alias("h")))
    return (hits.groupBy("lang", F.col("h.rule_no").alias("rule_no"))
            .agg(F.count(F.lit(1)).alias("n_answers"), F.sum("h.penalty").cast("double").alias("penalty_total")))


def indent_break_counts(responses: DataFrame) -> DataFrame:
    """Count of indent breaks per answer."""
    code = extract_std(F.col("response"))
    return (responses.filter(nonempty(F.col("response")))
            .select("idx", "model", indent_breaks(code).alias("indent_breaks")))


def code_languages(responses: DataFrame) -> DataFrame:
    """L5 per answer: the language its code shows."""
    return responses.select("idx", "model", lang_code_rules(extract_std(F.col("response"))).alias("shown"))
