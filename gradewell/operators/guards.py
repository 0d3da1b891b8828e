"""Guard ladders: what decides an answer's score before anything is measured.

A rung is (reason, condition, score); the first whose condition holds decides. ``graded`` gives the score, the
reason (SCORED without a rung) and the measured value beside it, so that a guard never hides what a text of any
length or kind would have got.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCORED = "scored"
Rung = tuple[str, Column, float]


def _first(rungs: list[Rung], pick, otherwise: Column) -> Column:
    out = None
    for rung in rungs:
        out = F.when(rung[1], pick(rung)) if out is None else out.when(rung[1], pick(rung))
    return otherwise if out is None else out.otherwise(otherwise)


def reason(rungs: list[Rung]) -> Column:
    return _first(rungs, lambda r: F.lit(r[0]), F.lit(SCORED))


def score(rungs: list[Rung], raw: Column) -> Column:
    return _first(rungs, lambda r: F.lit(r[2]), raw)


def graded(rungs: list[Rung], raw: Column) -> list[Column]:
    """Columns score, reason and raw."""
    return [score(rungs, raw).alias("score"), reason(rungs).alias("reason"), raw.alias("raw")]
