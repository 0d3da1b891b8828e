"""Cross-dimension scorecard: the seven score sets side by side per (task, model).

The seven long score tables (idx, model, score) are unioned with a dimension
label and pivoted on a fixed value list (no extra job to discover values): one
shuffle on (idx, model) over small rows. Rankings per model and rollups per
(model, language) are further small aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gradewell.operators.explode import tasks_from_responses
from gradewell.plans import (comment, efficiency, functionality, modularity, robustness, simplicity,
                             standardization)
from gradewell.sources.corpus import case_outcomes, responses

DIMENSIONS = ["functionality", "modularity", "simplicity", "standardization", "robustness", "efficiency", "comment"]


def score_sets(spark, sf_dir: str) -> dict[str, DataFrame]:
    r = responses(spark, sf_dir)
    tasks = tasks_from_responses(r)
    sem = functionality.semantic_similarity(spark, sf_dir, r.select("idx", "pos", "model"))
    return {
        "functionality": functionality.score_functionality(tasks, sem, case_outcomes(spark, sf_dir)),
        "modularity": modularity.score_modularity(r),
        "simplicity": simplicity.score_simplicity(tasks),
        "standardization": standardization.score_standardization(r),
        "robustness": robustness.score_robustness_full(r),
        "efficiency": efficiency.score_efficiency(r),
        "comment": comment.score_comment(r),
    }


def scores_long(sets: dict[str, DataFrame]) -> DataFrame:
    parts = [df.select("idx", "model", F.lit(dim).alias("dimension"), F.col("score").cast("double").alias("score"))
             for dim, df in sets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scorecard(spark, sf_dir: str) -> DataFrame:
    """One row per (task, model): the seven scores (NULL where a dimension omits the answer) and their total."""
    long = scores_long(score_sets(spark, sf_dir))
    wide = long.groupBy("idx", "model").pivot("dimension", DIMENSIONS).agg(F.max("score"))
    total = sum((F.coalesce(F.col(d), F.lit(0.0)) for d in DIMENSIONS), F.lit(0.0))
    return wide.select("idx", "model", *DIMENSIONS, F.round(total, 1).alias("total"))


def model_ranking(spark, sf_dir: str) -> DataFrame:
    """Mean score per model and dimension, ranked within each dimension."""
    long = scores_long(score_sets(spark, sf_dir))
    agg = long.groupBy("dimension", "model").agg(F.round(F.avg("score"), 6).alias("mean_score"),
                                                 F.count(F.lit(1)).alias("n_answers"))
    w = Window.partitionBy("dimension").orderBy(F.desc("mean_score"), F.asc("model"))
    return agg.select("*", F.rank().over(w).alias("rank"))
