"""Task <-> answer reshaping: explode a task's model map, regroup scores per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The models written to the output, in output order.
KNOWN_MODELS = ["gpt", "claude", "deepseek", "qwen"]


def explode_models(tasks: DataFrame, results_col: str = "results") -> DataFrame:
    """One row per (task, model) in the JSON key order of ``results``.

    ``posexplode`` over ``map_entries`` keeps the order the map was parsed in;
    a repeated model key keeps its first place with its last value (a Python dict's behaviour).
    Row-local: no shuffle.
    """
    e = F.map_entries(F.col(results_col))
    keys = F.array_distinct(F.transform(e, lambda x: x["key"]))
    keep_last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(e, lambda y: y["key"] == k), -1)["value"].alias("value")))
    others = [c for c in tasks.columns if c != results_col]
    return (tasks.select(*others, F.posexplode(keep_last).alias("pos", "entry"))
            .select(*others, F.col("pos").cast("int").alias("pos"),
                    F.col("entry.key").alias("model"), F.col("entry.value").alias("response")))


def _known_first(entries: Column) -> Column:
    """Known models in fixed order when any is present, else every model in answer order."""
    known = F.array(*[F.lit(m) for m in KNOWN_MODELS])
    has_known = F.exists(entries, lambda e: F.array_contains(known, e["model"]))
    only_known = F.filter(entries, lambda e: F.array_contains(known, e["model"]))
    ranked = F.array_sort(only_known, lambda a, b: (F.array_position(known, a["model"]) - F.array_position(known, b["model"])).cast("int"))
    return F.when(has_known, ranked).otherwise(entries)


def regroup(scores: DataFrame, value: str = "score", lang: str = "programming_language",
            known_models_only: bool = False) -> DataFrame:
    """Back to one row per task: ``results`` = map model -> score in answer order.

    One shuffle on ``idx``; the rows moved are (idx, pos, model, score) only,
    never the answer text, and a group holds one entry per model answer. Answers
    without a score (null) have no entry, but their task stays, with an empty map.
    """
    g = scores.groupBy("idx").agg(
        F.max(lang).alias("programming_language"),
        F.array_sort(F.filter(F.collect_list(F.struct(F.col("pos"), F.col("model"), F.col(value).alias("v"))),
                              lambda e: e["v"].isNotNull())).alias("entries"))
    entries = _known_first(F.col("entries")) if known_models_only else F.col("entries")
    results = F.map_from_entries(F.transform(entries, lambda e: F.struct(e["model"], e["v"])))
    return g.select("idx", "programming_language", results.alias("results"))


def flatten_known(regrouped: DataFrame) -> DataFrame:
    """Map -> one column per known model (for tabular comparison and reports)."""
    return regrouped.select("idx", "programming_language",
                            *[F.col("results").getItem(m).alias(m) for m in KNOWN_MODELS])


def dedupe_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keep the last row per key (a later line overwrites an earlier one)."""
    rest = [c for c in df.columns if c not in (key, order)]
    last = F.max_by(F.struct(*rest), F.col(order)) if rest else F.lit(None)  # orders by ``order`` alone: maps are fine
    return (df.groupBy(key).agg(F.max(order).alias(order), last.alias("_last"))
            .select(key, order, *[F.col("_last")[c].alias(c) for c in rest]))


def tasks_from_responses(responses: DataFrame) -> DataFrame:
    """Long answers -> task rows (``results`` map in answer order), the JSONL task shape.

    Used for the derived corpus only; JSONL input already arrives in this shape.
    A group holds the answers of one task (one per model), never more.
    """
    entries = F.array_sort(F.collect_list(F.struct("pos", "model", "response")))
    return responses.groupBy("idx").agg(
        F.max("programming_language").alias("programming_language"),
        F.max("instruction").alias("instruction"),
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e["model"], e["response"]))).alias("results"))
