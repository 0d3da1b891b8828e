"""A corpus cleaning pipeline over `documents`, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's docs; all but the last return the columns
of docs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewell.llm import common, decontaminate, jaccard, packing, pii, quality


def quality_rules(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality.keep_documents(docs)


def near_duplicates(spark, docs, sf_dir):
    """Of documents whose sets of five-word shingles are similar by 0.8 or more, directly or
    through others, the one with the smallest doc_id stays."""
    return jaccard.keep_one(docs, 5, 80)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark, docs, sf_dir):
    """Personal data is masked in the text; n_chars follows the new text."""
    out = pii.mask(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def best_fit_packing(spark, docs, sf_dir):
    """The pieces of all documents, with their sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.store(docs, "pipeline")
    return docs
