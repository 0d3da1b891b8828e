"""Structured Streaming: score task lines as they arrive.

The per-answer transforms are stateless, so the stream is the batch plan on
``readStream``: text lines -> parse -> explode -> score -> append to a file
sink, with a checkpoint for exactly-once output. Per-batch processed / failed
line counts are observed metrics of the same pass (no second read).

Two streams go beyond single batches. ``stream_totals`` holds the line counts of all
batches so far as state. ``stream_reports`` keeps the last line of every key: a later line
of a key takes the place of the earlier one, across batches and restarts; what it has
written is its state. Both write a batch's rows to a
folder of the batch's number, so a batch that runs again after a failure overwrites
its own rows only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradewell.operators.explode import dedupe_last, explode_models
from gradewell.plans.standardization import score_standardization
from gradewell.sources.jsonl import classify, instruction_of, result_lines


def stream_lines(spark: SparkSession, in_dir: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.option("pathGlobFilter", "*.jsonl")
            .option("maxFilesPerTrigger", max_files_per_trigger).text(in_dir))


def stream_tasks(lines: DataFrame) -> DataFrame:
    """ST2 lives here: counts of processed and failed lines are observed per micro-batch."""
    c = classify(lines).observe("line_counts", F.count(F.lit(1)).alias("lines"),
                                F.count_if(F.col("reason") == "ok").alias("ok"),
                                F.count_if(F.col("reason") == "malformed").alias("malformed"))
    p = F.col("parsed")
    return c.filter(F.col("reason") == "ok").select(
        F.col("parsed.index").alias("idx"), p["programming_language"].alias("programming_language"),
        instruction_of(p).alias("instruction"), p["results"].alias("results"))


def stream_standardization(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                           available_now: bool = True):
    """ST1: standardization scores per answer, appended as Parquet. Returns the started query."""
    answers = explode_models(stream_tasks(stream_lines(spark, in_dir)))
    scored = score_standardization(answers)
    w = (scored.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def _by_batch(out_dir: str, change=lambda df: df):
    def write(df: DataFrame, batch: int) -> None:
        change(df).write.mode("overwrite").parquet(f"{out_dir}/batch={batch}")
    return write


def _started(writer, checkpoint: str, available_now: bool):
    w = writer.option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def stream_totals(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, available_now: bool = True, max_files_per_trigger: int = 1000):
    """ST2: lines by reason over all batches so far. Returns the started query."""
    counts = classify(stream_lines(spark, in_dir, max_files_per_trigger)).groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))
    return _started(counts.writeStream.outputMode("complete").foreachBatch(_by_batch(out_dir)), checkpoint, available_now)


def read_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """reason, lines of the last batch."""
    rows = spark.read.parquet(out_dir)
    return rows.join(rows.agg(F.max("batch").alias("batch")), "batch").select("reason", "lines")


def stream_reports(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, plan, available_now: bool = True, max_files_per_trigger: int = 1000):
    """``plan`` (tasks -> one row a task) over the last line of every key, by the time and name of its file and
    its place there. Only keys that a batch brings are scored again. Returns the started query."""
    lines = stream_lines(spark, in_dir, max_files_per_trigger).select(
        "value", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("split"))

    def report(batch: DataFrame) -> DataFrame:
        rows = batch.select("value", F.struct("split", F.monotonically_increasing_id().alias("row")).alias("place"))
        p = F.col("parsed")
        tasks = classify(rows).filter(F.col("reason") == "ok").select(
            F.col("parsed.index").alias("idx"), "place", p["programming_language"].alias("programming_language"),
            instruction_of(p).alias("instruction"), p["results"].alias("results"))
        out = result_lines(plan(dedupe_last(tasks, "idx", "place").drop("place")))
        return out.select(F.get_json_object("value", "$.index").alias("idx"), "value")
    return _started(lines.writeStream.foreachBatch(_by_batch(out_dir, report)), checkpoint, available_now)


def read_reports(spark: SparkSession, out_dir: str) -> DataFrame:
    """idx and result line of every key, as its last batch has it."""
    return spark.read.parquet(out_dir).groupBy("idx").agg(F.max_by("value", "batch").alias("value"))
