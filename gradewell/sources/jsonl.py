"""JSONL task files: scans with quarantine, shape checks, line ordinals and sinks.

A task line is ``{"index", "programming_language", "code-instruction", "results": {model: answer}}``.
``read.text`` keeps one row per line (so blank and broken lines can be counted,
which the JSON reader would drop); parsing is a typed ``from_json`` plus a
VARIANT parse only to tell malformed JSON from valid JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F, types as T

from gradewell.session import checkpoint_dir

TASK_SCHEMA = T.StructType([
    T.StructField("index", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("programming_language", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("code_language", T.StringType()), T.StructField("code-instruction", T.StringType()),
    T.StructField("instruction", T.StringType()),
    T.StructField("results", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of every ``*.jsonl`` file under ``path``, in file order."""
    return spark.read.option("pathGlobFilter", "*.jsonl").text(path)


def find_input(spark: SparkSession, folder: str, candidates: list[str]) -> str:
    """The first of ``candidates`` in ``folder``, else its first ``*.jsonl`` by name, on any store Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in candidates:
        if fs.exists(path(folder, name)):
            return f"{folder.rstrip('/')}/{name}"
    found = sorted(x.getPath().getName() for x in fs.listStatus(path(folder)) if x.getPath().getName().endswith(".jsonl"))
    if not found:
        raise FileNotFoundError(f"no task file in {folder}")
    return f"{folder.rstrip('/')}/{found[0]}"


def _scan_of_files(lines: DataFrame) -> bool:
    """Whether the rows are those of a scan of files, in its order: beyond a shuffle the file of a row says nothing
    about its place (and asked for below a ``distinct`` it would make one row several)."""
    node = lines._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "Generate", "SubqueryAlias", "View"):
        node = node.children().apply(0)
    return node.children().isEmpty() and "_metadata" in node.metadataOutput().toString()


def with_line_ordinal(lines: DataFrame) -> DataFrame:
    """Adds ``line_no``, the 0-based place of each line (for keys that are missing): in file order for a scan
    of files, whose splits may be read in any order; in partition order otherwise.

    Two phases, both in the JVM: lines are counted by split, the counts are added up in file order (one row a
    split), and a line's place within its split is added. Nothing is sorted but the splits."""
    names = lines.columns
    place = F.monotonically_increasing_id()
    if _scan_of_files(lines):
        rows = lines.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), place.alias("_row"))
    else:  # no files below: the partitions are the splits, fixed by a checkpoint
        checkpoint_dir(lines.sparkSession)
        rows = lines.checkpoint().select(*names, F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_from"), place.alias("_row"))
    split = ["_file", "_from"]
    count = rows.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1))
    start = count.select(*split, "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(start, split).select(*names, (F.col("_before") + F.col("_row") - F.col("_first")).alias("line_no"))


def classify(lines: DataFrame) -> DataFrame:
    """Adds ``parsed`` (typed struct) and ``reason``: ok / blank / malformed / bad_shape."""
    v = F.col("value")
    blank = v.rlike(r"(?U)^\s*$")
    parsed = F.from_json(v, TASK_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    # What the typed parser reads is fine (a repeated key too, which VARIANT refuses); of the rest
    # VARIANT tells broken JSON from valid JSON of another shape.
    malformed = F.coalesce(F.col("parsed._corrupt_record").isNotNull(), F.lit(True)) & F.try_parse_json(v).isNull()
    return lines.select("*", parsed.alias("parsed")).select(
        "*", F.when(blank, "blank").when(malformed, "malformed")
        .when(F.col("parsed.results").isNull(), "bad_shape").otherwise("ok").alias("reason"))


def instruction_of(parsed) -> Column:
    """The task's instruction: an empty ``code-instruction`` falls through to ``instruction``."""
    return F.coalesce(F.nullif(parsed["code-instruction"], F.lit("")), parsed["instruction"])


def index_json(js: Column) -> Column:
    """Writes a leading all-digit ``index`` as a JSON number ("007" as 7)."""
    return F.regexp_replace(js, r'^\{"index":"0*([0-9]+)"', '{"index":$1')


def scan_lenient(lines: DataFrame) -> DataFrame:
    """Valid task rows only: idx (index, else id, else line number), language field, instruction, results."""
    return tasks_of(classify(lines if "line_no" in lines.columns else with_line_ordinal(lines)).filter(F.col("reason") == "ok"))


def tasks_of(classified: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Task rows of classified lines, with the columns to ``keep``."""
    c, p = classified, F.col("parsed")
    lang = F.coalesce(p["programming_language"], p["language"], p["code_language"])
    return c.select(F.coalesce(p["index"], p["id"], F.col("line_no").cast("string")).alias("index"),
                    F.lower(lang).alias("programming_language"),
                    instruction_of(p).alias("instruction"),
                    p["results"].alias("results"), "line_no", *(keep or []))


def error_records(lines: DataFrame) -> DataFrame:
    """P20: one row a line that is JSON but no task: index (as text, null without one), programming_language, error."""
    bad = classify(lines).filter(F.col("reason") == "bad_shape").select(F.try_parse_json("value").alias("v"))
    name = lambda v: F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0))
    v, results = F.col("v"), F.variant_get("v", "$.results", "variant")
    error = (F.when(name(v) != "object", F.concat(F.lit("task is "), name(v))).when(results.isNull(), "results missing")
             .otherwise(F.concat(F.lit("results is "), name(results))))
    own = name(v) == "object"
    field = lambda f: F.when(own, F.try_variant_get(v, f"$.{f}", "string"))
    return bad.select(field("index").alias("index"), F.coalesce(field("programming_language"), F.lit("python")).alias("programming_language"), error.alias("error"))


def with_error_lines(scored: DataFrame, errors: DataFrame) -> DataFrame:
    """Result lines of the scored tasks and of the error records, for one sink: a bad task yields its own line and
    stops no other."""
    js = F.to_json(F.struct("index", "programming_language", F.create_map(F.lit("error"), F.col("error")).alias("results")))
    return result_lines(scored).unionAll(errors.select(index_json(js).alias("value")))


def scan_strict(lines: DataFrame) -> DataFrame:
    """All lines must be valid tasks; raises on the first bad or blank line."""
    bad = classify(lines).filter(F.col("reason") != "ok").limit(1).collect()
    if bad:
        raise ValueError(f"invalid task line ({bad[0]['reason']}): {bad[0]['value'][:100]!r}")
    return scan_lenient(lines)


def quarantine(lines: DataFrame) -> DataFrame:
    """Bad lines with their reason (blank lines are skipped, not quarantined)."""
    c = classify(with_line_ordinal(lines))
    return c.filter(~F.col("reason").isin("ok", "blank")).select("line_no", F.col("value").alias("raw"), "reason")


def scan_counts(lines: DataFrame) -> DataFrame:
    """S3: total / blank / malformed / bad_shape / ok counts in one pass."""
    c = classify(lines)
    r = F.col("reason")
    return c.agg(F.count(F.lit(1)).alias("total"), F.count_if(r == "blank").alias("blank"),
                 F.count_if(r == "malformed").alias("malformed"), F.count_if(r == "bad_shape").alias("bad_shape"),
                 F.count_if(r == "ok").alias("ok"))


def observe_counts(lines: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """Same counts as metrics of the scan itself (no second pass)."""
    obs = Observation(name)
    r = F.col("reason")
    df = classify(lines).observe(obs, F.count(F.lit(1)).alias("total"), F.count_if(r == "ok").alias("ok"),
                                 F.count_if(r == "malformed").alias("malformed"))
    return df, obs


def task_lines(tasks: DataFrame) -> DataFrame:
    """Tasks -> JSONL ``value`` lines (index written as a number when it is all digits)."""
    js = F.to_json(F.struct(F.col("idx").cast("string").alias("index"), "programming_language",
                            F.col("instruction").alias("code-instruction"), "results"))
    return tasks.select(index_json(js).alias("value"))


def result_lines(regrouped: DataFrame) -> DataFrame:
    """(idx, programming_language, results map) -> output JSON lines, index as number when all digits."""
    js = F.to_json(F.struct(F.col("idx").cast("string").alias("index"), "programming_language", "results"))
    return regrouped.select(index_json(js).alias("value"))


def sink_jsonl(regrouped: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per task; overwrite truncates, append adds."""
    result_lines(regrouped).write.mode(mode).text(path)


def preview(lines: DataFrame, n: int = 10, width: int = 100) -> DataFrame:
    """First lines, cut to ``width`` characters (a limit is the feature here)."""
    return lines.limit(n).select(F.substring("value", 1, width).alias("value"))


def completeness(lines: DataFrame, plan, path: str, mode: str = "overwrite") -> DataFrame:
    """Score the valid tasks of ``lines`` by ``plan`` (tasks -> one row a task), write them to ``path`` and
    compare what went in with what came out: lines_read, valid_tasks, rows_written, missing, complete. The counts
    are observed on both ends of the one job that writes; nothing is read again."""
    read, written = Observation(), Observation()
    classified = classify(with_line_ordinal(lines))
    ok = F.col("reason") == "ok"
    tasks = tasks_of(classified.observe(read, F.count(F.lit(1)).alias("lines"), F.count_if(ok).alias("tasks")).filter(ok))
    out = result_lines(plan(tasks.withColumnRenamed("index", "idx"))).observe(written, F.count(F.lit(1)).alias("rows"))
    out.write.mode(mode).text(path)
    n, rows = read.get, written.get["rows"]
    return lines.sparkSession.createDataFrame(
        [(n["lines"], n["tasks"], rows, n["tasks"] - rows, n["tasks"] == rows)],
        "lines_read long, valid_tasks long, rows_written long, missing long, complete boolean")
