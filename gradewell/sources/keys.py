"""Task keys with their JSON kind, and what the dimensions make of them.

``41`` and ``"41"`` are different keys: skip lists name numbers, so only a number is skipped. What stands in for a
missing key differs by dimension:

* ``item`` (functionality, efficiency, comment): ``index`` if the line has one, null included; else the place among the tasks
* ``line`` (modularity): ``index``, else ``id`` where there is no ``index``; for neither, or null, the line's number from 1
* ``none`` (robustness, simplicity): ``index`` or null
* ``zero`` (standardization): ``index`` if the line has one, null included; else 0
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewell.operators.rules import COM_BLOCKLIST, EFF_BLOCKLIST, FUN_BLOCKLIST, ROB_BLOCKLIST
from gradewell.sources.jsonl import classify, with_line_ordinal

POLICY = {"functionality": "item", "efficiency": "item", "comment": "item", "modularity": "line",
          "robustness": "none", "simplicity": "none", "standardization": "zero"}
SKIPPED = {"functionality": FUN_BLOCKLIST, "efficiency": EFF_BLOCKLIST, "comment": COM_BLOCKLIST, "robustness": ROB_BLOCKLIST}
# Languages that a key such as NAME_000001_python may end in.
KEY_LANGUAGES = ["python", "java", "cpp", "c++"]


def _number(n: Column) -> Column:
    return F.struct(F.lit("number").alias("kind"), n.cast("string").alias("text"))


def _read(v: Column) -> Column:
    """(kind, text) of a VARIANT key; NULL where the line has none."""
    s = F.schema_of_variant(v)
    kind = F.when(s == "VOID", "null").when(s == "STRING", "text").when(s.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").otherwise("other")
    text = F.when(s == "VOID", F.lit(None)).when(s == "STRING", F.variant_get(v, "$", "string")).otherwise(F.to_json(v))
    return F.when(v.isNotNull(), F.struct(kind.alias("kind"), text.alias("text")))


def task_key(line: Column, line_no: Column, item_no: Column, policy: str) -> Column:
    """struct(kind, text) of a line (VARIANT), its place in the file and its place among the tasks, both from 0."""
    index, other = _read(F.variant_get(line, "$.index", "variant")), _read(F.variant_get(line, "$.id", "variant"))
    null = F.struct(F.lit("null").alias("kind"), F.lit(None).cast("string").alias("text"))
    if policy == "item":
        return F.coalesce(index, _number(item_no))
    if policy == "line":
        found = F.coalesce(index, other)
        return F.when(found.isNotNull() & (found["kind"] != "null"), found).otherwise(_number(line_no + 1))
    if policy == "none":
        return F.coalesce(index, null)
    if policy == "zero":
        return F.coalesce(index, _number(F.lit(0)))
    raise ValueError(f"no such policy: {policy}")


def skipped(key: Column, dimension: str) -> Column:
    """Whether the dimension's skip list names the key: as a number, whole or with a fraction of zero."""
    if dimension not in SKIPPED:
        return F.lit(False)
    return F.coalesce((key["kind"] == "number") & key["text"].try_cast("double").isin(*SKIPPED[dimension]), F.lit(False))


def key_language(field: Column, key: Column) -> Column:
    """The language field, else the last part of a text key of three parts or more, else python."""
    parts = F.split(key["text"], "_", -1)
    last = F.element_at(parts, -1)
    own = F.when((key["kind"] == "text") & (F.size(parts) > 2) & last.isin(*KEY_LANGUAGES), last)
    return F.coalesce(F.nullif(F.lower(field), F.lit("")), own, F.lit("python"))


def task_keys(tasks: DataFrame) -> DataFrame:
    """Per task line (VARIANT ``line``, ``line_no``, ``item_no``) and dimension: the key, its kind, whether it is
    skipped, and the language for modularity."""
    line = F.col("line")
    keys = [F.struct(F.lit(d).alias("dimension"), task_key(line, F.col("line_no"), F.col("item_no"), p).alias("key")) for d, p in POLICY.items()]
    rows = tasks.select("line_no", F.variant_get(line, "$.programming_language", "string").alias("field"), F.explode(F.array(*keys)).alias("k"))
    skip = F.lit(False)
    for d in SKIPPED:
        skip = F.when(F.col("k.dimension") == d, skipped(F.col("k.key"), d)).otherwise(skip)
    return rows.select("line_no", "k.dimension", F.col("k.key.kind").alias("kind"), F.col("k.key.text").alias("key"), skip.alias("skipped"),
                       F.when(F.col("k.dimension") == "modularity", key_language(F.col("field"), F.col("k.key"))).alias("language"))


def keyed_tasks(lines: DataFrame) -> DataFrame:
    """The valid tasks of ``lines`` as line (VARIANT), line_no and item_no (their places, from 0)."""
    tasks = classify(with_line_ordinal(lines)).where("reason = 'ok'").select("line_no", F.try_parse_json("value").alias("line"))
    # places among the tasks follow the lines: one number a line moves, no text
    order = with_line_ordinal(tasks.select(F.col("line_no").alias("at")).repartitionByRange("at").sortWithinPartitions("at"))
    return tasks.join(order.select(F.col("at").alias("line_no"), F.col("line_no").alias("item_no")), "line_no")


def shaped_keys(responses: DataFrame) -> DataFrame:
    """Task lines in the order of idx with keys of six shapes by idx mod 6, and a blank line before every seventh:
    a number, its text, an ``id`` that names a language, none, null, null beside an ``id``."""
    i = F.col("idx").cast("string")
    shape = F.pmod(F.col("idx"), F.lit(6))
    field = F.lit('"programming_language":"Java",')
    head = (F.when(shape == 0, F.concat(field, F.lit('"index":'), i, F.lit(","))).when(shape == 1, F.concat(F.lit('"index":"'), i, F.lit('",')))
            .when(shape == 2, F.concat(F.lit('"id":"MERGED_'), i, F.lit('_java",'))).when(shape == 3, field)
            .when(shape == 4, F.lit('"index":null,')).otherwise(F.lit('"index":null,"id":5,')))
    line = F.concat(F.lit("{"), head, F.lit('"results":{}}'))
    rows = F.when(F.pmod(F.col("idx"), F.lit(7)) == 0, F.array(F.lit(""), line)).otherwise(F.array(line))
    return responses.select("idx").distinct().repartitionByRange("idx").sortWithinPartitions("idx").select(F.explode(rows).alias("value"))


def key_report(responses: DataFrame) -> DataFrame:
    return task_keys(keyed_tasks(shaped_keys(responses)))
