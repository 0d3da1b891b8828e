"""Answers of task lines with their JSON kinds: text, number, boolean, list, object or null.

The typed scan reads every answer as text; here ``results`` is a map of VARIANT, so that a number differs from the
text of a number and objects can be unwrapped. Two policies turn an answer into the response that the plans score:

* ``unwrap`` (functionality): of an object the first of ``content``, ``response`` and ``text`` counts, again and
  again until no object is left; an object without any of them, and an empty or zero value, is no response; numbers,
  ``True`` and lists count as their text (a list as JSON, as the text of a list has no place in a program).
* ``text`` (all others): anything but text is no response; ``kind`` says why.

Keys repeated in a line keep the last value, as VARIANT refuses such lines and the typed scan decides then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewell.sources import jsonl as J

# The fields that may hold an answer, in order.
FIELDS = ["content", "response", "text"]


def kind(v: Column) -> Column:
    s = F.schema_of_variant(v)
    return (F.when(v.isNull() | (s == "VOID"), "null").when(s == "STRING", "text").when(s.startswith("OBJECT"), "object")
            .when(s.startswith("ARRAY"), "list").when(s == "BOOLEAN", "boolean").otherwise("number"))


def unwrapped(v: Column) -> Column:
    """The value within nested objects; NULL if one has none of FIELDS. An answer of n opening braces has n levels at most."""
    def inner(x):
        return F.coalesce(*(F.variant_get(x, f"$.{f}", "variant") for f in FIELDS))
    levels = F.sequence(F.lit(0), F.regexp_count(F.to_json(v), F.lit(r"\{")))
    return F.aggregate(levels, v, lambda x, _: F.when(kind(x) == "object", inner(x)).otherwise(x))


def text_of(v: Column) -> Column:
    """A value that is no object as text; NULL for what is empty, zero, false or null."""
    k, js = kind(v), F.to_json(v)
    return (F.when(k == "text", F.variant_get(v, "$", "string")).when(k == "boolean", F.when(js == "true", "True"))
            .when(k == "number", F.when(js.cast("double") != 0, js)).when(k == "list", F.when(js != "[]", js)))


def typed_answers(lines: DataFrame) -> DataFrame:
    """One row an answer of the valid lines: index, programming_language, instruction, pos, model, kind, answer
    (VARIANT), plain (the answer's text by the typed scan)."""
    c = J.classify(lines if "line_no" in lines.columns else J.with_line_ordinal(lines)).filter(F.col("reason") == "ok")
    typed = F.variant_get(F.try_parse_json("value"), "$.results", "variant").cast("map<string,variant>")
    rows = J.tasks_of(c.withColumn("_typed", typed), keep=["_typed"])
    rows = rows.select("index", "programming_language", "instruction", "_typed", F.posexplode("results").alias("pos", "model", "plain"))
    # A line with a repeated key has no VARIANT: its answers count as the text that was read.
    read = F.variant_get(F.to_variant_object(F.array("plain")), "$[0]", "variant")
    own = F.when(F.col("_typed").isNotNull(), F.try_element_at("_typed", "model")).otherwise(read)
    return rows.select("index", "programming_language", "instruction", "pos", "model", own.alias("answer"), "plain").select(
        "*", kind(F.col("answer")).alias("kind"))


def responses_of(answers: DataFrame, policy: str) -> DataFrame:
    """Typed answers as the plans read them: idx, pos, model, programming_language, instruction, response, kind."""
    a = F.col("answer")
    if policy not in ("unwrap", "text"):
        raise ValueError(f"no such policy: {policy}")
    response = text_of(unwrapped(a)) if policy == "unwrap" else F.when(F.col("kind") == "text", F.variant_get(a, "$", "string"))
    return answers.select(F.col("index").alias("idx"), "pos", "model", "programming_language", "instruction", response.alias("response"), "kind")


def shaped_lines(responses: DataFrame) -> DataFrame:
    """Task lines of the stored answers, each in one of six JSON shapes by (idx + pos) mod 6: text, an object with
    ``content``, nested objects, an object without an answer, a number (its length), a list."""
    text = lambda c: F.substring(F.to_json(F.array(c), {"ignoreNullFields": "false"}), F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    r, shape = text(F.col("response")), F.pmod(F.col("idx") + F.col("pos"), F.lit(6))
    js = (F.when(shape == 0, r).when(shape == 1, F.concat(F.lit('{"note":1,"content":'), r, F.lit("}")))
          .when(shape == 2, F.concat(F.lit('{"response":{"text":'), r, F.lit("}}"))).when(shape == 3, F.concat(F.lit('{"note":'), r, F.lit("}")))
          .when(shape == 4, F.coalesce(F.length("response"), F.lit(0)).cast("string"))
          .otherwise(F.concat(F.lit("["), F.col("idx").cast("string"), F.lit(","), F.col("pos").cast("string"), F.lit("]"))))
    entry = F.concat(text(F.col("model")), F.lit(":"), js)
    entries = F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry"))))  # of one task
    return responses.groupBy("idx").agg(entries.alias("e")).select(
        F.concat(F.lit('{"index":'), F.col("idx").cast("string"), F.lit(',"results":{'), F.array_join(F.transform("e", lambda e: e["entry"]), ","), F.lit("}}")).alias("value"))


def answer_kinds(responses: DataFrame) -> DataFrame:
    """Per answer of the shaped lines: its kind and the response by either policy."""
    answers = typed_answers(shaped_lines(responses))
    a = F.col("answer")
    return answers.select(F.col("index").cast("long").alias("idx"), F.col("pos").cast("int").alias("pos"), "model", "kind",
                          text_of(unwrapped(a)).alias("unwrapped"), F.when(F.col("kind") == "text", F.variant_get(a, "$", "string")).alias("text"))
