"""Quality rules by distribution divergence (operator 4, DataFrame functions only).

Each document's character classes and common words are two histograms. Both are
compared by Jensen-Shannon distance with references of every language, learned
from all documents with that ``lang``; the nearest language counts, so a wrong or
missing ``lang`` does no harm. A ``lang`` needs ``reference_documents`` documents and
``reference_letters`` letters for a reference, so that a few junk documents are not their own measure;
documents of rarer languages are held against the others' references. Short documents scatter around any reference by
chance alone and are not judged by divergence (``min_letters``, ``min_words``).

Main path: split, sort and higher-order array functions on each row, one small
aggregation (language, word) for the references; no Python, no join of texts.

Defined cases: null or empty text has no words, fails the base rule and has null
distances; repeated rows are judged one by one; no row with a ``lang`` or none
of that mass means no reference, null distances and the base rule alone; further columns are ignored
(``keep_documents`` returns them untouched, whatever their names).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell.llm.common import documents

SPACE = r"[\x20\x09-\x0D]+"
CLASSES = ("space", "upper", "lower", "digit", "symbol", "other")


@dataclass(frozen=True)
class Params:
    common_words: int = 50        # words of a language's reference
    reference_documents: int = 20     # languages of fewer documents
    reference_letters: int = 20_000   # or letters have no reference
    min_letters: int = 200        # character classes of shorter documents are not judged
    min_words: int = 50           # common words of documents with fewer letter words are not judged
    max_char_distance: float = 0.32
    max_word_distance: float = 0.42
    base_min_words: int = 50
    base_max_repeat: int = 50     # percent of words in repeated 3-word windows


def _fresh(names, base: str) -> str:
    while base in names:
        base += "_"
    return base


def _text_arrays(docs: DataFrame, q: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs
            .withColumn(q + "w", F.array_remove(F.split(text, SPACE), ""))
            .withColumn(q + "l", F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")))


def _counts(docs: DataFrame, q: str) -> DataFrame:
    """Base figures and character classes; adds columns named by the prefix ``q``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    w = F.col(q + "w")
    df = (_text_arrays(docs, q)
          .withColumn(q + "n_words", F.size(w).cast("long"))
          .withColumn(q + "word_chars", F.char_length(F.array_join(w, "")).cast("long"))
          .withColumn(q + "n_letters", F.char_length(F.array_join(q + "l", "")).cast("long"))
          .withColumn(q + "n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
          .withColumn(q + "upper", F.regexp_count(text, F.lit("[A-Z]")).cast("long"))
          .withColumn(q + "digit", F.regexp_count(text, F.lit("[0-9]")).cast("long"))
          .withColumn(q + "space", (F.char_length(text) - F.col(q + "word_chars")).cast("long")))
    c = lambda n: F.col(q + n)
    return (df.withColumn(q + "lower", c("n_letters") - c("upper"))
            .withColumn(q + "symbol", c("n_symbols"))
            .withColumn(q + "other", c("word_chars") - c("n_letters") - c("digit") - c("n_symbols")))


def _repeats(df: DataFrame, q: str) -> DataFrame:
    """Words in 3-word windows found twice or more, and repeated lines.

    A window's 40 leading hash bits and its place share one long, so one native sort
    brings equal windows together. Should two different windows share those bits (or a
    document have 2^24 words), the windows themselves are sorted instead."""
    w, p = f"`{q}w`", f"`{q}p`"
    windows = f"sequence(0, size({w}) - 3)"
    df = df.withColumn(q + "p", F.expr(
        f"CASE WHEN size({w}) < 3 THEN array() WHEN size({w}) >= 16777216 THEN NULL ELSE sort_array(transform({windows}, i -> "
        f"shiftleft(shiftright(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), 24), 24) | CAST(i AS BIGINT))) END"))
    twin = "shiftright({a}, 24) = shiftright({b}, 24)"
    before = f"(k > 0 AND {twin.format(a='x', b=f'{p}[greatest(k - 1, 0)]')})"
    after = f"(k < size({p}) - 1 AND {twin.format(a='x', b=f'{p}[least(k + 1, size({p}) - 1)]')})"
    df = df.withColumn(q + "t", F.expr(f"filter({p}, (x, k) -> {before} OR {after})"))
    t = f"`{q}t`"
    at = lambda x, d: f"{w}[CAST({x} & 16777215 AS INT) + {d}]"
    y = f"{t}[greatest(k - 1, 0)]"
    same = " AND ".join(f"{at('x', d)} = {at(y, d)}" for d in range(3))
    df = df.withColumn(q + "clash", F.expr(
        f"{p} IS NULL OR exists(transform({t}, (x, k) -> k > 0 AND {twin.format(a='x', b=y)} AND NOT ({same})), b -> b)"))
    exact = f"sort_array(transform({windows}, i -> struct(concat_ws(' ', {w}[i], {w}[i + 1], {w}[i + 2]) AS s, i AS i)))"
    df = df.withColumn(q + "e", F.expr(f"CASE WHEN `{q}clash` THEN {exact} END"))
    e = f"`{q}e`"
    df = df.withColumn(q + "at", F.expr(
        f"CASE WHEN `{q}clash` THEN transform(filter({e}, (x, k) -> (k > 0 AND x.s = {e}[greatest(k - 1, 0)].s) OR "
        f"(k < size({e}) - 1 AND x.s = {e}[least(k + 1, size({e}) - 1)].s)), x -> x.i) "
        f"ELSE transform({t}, x -> CAST(x & 16777215 AS INT)) END"))
    a = f"`{q}at`"
    df = df.withColumn(q + "n_repeat_words", F.expr(
        f"CAST(size(array_distinct(flatten(transform({a}, i -> array(i, i + 1, i + 2))))) AS BIGINT)"))
    lines = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(q + "lines", lines)
    df = df.withColumn(q + "n_dup_lines", (F.size(q + "lines") - F.size(F.array_distinct(q + "lines"))).cast("long"))
    return df.drop(*(q + x for x in ("p", "t", "clash", "e", "at", "lines")))


def references(docs: DataFrame, params: Params = Params()) -> dict:
    """{"chars": {lang: {class: share}}, "words": {lang: {word: share}}} over all documents
    that have a lang. Languages x (common_words + classes) figures reach the driver."""
    q = "_"
    known = docs.where("lang IS NOT NULL").select("lang", "text")
    chars = _counts(known, q).groupBy("lang").agg(
        *(F.sum(q + c).alias(c) for c in CLASSES), F.sum(F.size(q + "l")).alias("total"),
        F.sum(q + "n_letters").alias("letters"), F.count(F.lit(1)).alias("documents"))
    enough = (F.col("documents") >= params.reference_documents) & (F.col("letters") >= params.reference_letters)
    top = chars.where(enough & (F.col("total") > 0)).orderBy(F.desc("total"), "lang").collect()
    if not top:
        return {"chars": {}, "words": {}}
    share = lambda r: {c: r[c] / max(1, sum(r[x] for x in CLASSES)) for c in CLASSES}
    text = F.coalesce(F.col("text"), F.lit(""))
    each = known.where(F.col("lang").isin([r["lang"] for r in top])).select(
        "lang", F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counted = each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counted.withColumn("r", rank).where(F.col("r") <= params.common_words).collect()
    total = {r["lang"]: r["total"] for r in top}
    words: dict = {r["lang"]: {} for r in top}
    for r in sorted(best, key=lambda r: (r["lang"], r["r"])):
        words[r["lang"]][r["word"]] = r["n"] / total[r["lang"]]
    return {"chars": {r["lang"]: share(r) for r in top}, "words": words}


def _js_term(p, q):
    """p log2(2p/(p+q)), 0 where p is 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))


def _char_table(refs: dict):
    """One literal, an array with the class shares of each language, so that the plan does not
    grow with their number."""
    return F.expr("array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{c}', {float(shares[c])!r}D" for c in CLASSES) + ")" for shares in refs["chars"].values()) + ")")


def _word_table(refs: dict):
    """The same for the common words: the map of each language and its mass. Words are letters only."""
    return F.expr("array(" + ", ".join(
        "named_struct('share', map(" + ", ".join(f"'{w}', {float(v)!r}D" for w, v in shares.items())
        + f"), 'mass', {float(sum(shares.values()))!r}D)" for shares in refs["words"].values()) + ")")


def _with_share(table, q: str):
    return lambda x: F.struct((x["n"] / F.size(q + "l")).alias("p"), F.try_element_at(table, x["w"]).alias("r"))


def divergence(docs: DataFrame, refs: dict, params: Params = Params(), q: str = "_") -> DataFrame:
    """All columns of ``docs`` and, by the prefix ``q``: the base figures, char_distance,
    word_distance, base_failed and kept."""
    df = _repeats(_counts(docs, q), q)
    total = sum((F.col(q + c) for c in CLASSES[1:]), F.col(q + CLASSES[0])).cast("double")
    if refs["chars"]:
        def char_js(ref):
            js = F.lit(0.0)
            for c in CLASSES:
                p, r = F.col(q + c) / total, ref[c]
                js = js + 0.5 * _js_term(p, r) + 0.5 * _js_term(r, p)
            return F.sqrt(F.greatest(js, F.lit(0.0)))

        char = F.when(F.col(q + "n_letters") >= params.min_letters, F.array_min(F.transform(_char_table(refs), char_js)))
        common = sorted({x for d in refs["words"].values() for x in d})
        c, n = f"`{q}c`", f"size(`{q}l`)"
        df = df.withColumn(q + "c", F.sort_array(F.filter(q + "l", lambda x: x.isin(common))))
        df = df.withColumn(q + "s", F.expr(
            f"CASE WHEN size({c}) = 0 THEN array() ELSE filter(sequence(0, size({c}) - 1), "
            f"i -> i = 0 OR {c}[i] <> {c}[greatest(i - 1, 0)]) END"))
        s = f"`{q}s`"
        df = df.withColumn(q + "h", F.expr(
            f"transform({s}, (a, k) -> struct({c}[a] AS w, (CASE WHEN k = size({s}) - 1 THEN size({c}) ELSE {s}[k + 1] END - a) AS n))"))

        def word_step(ref):
            found = F.filter(F.transform(q + "h", _with_share(ref["share"], q)), lambda x: x["r"].isNotNull())
            step = F.aggregate(found, F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p")), lambda a, x: F.struct(
                (a["js"] + x["p"] * F.log2(2 * x["p"] / (x["p"] + x["r"])) + x["r"] * F.log2(2 * x["r"] / (x["p"] + x["r"]))
                 - x["r"]).alias("js"), (a["p"] + x["p"]).alias("p")))
            return F.struct(step.alias("a"), ref["mass"].alias("mass"))

        def word_js(x):
            rest, left = F.greatest(1 - x["a"]["p"], F.lit(0.0)), F.greatest(1 - x["mass"], F.lit(0.0))
            js = 0.5 * (x["a"]["js"] + x["mass"]) + 0.5 * _js_term(rest, left) + 0.5 * _js_term(left, rest)
            return F.sqrt(F.greatest(js, F.lit(0.0)))

        df = df.withColumn(q + "a", F.transform(_word_table(refs), word_step))
        word = F.when(F.size(q + "l") >= params.min_words, F.array_min(F.transform(q + "a", word_js)))
    else:
        char = word = F.lit(None).cast("double")
    df = df.withColumn(q + "char_distance", char).withColumn(q + "word_distance", word)
    col = lambda n: F.col(q + n)
    failed = ((col("n_words") < params.base_min_words)
              | (100 * col("n_repeat_words") > params.base_max_repeat * col("n_words")))
    odd = (F.coalesce(col("char_distance") > params.max_char_distance, F.lit(False))
           | F.coalesce(col("word_distance") > params.max_word_distance, F.lit(False)))
    return df.withColumn(q + "base_failed", failed).withColumn(q + "kept", ~failed & ~odd)


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality(docs: DataFrame, params: Params = Params(), refs: dict | None = None) -> DataFrame:
    """One row per input row: doc_id, the base figures, base_failed, kept and the two distances."""
    own = docs.select("doc_id", "text", "lang")
    refs = references(own, params) if refs is None else refs
    df = divergence(own, refs, params)
    return df.select("doc_id", *(F.col("_" + c).alias(c) for c in RESULT),
                     F.round("_char_distance", 4).alias("char_distance"), F.round("_word_distance", 4).alias("word_distance"))


def keep_documents(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    q = "_q"
    while any(c.startswith(q) for c in docs.columns):
        q += "_"
    refs = references(docs.select("lang", "text"), params)
    # The row number keeps the optimizer from moving the filter below the projections, where
    # it would write each column's whole derivation out again wherever it is named.
    judged = divergence(docs, refs, params, q).withColumn(q + "row", F.monotonically_increasing_id())
    return judged.where(F.col(q + "kept") & (F.col(q + "row") >= 0)).select(*(F.col(f"`{c}`") for c in docs.columns))


def op4_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))


def oracle(table: str = "documents", params: Params = Params()) -> str:
    """DuckDB SQL for the query, over a table or view name."""
    js = lambda p, q: f"0.5 * (CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"
    sums = ", ".join(f"sum({c})::DOUBLE AS {c}" for c in CLASSES)
    total = " + ".join(CLASSES)
    parts = " + ".join(js(f"(c.{c} / nullif(c.tot, 0))", f"(r.{c} / r.tot)") for c in CLASSES)
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    regexp_extract_all(lower(coalesce(text, '')), '\p{{L}}+') AS l FROM {table}),
b AS (
  SELECT doc_id, lang, w, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(array_to_string(l, '')) AS n_letters, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS digit,
    length(t) AS chars, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS li FROM w),
c AS (
  SELECT *, chars - word_chars AS space, n_letters - upper AS lower, n_symbols AS symbol,
    word_chars - n_letters - digit - n_symbols AS other, chars::DOUBLE AS tot FROM b),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT win.doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN rep USING (doc_id, g)) GROUP BY doc_id),
langs AS (
  SELECT lang, {sums}, sum(tot) AS tot, sum(len(l)) AS words FROM c WHERE lang IS NOT NULL GROUP BY lang
  HAVING sum(len(l)) > 0 AND count(*) >= {params.reference_documents} AND sum(n_letters) >= {params.reference_letters}),
refw AS (
  SELECT lang, word, n / words::DOUBLE AS q FROM (
    SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r
    FROM (SELECT lang, unnest(l) AS word FROM w WHERE lang IS NOT NULL) GROUP BY lang, word) JOIN langs USING (lang) WHERE r <= {params.common_words}),
mass AS (SELECT lang, sum(q) AS m FROM refw GROUP BY lang),
tf AS (SELECT doc_id, word, count(*) AS k FROM (SELECT doc_id, unnest(l) AS word FROM w) GROUP BY ALL),
hit AS (
  SELECT doc_id, lang, sum(k) / any_value(len(l))::DOUBLE AS p,
    sum({js("(k / len(l)::DOUBLE)", "q")} - 0.5 * q) AS js
  FROM tf JOIN refw USING (word) JOIN (SELECT doc_id, l FROM w) USING (doc_id) GROUP BY doc_id, lang),
wd AS (
  SELECT doc_id, min(sqrt(greatest(0, coalesce(hit.js, 0) + 0.5 * m
    + {js("greatest(1 - coalesce(p, 0), 0)", "greatest(1 - m, 0)")}))) AS d
  FROM (SELECT doc_id FROM b WHERE len(l) >= {params.min_words}) CROSS JOIN mass LEFT JOIN hit USING (doc_id, lang) GROUP BY doc_id),
cd AS (SELECT doc_id, min(sqrt(greatest(0, {parts}))) AS d FROM c CROSS JOIN langs r WHERE n_letters >= {params.min_letters} GROUP BY doc_id),
o AS (
  SELECT c.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    (len(li) - len(list_distinct(li)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, cd.d AS cd, wd.d AS wd
  FROM c LEFT JOIN cov USING (doc_id) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id)),
f AS (SELECT *, n_words < {params.base_min_words} OR 100 * n_repeat_words > {params.base_max_repeat} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(cd > {params.max_char_distance}, false) AND NOT coalesce(wd > {params.max_word_distance}, false) AS kept,
  round(cd, 4) AS char_distance, round(wd, 4) AS word_distance FROM f"""
