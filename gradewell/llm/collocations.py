"""Phrase collocation mining by stripes (operator 13).

Texts are folded (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these at spaces and tabs into
words. For every language, phrases of 2 to ``longest`` words that occur ``least`` times or
more are scored by their weakest cut, floor(1000 * a * n / (l * r)), and the best ``top`` of each
language that no longer phrase subsumes are given.

* Stripes: a prefix of m - 1 words keys an associative counter of the words that follow it. A
  task counts a slice of texts with sorted arrays and sends one stripe a prefix; stripes of a prefix
  merge elementwise. The empty prefix's stripe counts the words; its total is n.
* Level by level: a phrase of ``least`` occurrences has parts of as many, so a stripe takes
  only words whose prefix and whose last m - 1 words may be frequent. A bitmap of hashes says so;
  it has 16 bits a frequent phrase and 32 MB at most (``common.FILTER_BITS``), beyond which it
  lets more through and the counts stay exact.
* A stripe is dealt in ``SPREAD`` parts by the next word, so a prefix of a third of all
  words is no single task's; merging keeps one counter, not all stripes.
* From a merged stripe come the extensions with their counts a; the prefix's own row adds the
  counts of the first parts (l), the row of the last m - 1 words those of the last parts (r). The
  greatest count of a prefix's stripe, and of the phrases that end in it, is what subsumes it: a
  longer phrase that holds it has a phrase in between that is one word longer and occurs as often
  or more, so one word to the right and one to the left decide.

Words and phrases are keyed by 64-bit hashes that start from the language, so equal words of two
languages differ; two of 10^8 frequent phrases clash with a chance of about 1 in 4000. Counts
are 64-bit, products decimals of 38 digits.

Defined cases: a null text has no pieces; a null lang is ``und`` and counts with a lang of that name;
no phrase of that count gives no rows; repeated rows count each; texts and words of any length
stay whole; further columns are ignored; equal scores and counts go by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewell.llm import kernels as K
from gradewell.llm.common import Bitmap, bitmap, documents, partitions, store

LEAST, LONGEST, TOP = 100, 5, 2000
SPREAD = 16
HELD = 1 << 21        # entries that a task merges before it sends them
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[10, 11, 12, 13, *b".,;:!?"]] = True
SPLIT = SEPARATOR.copy()
SPLIT[[9, 32]] = True


def extended(key: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Key of a phrase and a further word."""
    return K.mix(key * K.ORDER[1] + nxt)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def tokens(batch):
    """(folded bytes, start, end, key, piece, document) of the words of a batch (text, lang)."""
    data, off = K.buffer(batch.column("text"))
    start, end, h, woff = K.words(data, off, ws=SPLIT)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    salt = np.array([_salt(x) for x in batch.column("lang").to_pylist()], np.uint64)
    piece = np.cumsum(SEPARATOR[data], dtype=np.int64)[start] + doc if len(start) else start
    return K.LOWER[data], start, end, K.mix(h ^ salt[doc]), piece, doc


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    raw = data[K.ragged(start, size)].tobytes()
    off = np.concatenate(([0], np.cumsum(size)))
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def _words(batches):
    """The empty prefix's stripe of each slice: (lang, word, key, count)."""
    for b in K.slices(batches):
        data, start, end, key, _, doc = tokens(b)
        own, first, count = np.unique(key, return_index=True, return_counts=True)
        lang = b.column("lang").take(pa.array(doc[first]))
        yield pa.RecordBatch.from_arrays([lang, _spans(data, start[first], end[first]), pa.array(own.view(np.int64)), pa.array(count.astype(np.int64))],
                                         ["lang", "word", "key", "n"])


def _merged(prefix, nxt, last, n):
    """Entries added up by (prefix, next), in that order."""
    order = np.lexsort((nxt, prefix))
    prefix, nxt, last, n = prefix[order], nxt[order], last[order], n[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(n)), bool), (prefix[1:] != prefix[:-1]) | (nxt[1:] != nxt[:-1]))))
    return prefix[head], nxt[head], last[head], np.add.reduceat(n, head) if len(head) else n


def _sent(held, m: int = 3):
    """Stripes (prefix, part, next, last, count) of a task's entries; of two words the last is the next one and stays behind."""
    prefix, nxt, last, n = _merged(*(np.concatenate(x) for x in zip(*held)))
    last = np.zeros_like(last) if m == 2 else last
    part = (nxt & np.uint64(SPREAD - 1)).astype(np.int64)
    order = np.lexsort((part, prefix))
    prefix, nxt, last, n, part = prefix[order], nxt[order], last[order], n[order], part[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(n)), bool), (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]))))
    for a in range(0, len(head), 1 << 15):
        own = head[a:a + (1 << 15)]
        to = head[a + (1 << 15)] if a + (1 << 15) < len(head) else len(n)
        off = np.append(own, to) - own[0]
        lists = [K.string_list(x[own[0]:to], off, pa.int64()) for x in (nxt.view(np.int64), last.view(np.int64), n)]
        yield pa.RecordBatch.from_arrays([pa.array(prefix[own].view(np.int64)), pa.array(part[own].astype(np.int32)), *lists], STRIPE)


STRIPE = ["prefix", "part", "next", "last", "n"]
STRIPE_SCHEMA = "prefix long, part int, next array<long>, last array<long>, n array<long>"


def _stripes(m: int, frequent: Bitmap):
    def run(batches):
        held, size = [], 0
        for b in K.slices(batches):
            _, _, _, word, piece, _ = tokens(b)
            if len(word) < m:
                continue
            g = word  # keys of the phrases of m - 1 words
            for j in range(1, m - 1):
                g = extended(g[:-1], word[j:])
            may = frequent(g)
            at = np.flatnonzero(may[:-1] & may[1:] & (piece[:len(word) - m + 1] == piece[m - 1:]))
            if not len(at):
                continue
            held.append(_merged(g[at], word[at + m - 1], g[at + 1], np.ones(len(at), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                yield from _sent(held, m)
                held, size = [], 0
        if held:
            yield from _sent(held, m)
    return run


def _merge(least: int, m: int = 3):
    """Extensions of ``least`` occurrences or more, from stripes sorted by (prefix, part)."""
    def entries(b):
        n = np.diff(b.column("next").offsets.to_numpy())
        flat = [b.column(k).flatten().to_numpy() for k in ("next", "last", "n")]
        return np.repeat(b.column("prefix").to_numpy().view(np.uint64), n), flat[0].view(np.uint64), flat[0 if m == 2 else 1].view(np.uint64), flat[2]

    def out(prefix, nxt, last, n):
        ok = n >= least
        cols = (extended(prefix[ok], nxt[ok]).view(np.int64), prefix[ok].view(np.int64), last[ok].view(np.int64), n[ok])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "prefix", "suffix", "a"])

    def run(batches):
        held, key = None, None
        for b in batches:
            if not b.num_rows:
                continue
            last = (b.column("prefix")[-1].as_py(), b.column("part")[-1].as_py())
            same = (b.column("prefix").to_numpy() == last[0]) & (b.column("part").to_numpy() == last[1])
            closed = b.num_rows - int(same.sum())  # rows of parts that end in this batch
            if held is not None and (key != last or closed):
                cols = _merged(*(np.concatenate(x) for x in zip(held, entries(b.slice(0, closed)))))
                yield out(*cols)
                held = None
            elif closed:
                yield out(*_merged(*entries(b.slice(0, closed))))
            own = entries(b.slice(closed))
            held = _merged(*(np.concatenate(x) for x in zip(held, own))) if held is not None else _merged(*own)
            key = last
        if held is not None:
            yield out(*held)
    return run


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST):
    """(tables of the frequent phrases of 1, 2, ... words, n of each language). A phrase has key,
    lang, phrase, a, prefix, suffix, and counts of its first 1, 2, ... words (lefts) and of its last
    m - 1, m - 2, ... words (rights)."""
    spark = docs.sparkSession
    docs = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words = store(docs.mapInArrow(_words, "lang string, word string, key long, n long")
                  .groupBy("key", "lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    none = F.array().cast("array<long>")
    table = words.where(F.col("a") >= least).select("key", "lang", F.col("word").alias("phrase"), "a", F.lit(None).cast("long").alias("prefix"),
                                                    F.lit(None).cast("long").alias("suffix"), none.alias("lefts"), none.alias("rights"))
    tables = [table]
    for m in range(2, longest + 1):
        rows = table.count()
        if not rows:
            break
        dealt = (docs.mapInArrow(_stripes(m, bitmap(table.select("key"), rows)), STRIPE_SCHEMA)
                 .repartition(partitions(spark), "prefix", "part").sortWithinPartitions("prefix", "part"))
        found = dealt.mapInArrow(_merge(least, m), "key long, prefix long, suffix long, a long")
        p = table.select(F.col("key").alias("prefix"), "lang", F.col("phrase").alias("p"), F.col("a").alias("pa"), "lefts")
        s = table.select(F.col("key").alias("suffix"), F.col("phrase").alias("s"), F.col("a").alias("sa"), "rights")
        table = store(found.join(p, "prefix").join(s, "suffix").select(
            "key", "lang", F.concat_ws(" ", "p", F.substring_index("s", " ", -1)).alias("phrase"), "a", "prefix", "suffix",
            F.array_append("lefts", F.col("pa")).alias("lefts"), F.array_prepend("rights", F.col("sa")).alias("rights")), "phrases")
        tables.append(table)
    return tables, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, subsume: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, words: the ``top`` phrases of each language that no
    longer phrase of ``subsume`` percent of their count or more holds."""
    tables, totals = phrases(docs, least, longest)
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long, words int")
    if len(tables) < 2:
        return empty
    every = reduce(DataFrame.unionAll, (t.withColumn("words", F.lit(m)) for m, t in enumerate(tables[1:], 2)))
    longer = every.where("words > 2")
    most = (longer.select(F.col("prefix").alias("key"), "a").unionAll(longer.select(F.col("suffix").alias("key"), "a"))
            .groupBy("key").agg(F.max("a").alias("most")))
    left = every.join(most, "key", "left").where(f"most IS NULL OR CAST(most AS DECIMAL(38,0)) * 100 < CAST(a AS DECIMAL(38,0)) * {int(subsume)}")
    cuts = F.expr("""array_min(transform(sequence(1, words - 1), k -> named_struct(
        'score', (CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * CAST(1000 AS DECIMAL(4,0)))
                 div (CAST(lefts[k - 1] AS DECIMAL(19,0)) * CAST(rights[k - 1] AS DECIMAL(19,0))),
        'k', k, 'l', lefts[k - 1], 'r', rights[k - 1])))""")
    best = left.join(totals, "lang").withColumn("cut", cuts).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", "words")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "words"))


def op13_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir)).drop("words")


def oracle(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """DuckDB SQL for the query's rows."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, array_to_string(list_slice(w, i, i + {m - 1}), ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {m - 2})) AS i FROM pieces)"
        for m in range(1, longest + 1))
    return f"""WITH texts AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM texts),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
total AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
cuts AS (SELECT c.lang, c.phrase, c.m, c.a, k, array_to_string(list_slice(w, 1, k), ' ') AS lp, array_to_string(list_slice(w, k + 1, c.m), ' ') AS rp
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) AS c),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.m, cuts.a, k, fl.a AS l, fr.a AS r, n,
    (1000::HUGEINT * cuts.a * n) // (fl.a::HUGEINT * fr.a) AS score
  FROM cuts JOIN f AS fl ON fl.lang = cuts.lang AND fl.phrase = lp JOIN f AS fr ON fr.lang = cuts.lang AND fr.phrase = rp JOIN total ON total.lang = cuts.lang),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, array_to_string(list_slice(w, 1, m - 1), ' ') AS phrase, a FROM c UNION ALL SELECT lang, array_to_string(list_slice(w, 2, m), ' '), a FROM c),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
kept AS (SELECT worst.* FROM worst LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < 100 * worst.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase) ASC) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {top}"""
