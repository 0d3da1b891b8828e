"""Derived answer corpus.

The driver tables hold prose, not code, so the engine's inputs are derived
from ``documents`` with portable SQL: every four documents make one task,
each document one model answer, wrapped into one of twelve code templates
and seven answer shapes. The same text runs in Spark and in DuckDB (the
oracle), which is why it stays SQL: both engines see identical rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradewell.session import file_length, file_signature, materialize
from gradewell.sources.tables import read_table

# The corpus definition (portable SQL, `documents` as input).
CORPUS_CTES = r"""
w AS (
  SELECT doc_id,
    CAST(floor(doc_id / 4) AS BIGINT)     AS idx,
    CAST(doc_id % 4 AS INT)               AS pos,
    CAST(floor(doc_id / 4) AS BIGINT) % 3 AS l,
    CAST(floor(doc_id / 12) AS BIGINT) % 4 AS v,
    doc_id % 7                            AS f,
    coalesce(nullif(regexp_extract(lower(text), '([a-z]{3,})', 1), ''), 'alpha') AS w1,
    coalesce(nullif(regexp_extract(lower(text), '[a-z]{3,}[^a-z]+([a-z]{3,})', 1), ''), 'beta') AS w2,
    replace(coalesce(text, ''), chr(10), ' ') AS c,
    coalesce(text, '') AS t,
    chr(10) AS n
  FROM documents),
b AS (
  SELECT *,
    CASE l WHEN 0 THEN 'python' WHEN 1 THEN 'java' ELSE 'cpp' END AS lang,
    CASE l * 10 + v
    WHEN 0 THEN concat('import ', w1, n, '# ', c, n, '# ', w2, n, 'def ', w2, '(x, y):', n,
      '    if x == y and x > 0:', n, '        print(x)  # ', w1, n, '    return x')
    WHEN 1 THEN concat('class ', w1, ':', n, '    ', repeat('"', 3), c, repeat('"', 3), n, '    def set_', w1, '(self, x):', n, '        self.', w1, ' = x', n,
      '    def get_', w1, '(self):', n, '        return self.', w1, n, '    def ', w2, '(self):', n, '        # ', w2, n, '        return self.', w2)
    WHEN 2 THEN concat('import os', n, 'from ', w1, ' import *', n, '# ', c, n, 'def ', w2, '(path):', n, '    try:', n, '        with open(path) as fh:', n,
      '            return isinstance(fh, str)', n, '    except:', n, '      return None', n, '    finally:', n, '        pass')
    WHEN 3 THEN concat('def ', w1, '(x:', n, '    # ', c, n, '    while True', n, '        ', w2, ' = x')
    WHEN 10 THEN concat('import java.util.', w1, ';', n, 'public class ', w2, ' {', n, '  // ', c, n, '  // ', w1, n,
      '  public static int run(int a, int b) { return a; }', n, '}')
    WHEN 11 THEN concat('public class A {', n, '    private ', w1, ';', n, '    /* ', c, ' */', n, '    public void go(String s) {', n,
      '        try {', n, '            if (s == null) { System.out.println(s); }', n, '        } catch (Exception e) {', n,
      '        } finally { s.close(); }', n, '    }', n, '}')
    WHEN 12 THEN concat('class ', w1, ' {', n, '   /** ', c, ' */', n, '   int ', w2, '(int a) {', n, '      for (int i = 0; i < a; i++) { a = a + i; }', n, '      return a;', n, '   }', n, '}')
    WHEN 13 THEN concat('import java.io.', w1, ';', n, 'import java.io.', w1, ';', n, '// ', c, n, 'public class B { boolean x(boolean ok) { if (ok == true) { return ok; } return false; } }')
    WHEN 20 THEN concat('#include <', w1, '>', n, 'using namespace std;', n, '// ', c, n, 'int ', w2, '(int a) { cout << a; return a; }')
    WHEN 21 THEN concat('#include <memory>', n, '#define ', w1, ' 1', n, '// ', c, n, 'void ', w2, '() {', n, '  std::unique_ptr<int> p;', n, '  try { } catch (...) { throw; }', n, '}')
    WHEN 22 THEN concat('#include <vector>', n, '#include "', w1, '.h"', n, '/* ', c, ' */', n, 'int main() { int* p = nullptr; if (p == NULL) { delete p; } return 0; }')
    ELSE concat('// ', w1, n, '// ', c, n, 'int ', w2, '(int a, int b, int c) {', n, '    while(true) { a = a + b; }', n, '}')
    END AS code
  FROM w),
responses AS (
SELECT idx, pos,
  CASE pos WHEN 0 THEN 'gpt' WHEN 1 THEN 'claude' WHEN 2 THEN 'deepseek' ELSE 'qwen' END AS model,
  CASE WHEN idx % 5 = 4 THEN NULL ELSE lang END AS programming_language,
  concat(CASE idx % 6 WHEN 0 THEN 'Sort the list of ' WHEN 1 THEN 'Reverse a string of ' WHEN 2 THEN 'Calculate the sum of '
    WHEN 3 THEN 'Use recursion on ' WHEN 4 THEN 'Return the array of ' ELSE 'Write code for ' END, w1,
    CASE WHEN idx % 2 = 0 THEN concat(' in ', lang) ELSE '' END) AS instruction,
  CASE f WHEN 0 THEN code
    WHEN 1 THEN concat('Error: ', t)
    WHEN 2 THEN concat(t, n, '```', n, code, n, '```')
    WHEN 3 THEN concat('```', lang, n, code, n, '```', n, t, n, '```', lang, n, '# ', w1, n, code, n, w2, n, '```')
    WHEN 4 THEN nullif(t, '')
    WHEN 5 THEN concat(w1, n, '```', lang, n, code, n, '# ', replace(t, n, concat(n, '# ')), n, '```')
    ELSE concat(t, n, '```', lang, n, code, n, '```', n, w2) END AS response
FROM b),
case_outcomes AS (
SELECT r.idx, r.model, k.case_no, (r.idx * 7 + r.pos * 3 + k.case_no * 5) % 4 <> 0 AS passed, r.idx % 11 <> 0 AS ran
FROM responses r CROSS JOIN (SELECT 0 AS case_no UNION ALL SELECT 1 UNION ALL SELECT 2) k)
"""


def oracle_with(body_ctes: str = "") -> str:
    """``WITH`` prefix for DuckDB oracle SQL: the corpus CTEs plus extra ones."""
    extra = ("," + body_ctes) if body_ctes.strip() else ""
    return "WITH " + CORPUS_CTES.strip() + extra + "\n"


# Bytes of `documents` (compressed) in one file of the corpus: at most SLICE, at least LEAST where the cores would not all have one.
SLICE, LEAST = 16 << 20, 256 << 10


def slices(length: int, cores: int) -> int:
    """Files of the corpus, for an input of this length."""
    return max(1, -(-length // SLICE), min(2 * cores, -(-length // LEAST)))


def _dealt(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The documents dealt over many equal parts, so that the plans' stages don't follow the files and row groups of
    the input (one row group is one task). By id and text: rows that share an id, or have none, are spread, too."""
    n = slices(file_length(spark, f"{sf_dir}/documents.parquet"), spark.sparkContext.defaultParallelism)
    return docs.repartition(n, "doc_id", F.xxhash64("text"))


def _documents_view(spark: SparkSession, sf_dir: str) -> str:
    name = "gw_documents_" + hashlib.sha1(sf_dir.encode()).hexdigest()[:10]
    if not spark.catalog.tableExists(name):
        # Only the two columns the corpus reads reach the parquet scan.
        _dealt(spark, sf_dir, read_table(spark, sf_dir, "documents").select("doc_id", "text")).createOrReplaceTempView(name)
    return name


def _corpus_sql(spark: SparkSession, sf_dir: str, final: str) -> DataFrame:
    view = _documents_view(spark, sf_dir)
    sql = "WITH " + CORPUS_CTES.strip().replace("FROM documents", f"FROM {view}") + "\n" + final
    return spark.sql(sql)


def _key(spark: SparkSession, sf_dir: str) -> str:
    """Names the stored corpus by its input and its definition, so neither can change unnoticed."""
    sig = f"{sf_dir}:{file_signature(spark, f'{sf_dir}/documents.parquet')}:{CORPUS_CTES}"
    return hashlib.sha1(sig.encode()).hexdigest()[:12]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (task, model): idx, pos, model, programming_language, instruction, response.

    Built once per input and stored as Parquet in the shared checkpoint
    folder; every plan then starts from a plain scan of it.
    """
    df = _corpus_sql(spark, sf_dir, "SELECT * FROM responses")
    return materialize(spark, df, f"corpus/responses-{_key(spark, sf_dir)}")


def case_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per (task, model, case) pass/run flags of the generated tests (three cases per answer),
    derived from the stored corpus row-locally."""
    r = responses(spark, sf_dir).select("idx", "pos", "model")
    r = r.select("idx", "pos", "model", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("case_no"))
    return r.select("idx", "model", "case_no",
                    ((F.col("idx") * 7 + F.col("pos") * 3 + F.col("case_no") * 5) % 4 != 0).alias("passed"),
                    (F.col("idx") % 11 != 0).alias("ran"))
