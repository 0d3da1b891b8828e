"""Fixed lookup tables of the scoring rules.

Each table is a small Python literal. Plans compile them into literal
``CASE`` / ``rlike`` expressions (one regex compile per task, row-local, no
join), and ``std_rules_df`` exposes them as broadcastable tables for the
reports that group by rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Standardization rules per language, in order:
# (pattern as Python writes it, penalty, reason).
STD_RULES = {
    "python": [
        (r"def\s+\w+\s*\([^:]*\):", "0.5", "function without type annotations"),
        (r"[a-zA-Z_][a-zA-Z0-9_]*\s*=", "0.3", "variable naming"),
        (r"#\s*\w+", "0.2", "comment style"),
        (r"if\s+\w+\s*==\s*True", "0.3", "redundant comparison with True"),
        (r"except:", "0.5", "bare except"),
        (r"print\(", "0.2", "print instead of logging"),
        (r"^\s*[^#\n]{80,}", "0.2", "line longer than 80 characters"),
        (r"class\s+\w+[^(]", "0.3", "class definition style"),
        (r"import\s+\*", "0.4", "wildcard import"),
    ],
    "java": [
        (r"public\s+class\s+\w+\s*{", "0.3", "class definition style"),
        (r"catch\s*\(\s*Exception\s+\w+\s*\)", "0.5", "catches every exception"),
        (r"System\.out\.print", "0.2", "System.out instead of logging"),
        (r"[a-z][a-zA-Z0-9]*[A-Z]", "0.3", "camel case naming"),
        (r"//\s*\w+", "0.2", "comment style"),
        (r"if\s*\(\s*\w+\s*==\s*true\s*\)", "0.3", "redundant comparison with true"),
        (r"^.{100,}", "0.2", "line longer than 100 characters"),
        (r"private\s+\w+\s*;", "0.3", "field definition style"),
    ],
    "cpp": [
        (r"using\s+namespace\s+std\s*;", "0.5", "imports the whole std namespace"),
        (r"catch\s*\(\s*\.\.\.\s*\)", "0.5", "catches every exception"),
        (r"cout\s*<<", "0.2", "cout instead of logging"),
        (r"#define\s+\w+", "0.3", "macro definition"),
        (r"//\s*\w+", "0.2", "comment style"),
        (r"if\s*\(\s*\w+\s*==\s*true\s*\)", "0.3", "redundant comparison with true"),
        (r"^.{80,}", "0.2", "line longer than 80 characters"),
        (r"void\s+\w+\s*\(\s*\)", "0.3", "function definition style"),
    ],
}


def java_regex(p: str) -> str:
    """Python ``re`` pattern -> Java pattern with the same meaning.

    Java rejects a bare ``{`` that does not open a quantifier, Python's ``.``
    excludes only ``\\n`` (Java's ``(?d)``), and Python's ``\\w``/``\\s`` are
    Unicode-aware (Java's ``(?U)``).
    """
    out = []
    i = 0
    while i < len(p):
        ch = p[i]
        if ch == "\\" and i + 1 < len(p):
            out.append(p[i:i + 2])
            i += 2
            continue
        if ch == "{" and not _is_quantifier(p, i):
            out.append("\\{")
        else:
            out.append(ch)
        i += 1
    return "(?dU)" + "".join(out)


def _is_quantifier(p: str, i: int) -> bool:
    j = p.find("}", i)
    if j < 0:
        return False
    body = p[i + 1:j]
    return bool(body) and all(c.isdigit() or c == "," for c in body) and body[0].isdigit()


def std_rules_df(spark: SparkSession) -> DataFrame:
    rows = [(lang, n, pat, pen, reason)
            for lang, rules in STD_RULES.items()
            for n, (pat, pen, reason) in enumerate(rules, start=1)]
    schema = T.StructType([
        T.StructField("lang", T.StringType()), T.StructField("rule_no", T.IntegerType()),
        T.StructField("pattern", T.StringType()), T.StructField("penalty", T.StringType()),
        T.StructField("reason", T.StringType())])
    return spark.createDataFrame(rows, schema).withColumn("penalty", F.col("penalty").cast("decimal(3,1)"))


# Task keys that receive a fixed 0 per dimension.
FUN_BLOCKLIST = [41, 55, 61, 67, 71, 77, 82, 94]
ROB_BLOCKLIST = [41, 55, 61, 67, 71, 77, 82, 94]
EFF_BLOCKLIST = [833]
COM_BLOCKLIST = [833]
