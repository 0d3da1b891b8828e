"""Python syntax facts: the only Python that runs on executors.

``code_facts`` turns (idx, model, code) rows into flat node rows — one per
syntax-tree node — with ``mapInArrow`` (Arrow batches in, Arrow batches
out). Everything downstream (method counts, statement counts, arg maxima,
imports, class/method/attribute sets, pair joins) is Spark SQL over this
table, so the per-row Python is a small tree walk and nothing else.

A row with ``kind = 'SyntaxError'`` (or ``'ParseError'`` for any other
failure) marks code that does not parse; it is the answer's only row.
"""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FACT_SCHEMA = ("idx long, model string, node_id int, parent_id int, func_id int, class_id int, "
               "kind string, name string, n_args int, has_value boolean, ctx string, base string, parent_kind string, "
               "func_path array<int>")
_COLS = ["idx", "model", "node_id", "parent_id", "func_id", "class_id", "kind", "name",
         "n_args", "has_value", "ctx", "base", "parent_kind", "func_path"]


CHUNK = 20_000


def _name_of(node) -> str | None:
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return node.name
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return node.attr
    if isinstance(node, ast.Call):
        f = node.func
        return f.id if isinstance(f, ast.Name) else (f.attr if isinstance(f, ast.Attribute) else "")
    if isinstance(node, ast.ImportFrom):
        return node.module
    if isinstance(node, ast.alias):
        return node.name
    if isinstance(node, ast.arg):
        return node.arg
    return None


def _n_args(node) -> int | None:
    if isinstance(node, ast.Call):
        return len(node.args)
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return len(node.args.args)
    if isinstance(node, ast.ImportFrom):
        return node.level
    return None


def walk_facts(idx, model, code):
    """Rows for one answer: a depth-first walk carrying the enclosing functions (all of
    them, so that a nested function's nodes count for the outer ones too) and class."""
    try:
        tree = ast.parse(code)
    except SyntaxError:
        return [(idx, model, -1, -1, -1, -1, "SyntaxError", None, None, None, None, None, None, [])]
    except Exception:  # noqa: BLE001 - e.g. null bytes, recursion depth
        return [(idx, model, -1, -1, -1, -1, "ParseError", None, None, None, None, None, None, [])]
    return _walk(tree, idx, model)


def _walk(tree, idx, model):
    stack = [(tree, -1, [], -1, None)]
    nid = 0
    while stack:
        node, parent, path, cls, parent_kind = stack.pop()
        me = nid
        nid += 1
        base = None
        if isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
            base = node.value.id
        ctx = type(node.ctx).__name__ if hasattr(node, "ctx") else None
        has_value = getattr(node, "value", None) is not None if isinstance(node, ast.Return) else None
        yield (idx, model, me, parent, path[-1] if path else -1, cls, type(node).__name__, _name_of(node),
               _n_args(node), has_value, ctx, base, parent_kind, path)
        child_path = [*path, me] if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else path
        child_cls = me if isinstance(node, ast.ClassDef) else cls
        kids = list(ast.iter_child_nodes(node))
        for k in reversed(kids):
            stack.append((k, me, child_path, child_cls, type(node).__name__))


def _facts_batches(batches):
    """Answers are taken from the Arrow batch one at a time, node rows leave by CHUNK: neither the texts of a
    batch nor the nodes of many answers, or of a long one, stand in Python at once."""
    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.int32(), pa.bool_(), *[pa.string()] * 3, pa.list_(pa.int32())]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _COLS)

    for b in batches:
        rows = []
        for i in range(b.num_rows):
            code = b.column(2)[i].as_py()
            if code is None or code == "":
                continue
            for row in walk_facts(b.column(0)[i].as_py(), b.column(1)[i].as_py(), code):
                rows.append(row)
                if len(rows) >= CHUNK:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


def code_facts(code_df: DataFrame) -> DataFrame:
    """(idx, model, code) -> node facts. Rows with empty code produce nothing."""
    return code_df.select("idx", "model", "code").mapInArrow(_facts_batches, FACT_SCHEMA)


# Node kinds the efficiency score counts.
METHOD_KINDS = ["FunctionDef", "AsyncFunctionDef", "ClassDef"]
STATEMENT_KINDS = ["If", "For", "While", "Assign", "AugAssign", "Expr", "Return", "Raise", "Assert",
                   "Import", "ImportFrom"]
BRANCH_KINDS = ["If", "For", "While", "Assert"]


def efficiency_facts(facts: DataFrame) -> DataFrame:
    """Per answer: parses, methods, statements, max inputs, max outputs, cc (partial agg before the shuffle)."""
    k = F.col("kind")
    inputs = (F.when((k == "Call") & (F.col("name") == "input"), F.col("n_args"))
              .when(k == "FunctionDef", F.col("n_args")))
    outputs = (F.when((k == "Call") & (F.col("name") == "print"), F.col("n_args"))
               .when((k == "Return") & F.col("has_value"), F.lit(1)))
    return facts.groupBy("idx", "model").agg(
        (F.count_if(k.isin("SyntaxError", "ParseError")) == 0).alias("parses"),
        F.count_if(k.isin(*METHOD_KINDS)).alias("num_methods"),
        F.count_if(k.isin(*STATEMENT_KINDS)).alias("exec_statements"),
        F.coalesce(F.max(inputs), F.lit(0)).cast("long").alias("max_inputs"),
        F.coalesce(F.max(outputs), F.lit(0)).cast("long").alias("max_outputs"),
        (F.count_if(k.isin(*BRANCH_KINDS)) + 1).alias("cc"))


# Node kinds used by the maintainability index on facts.
OPERATOR_KINDS = ["BinOp", "UnaryOp", "BoolOp", "Compare", "AugAssign"]
OPERAND_KINDS = ["Name", "Constant"]
DECISION_KINDS = ["If", "IfExp", "For", "AsyncFor", "While", "ExceptHandler", "Assert", "comprehension"]
STMT_KINDS = ["FunctionDef", "AsyncFunctionDef", "ClassDef", "Return", "Delete", "Assign", "AugAssign", "AnnAssign",
              "For", "AsyncFor", "While", "If", "With", "AsyncWith", "Raise", "Try", "Assert", "Import", "ImportFrom",
              "Global", "Nonlocal", "Expr", "Pass", "Break", "Continue", "Match", "TryStar", "TypeAlias"]


def maintainability_facts(facts: DataFrame, comment_lines: DataFrame) -> DataFrame:
    """Per answer: parses and a maintainability index from the published formula
    ``max(0, (171 - 5.2 ln V - 0.23 G - 16.2 ln L + 50 sin(sqrt(2.46 * radians(C)))) * 100 / 171)``
    with V = Halstead volume (operator / operand nodes), G = 1 + decision nodes,
    L = statements, C = comment lines as a percentage of L.

    ``comment_lines``: (idx, model, n_comment_lines)."""
    k = F.col("kind")
    agg = facts.groupBy("idx", "model").agg(
        (F.count_if(k.isin("SyntaxError", "ParseError")) == 0).alias("parses"),
        F.count_if(k.isin(*OPERATOR_KINDS)).alias("n1_total"),
        F.count_distinct(F.when(k.isin(*OPERATOR_KINDS), k)).alias("n1"),
        F.count_if(k.isin(*OPERAND_KINDS)).alias("n2_total"),
        F.count_distinct(F.when(k.isin(*OPERAND_KINDS), F.coalesce(F.col("name"), k))).alias("n2"),
        (F.count_if(k.isin(*DECISION_KINDS)) + 1).alias("g"),
        F.count_if(k.isin(*STMT_KINDS)).alias("lloc"))
    j = agg.join(comment_lines, ["idx", "model"], "left")
    n, big_n = F.col("n1") + F.col("n2"), F.col("n1_total") + F.col("n2_total")
    volume = F.when(n > 0, big_n * F.log2(n)).otherwise(F.lit(0.0))
    lloc = F.col("lloc").cast("double")
    c = F.when(lloc > 0, F.coalesce(F.col("n_comment_lines"), F.lit(0)) / lloc * 100).otherwise(F.lit(0.0))
    raw = (F.lit(171.0) - F.lit(5.2) * F.ln(volume) - F.lit(0.23) * F.col("g") - F.lit(16.2) * F.ln(lloc)
           + F.lit(50.0) * F.sin(F.sqrt(F.lit(2.46) * F.radians(c))))
    mi = F.when((volume <= 0) | (lloc <= 0), F.lit(100.0)) \
        .otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * 100 / 171)))
    return j.select("idx", "model", "parses", F.when(F.col("parses"), mi).alias("mi"))
