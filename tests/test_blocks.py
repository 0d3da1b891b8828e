"""Code in free text and comments: folds against plain Python, hard shapes in linear time."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gradewell.functions.text import strip
from gradewell.operators import blocks as B
from gradewell.plans import comment as COM
from gradewell.plans import modularity as M

TOKENS = ["```", "```python", "```\n", "\n", "\n\n", " ", "  ", "x = 1", "code line", "text ```", "``` tail", "\n```", "\n  ```\n", "js", "a" * 12,
          "```java\nint x;\n```\n", "\t"]


def longest(found):
    return max(found, key=len) if found else None


def fits(b):
    return b if b is not None and len(b.strip()) > 10 and "\n" in b else None


def texts(seed, tokens, n=1500, most=14):
    r = random.Random(seed)
    return ["".join(r.choice(tokens) for _ in range(r.randint(0, most))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "i int, t string")


def test_fences_equal_the_patterns(spark):
    rows = texts(3, TOKENS)
    got = frame(spark, rows).select("t", B.longest_fence(F.col("t"), False).alias("a"), B.longest_fence(F.col("t"), True).alias("b")).collect()
    for r in got:
        for pattern, g in zip(M.MOD_FENCES, (r["a"], r["b"])):
            assert fits(g) == fits(longest(re.findall(pattern.replace("(?s)", ""), r["t"], re.DOTALL))), repr(r["t"])


def block_model(text):
    found, run, on, base = [], [], False, 0
    like = lambda s: any(re.search(p, s) for p in B.CODE_MARKERS)
    for line in text.split("\n"):
        own = len(line) - len(line.lstrip())
        if not on:
            if like(line.strip()):
                on, run, base = True, [line], own
        elif not line.strip() or own >= base or like(line.strip()):
            run.append(line)
        else:
            found += [run] if len(run) > 5 else []
            on, run = False, []
    found += [run] if len(run) > 5 else []
    return longest(["\n".join(r) for r in found])


def test_runs_of_code_lines_equal_the_loop(spark):
    lines = ["\n", "\n", "  x = 1\n", "    return x\n", "def f(a):\n", "plain words\n", "  plain words\n", "# note\n", " }\n", "\tprivate thing\n", "   \n", "结果\n", "  call(é)\n"]
    rows = texts(5, lines, 1200, 30)
    for r in frame(spark, rows).select("t", B.code_blocks(F.col("t")).alias("b")).collect():
        assert r["b"] == block_model(r["t"]), repr(r["t"])


def loose_model(text):
    for p in B.MARKUP_LINES + B.MARKUP_SPANS:
        text = re.sub(p, "", text)
    signs = sum(bool(re.search(p, text, re.M)) for p in B.SIGNS + [rf"\b{w}\s+.*:" for w in B.HEADED])
    return text if len(text.strip()) > 30 and signs >= 3 else None


def test_loose_texts_equal_the_patterns(spark):
    parts = ["# head\n", "#", "> said\n", "**bold**", "*it*", "**", "*", "\n", " ", "if x", "if", "for y", ":", ": ", "return 1", "= [", "import os", "class A",
             "from a import b", "def f (", "    ", "words words ", "\r"]
    rows = texts(7, parts, 2500, 25)
    for r in frame(spark, rows).select("t", B.loose_text(F.col("t")).alias("b")).collect():
        assert r["b"] == loose_model(r["t"]), repr(r["t"])


def test_strip_equals_python(spark):
    rows = texts(9, [" ", "\t", "\n", "a", " ", "\r\n", " "], 400)
    for r in frame(spark, rows).select("t", strip("t").alias("s")).collect():
        assert r["s"] == r["t"].strip(), repr(r["t"])


def pure_model(code, lang):
    steps = [r"#.*", r"'''[\s\S]*?'''", r'"""[\s\S]*?"""'] if lang == "python" else [r"//.*", r"/\*[\s\S]*?\*/", r"/\*\*[\s\S]*?\*/"]
    for p in steps:
        code = re.sub(p, "", code)
    return code


@pytest.mark.parametrize("lang", ["python", "java"])
def test_code_without_comments_equals_the_patterns(spark, lang):
    rows = texts(11, ["/*", "*/", "/", "*", "**", "x", "\n", "//", "'''", '"""', "'", "#", " y "], 1500)
    df = frame(spark, rows).select("t", COM.pure_code(F.col("t"), F.lit(lang)).alias("p"))
    for r in df.collect():
        assert r["p"] == pure_model(r["t"], lang), repr(r["t"])


def test_hard_shapes_take_linear_time(spark):
    n = 150_000
    shapes = {"open blocks": "/* x\n" * n, "stars": "/*" + "*" * n * 2 + "x*/", "triple": "'''" + "x '' y\n" * n, "late fence": "```\n" + "line of code\n" * n + "text ```",
              "late fences": "```\nline text ```\n" * (n // 4), "blanks": "x" + "\n" * n * 2 + "y", "spaces": "x" + " " * n * 3 + "y", "headings": "#" * n * 2,
              "colons": "if " * n, "code": "x = 1\n\nwords here\n" * (n // 3), "indented": "  x = 1\nwords\n" * (n // 3)}
    rows = spark.createDataFrame([(i, 0, k, "python" if k == "triple" else "java", t) for i, (k, t) in enumerate(shapes.items())],
                                 "idx long, pos int, model string, programming_language string, response string")
    t0 = time.time()
    assert len(COM.comment_metrics(rows).collect()) == len(M.modularity_inputs(rows).collect()) == len(shapes)
    assert time.time() - t0 < 150


def repair_model(code):
    kept, balance, state = [], 0, ""
    for line in code.split("\n"):
        for j, c in enumerate(line):
            if not state and c in "'\"":
                state = c
            elif state == c and (j == 0 or line[j - 1] != "\\"):
                state = ""
        if state and not line.strip().endswith(('"""', "'''")):
            state = ""
            continue
        balance += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        kept.append(line)
    return "\n".join(kept) + ")" * max(0, balance)


def test_repair_equals_the_loop(spark):
    parts = ['"""', "'''", '"', "'", "\\", "\n", "\n", "x = f(", ")", "[", "}", "def g(a):", "  ", "word "]
    rows = texts(13, parts, 3000, 16) + ['"""a"""\n' * 300 + "'", ""]
    for r in frame(spark, rows).select("t", B.repaired(F.col("t")).alias("r")).collect():
        assert r["r"] == repair_model(r["t"]), repr(r["t"])
