"""Comment quality score (0-30): 0.7 * comment/identifier overlap (Jaccard) + 0.3 * mean comment length score.

All row-local array work: comment islands over the line array (no explode,
no window shuffle), identifier sets with ``array_union``/``array_except``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewell.functions.text import NL, before_last, let, lines, nonempty, splitlines, strip, until
from gradewell.operators.explode import regroup
from gradewell.operators.extract import FENCE, INNER, from_first, paragraphs
from gradewell.operators.guards import graded
from gradewell.operators.rules import COM_BLOCKLIST

# Language aliases of the comment scorer (alias -> family).
COM_ALIASES = {
    "python": "python", "py": "python", "python3": "python",
    "java": "java",
    "cpp": "cpp", "c++": "cpp", "c": "cpp",
    "javascript": "java", "js": "java", "typescript": "java", "ts": "java", "csharp": "java", "c#": "java",
    "php": "java", "go": "java", "ruby": "python", "rb": "python", "rust": "cpp", "swift": "java",
    "kotlin": "java", "scala": "java",
}

# Language keywords removed from the identifier sets.
JAVA_KEYWORDS = [
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char", "class", "const", "continue",
    "default", "do", "double", "else", "enum", "extends", "final", "finally", "float", "for", "goto", "if",
    "implements", "import", "instanceof", "int", "interface", "long", "native", "new", "null", "package",
    "private", "protected", "public", "return", "short", "static", "strictfp", "super", "switch", "synchronized",
    "this", "throw", "throws", "transient", "try", "void", "volatile", "while",
]
CPP_KEYWORDS = [
    "alignas", "alignof", "and", "and_eq", "asm", "auto", "bitand", "bitor", "bool", "break", "case", "catch",
    "char", "char16_t", "char32_t", "class", "compl", "concept", "const", "consteval", "constexpr", "constinit",
    "continue", "co_await", "co_return", "decltype", "default", "delete", "do", "double", "dynamic_cast", "else",
    "enum", "explicit", "export", "extern", "false", "final", "float", "for", "friend", "goto", "if", "import",
    "inline", "int", "long", "mutable", "namespace", "new", "noexcept", "not", "not_eq", "nullptr", "operator",
    "or", "or_eq", "private", "protected", "public", "reflexpr", "register", "reinterpret_cast", "requires",
    "return", "short", "signed", "sizeof", "static", "static_assert", "static_cast", "struct", "switch",
    "synchronized", "template", "this", "throw", "throws", "true", "try", "typedef", "typeid", "typename", "union",
    "unsigned", "using", "virtual", "void", "volatile", "wchar_t", "while",
]
PYTHON_KEYWORDS = [
    "False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del",
    "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal",
    "not", "or", "pass", "raise", "return", "try", "while", "with", "yield",
]
KEYWORDS = {"java": JAVA_KEYWORDS, "cpp": CPP_KEYWORDS, "python": PYTHON_KEYWORDS}

# Fence patterns in order, and what makes a line look like code.
FENCE_PATTERNS = [r"```[\s\S]*?\n([\s\S]*?)```", r"```([\s\S]*?)```", r"`{3,}([\s\S]*?)`{3,}"]
ONE_PASS_FENCES = [rf"```[^\n]*+\n{INNER}```", f"```{INNER}```", rf"`{{3,}}{INNER}`{{3,}}"]  # the same matches
CODE_LIKE_COM = [r"(?U)\b(def|class|if|for|while|return|import|function|print|var|let|const)\b", r"[{}\[\]();=]",
                 r"^\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[=:]"]
WORDS_FIRST = r"(?U)(?=[cdfilprvw])\b(?:def|class|if|for|while|return|import|function|print|var|let|const)\b"  # of the first, a letter before the boundary
SINGLE, DOUBLE = "'" * 3, '"' * 3


def _longest(arr: Column) -> Column:
    """Longest element, first on ties (NULL for an empty array)."""
    best = F.aggregate(arr, F.lit(None).cast("string"),
                       lambda acc, x: F.when(acc.isNull() | (F.length(x) > F.length(acc)), x).otherwise(acc))
    return best


def _indented_tail(text: Column) -> Column:
    """Text from the first indented line (4 spaces or a tab, not line 1) to the end."""
    ls = lines(text)
    hit = F.filter(F.transform(ls, lambda l, i: F.when((i >= 1) & (l.startswith("    ") | l.startswith("\t")), i)),
                   lambda x: x.isNotNull())
    k = F.element_at(hit, 1)
    return F.when(F.size(hit) > 0, F.array_join(F.slice(ls, k + 1, F.size(ls) - k), NL))


def _until_last_blank(text: Column) -> Column:
    """From the first line (not line 1) that does not open a fence, up to the last empty line."""
    ls = lines(text)
    starts = F.filter(F.transform(ls, lambda l, i: F.when((i >= 1) & ~l.startswith("```"), i)), lambda x: x.isNotNull())
    blanks = F.filter(F.transform(ls, lambda l, i: F.when((i >= 1) & (l == ""), i)), lambda x: x.isNotNull())
    p, j = F.element_at(starts, 1), F.element_at(blanks, -1)
    return F.when((F.size(starts) > 0) & (F.size(blanks) > 0) & (j > p),
                  F.concat(F.array_join(F.slice(ls, p + 1, j - p), NL), F.lit(NL)))


def _com_lines(text: Column) -> Column:
    """Code-like lines start a run, non-blank lines continue it, a blank line ends it."""
    def like(l):
        return l.rlike(CODE_LIKE_COM[1]) | l.rlike(CODE_LIKE_COM[2]) | l.rlike(WORDS_FIRST)
    kept = F.flatten(F.transform(paragraphs(text), lambda p: from_first(p, like)))
    return F.when(F.size(kept) > 0, F.array_join(kept, NL))


def clean_code(code: Column) -> Column:
    return strip(F.regexp_replace(code, r"(?i)^(python|java|cpp)\n", ""))


def with_code(df: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``code``: the longest match of the first pattern that yields non-blank text,
    else the line filter, cleaned; NULL if nothing. Each candidate is worked out once, and only if those before it give nothing."""
    text = F.coalesce(F.col(response), F.lit("None"))
    def full(candidate):
        return let(strip(candidate), lambda s: F.when(s != "", s))
    fences = [full(_longest(F.regexp_extract_all(text, F.lit(p), 1))) for p in ONE_PASS_FENCES]
    found = F.coalesce(F.when(text.contains(FENCE), F.coalesce(*fences)), full(_indented_tail(text)), full(_until_last_blank(text)), _com_lines(text))
    code = F.when(text == "", F.lit(None).cast("string")).otherwise(clean_code(found))
    return df.select("*", code.alias("code"))


def normalize_com_language(field: Column) -> Column:
    low = F.lower(F.coalesce(field, F.lit("")))
    m = F.create_map(*[F.lit(x) for kv in COM_ALIASES.items() for x in kv])
    return F.coalesce(m[low], F.lit("python"))


def _runs(ls: Column, flags: Column, marker: str) -> Column:
    """Comments from full-line comment runs: one per run, contents joined by a space;
    a run of two or more lines starting on line 0 is dropped. ``ls`` and ``flags``
    (line starts with ``marker``) must be plain columns: lambdas read them per element."""
    n = F.size(ls)
    idx = F.filter(F.transform(flags, lambda f, i: F.when(f & ((i == 0) | ~F.element_at(flags, F.greatest(i, F.lit(1)))), i)),
                   lambda x: x.isNotNull())

    def run_of(s):
        rest = F.slice(flags, s + 2, n)  # flags after the run start
        stop = F.array_position(rest, False)
        length = F.when(stop == 0, n - s).otherwise(stop)
        body = F.slice(ls, s + 1, length.cast("int"))
        text = F.array_join(F.transform(body, lambda l: strip(F.substr(l, F.instr(l, marker) + len(marker)))), " ")
        return F.struct(text.alias("text"), length.cast("int").alias("n"), s.alias("s"))

    runs = F.transform(idx, run_of)
    return F.filter(runs, lambda r: ~((r["s"] == 0) & (r["n"] >= 2)))


def comments_of(code: Column, lang: Column, ls: Column, fh: Column, fs: Column) -> Column:
    """struct(comments array<string>, n_lines int) per language family (``ls`` = splitlines(code),
    ``fh``/``fs`` = line flags for ``#`` / ``//``, all precomputed columns)."""
    py_blocks = F.regexp_extract_all(code, F.lit(f"({SINGLE}{until(SINGLE)}{SINGLE}|{DOUBLE}{until(DOUBLE)}{DOUBLE})"), 1)
    py_block_txt = F.transform(py_blocks, lambda b: F.regexp_replace(F.regexp_replace(b, r"^'+|(?<!')'+$", ""), r'^"+|(?<!")"+$', ""))
    cj_blocks = before_last(code, "*/", lambda head, tail: F.regexp_extract_all(head, F.lit(rf"(/\*{until('*/')}\*/)"), 1))
    cj_block_txt = F.transform(cj_blocks, lambda b: strip(F.regexp_replace(F.regexp_replace(b, r"^[/*]+|(?<![/*])[/*]+$", ""),
                                                                           r"^[*/]+|(?<![*/])[*/]+$", "")))

    def block_lines(bs):
        return F.aggregate(bs, F.lit(0), lambda acc, b: acc + F.size(F.split(b, NL, -1)))

    py_runs, cj_runs = _runs(ls, fh, "#"), _runs(ls, fs, "//")
    inline = F.filter(ls, lambda l: ~strip(l).startswith("#") & l.contains("#"))
    inline_txt = F.transform(inline, lambda l: strip(F.substr(l, F.instr(l, "#") + 1)))
    py = F.struct(F.concat(py_block_txt, F.transform(py_runs, lambda r: r["text"]), inline_txt).alias("comments"),
                  (block_lines(py_blocks) + F.aggregate(py_runs, F.lit(0), lambda a, r: a + r["n"]) + F.size(inline))
                  .alias("n_lines"))
    cj = F.struct(F.concat(cj_block_txt, F.transform(cj_runs, lambda r: r["text"])).alias("comments"),
                  (block_lines(cj_blocks) + F.aggregate(cj_runs, F.lit(0), lambda a, r: a + r["n"])).alias("n_lines"))
    return F.when(lang == "python", py).otherwise(cj)


def pure_code(code: Column, lang: Column) -> Column:
    """Code without comments. Blocks are sought up to the last closing mark, beyond which none can end."""
    def without(c, block):
        return before_last(c, "*/", lambda head, tail: F.concat(F.regexp_replace(head, block, ""), tail))
    cj = without(without(F.regexp_replace(code, r"//.*", ""), rf"/\*{until('*/')}\*/"), rf"/\*\*{until('*/')}\*/")
    py = F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"#.*", ""), f"{SINGLE}{until(SINGLE)}{SINGLE}", ""), f"{DOUBLE}{until(DOUBLE)}{DOUBLE}", "")
    return F.when(lang == "python", py).otherwise(cj)


def identifiers(code: Column, lang: Column) -> Column:
    return let(pure_code(code, lang), lambda pc: _identifiers(pc, lang))


def _identifiers(pc: Column, lang: Column) -> Column:
    whole = F.regexp_extract_all(pc, F.lit(r"(?U)\b[a-zA-Z_][a-zA-Z0-9_]*\b"), 0)
    camel = F.regexp_extract_all(pc, F.lit(r"[a-zA-Z][a-z]*"), 0)
    snake = F.regexp_extract_all(F.replace(pc, F.lit("_"), F.lit(" ")), F.lit(r"[a-zA-Z]+"), 0)
    upper = F.regexp_extract_all(pc, F.lit(r"[A-Z]+(?:[a-z]+)?"), 0)
    allp = F.array_distinct(F.concat(camel, snake, upper, whole))
    kw = F.when(lang == "java", F.array(*map(F.lit, JAVA_KEYWORDS))) \
        .when(lang == "cpp", F.array(*map(F.lit, CPP_KEYWORDS))).otherwise(F.array(*map(F.lit, PYTHON_KEYWORDS)))
    return F.when(pc == "", F.array().cast("array<string>")).otherwise(F.array_except(allp, kw))


def comment_terms(comments: Column) -> Column:
    words = F.flatten(F.transform(comments, lambda c: F.split(strip(c), r"(?U)\s+", -1)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.lower(w)))


def cls(n: Column) -> Column:
    a = F.abs(n)
    return F.when(a <= 2, F.lit(0.0)).when(a <= 30, (a - 2) / F.lit(28.0)).otherwise(F.lit(1.0))


def comment_metrics(responses: DataFrame) -> DataFrame:
    r = with_code(responses.select("idx", "pos", "model", "programming_language", "response",
                                   normalize_com_language(F.col("programming_language")).alias("lang")))
    r = r.select("*", splitlines(F.col("code")).alias("ls"))
    r = r.select("*", F.transform("ls", lambda l: strip(l).startswith("#")).alias("fh"),
                 F.transform("ls", lambda l: strip(l).startswith("//")).alias("fs"))
    r = r.select("*", comments_of(F.col("code"), F.col("lang"), F.col("ls"), F.col("fh"), F.col("fs")).alias("cm"),
                 identifiers(F.col("code"), F.col("lang")).alias("ids"))
    r = r.select("*", comment_terms(F.col("cm.comments")).alias("terms"))
    t, i = F.col("terms"), F.col("ids")
    union = F.size(F.array_union(t, i))
    cic = F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(t, i)) / union)
    cm = F.col("cm.comments")
    avg_cls = F.when(F.size(cm) == 0, F.lit(0.0)).otherwise(
        F.aggregate(cm, F.lit(0.0), lambda a, c: a + cls(F.length(c))) / F.size(cm))
    return r.select("idx", "pos", "model", "programming_language", "lang", "code",
                    F.col("cm.n_lines").cast("int").alias("comment_lines"), F.size(cm).cast("int").alias("n_comments"),
                    F.size(i).cast("int").alias("n_identifiers"), F.size(t).cast("int").alias("n_terms"),
                    F.round(cic, 3).alias("cic"), F.round(avg_cls, 3).alias("cls"))


def ccrs(comment_lines: Column, total_lines: Column) -> Column:
    """Score of the share r of comment lines: (r / .2)^3 below .2, 1 up to .3, then e^(-5 (r - .3)); 0 without lines."""
    r = comment_lines / total_lines
    return (F.when(total_lines == 0, F.lit(0.0)).when(r < 0.2, F.pow(r / 0.2, F.lit(3.0))).when(r <= 0.3, F.lit(1.0))
            .otherwise(F.exp(-5 * (r - 0.3))))


def comment_ratio(responses: DataFrame) -> DataFrame:
    """M25 per answer: comment lines, all lines, and their ratio score (0 without code)."""
    m = comment_metrics(responses)
    total = F.coalesce(F.size(splitlines(F.col("code"))), F.lit(0))
    m = m.select("idx", "model", F.coalesce("comment_lines", F.lit(0)).alias("comment_lines"),
                 F.when(F.col("code").isNull(), 0).otherwise(total).alias("total_lines"))
    return m.select("*", F.round(ccrs(F.col("comment_lines"), F.col("total_lines")), 6).alias("ccrs"))


def graded_comment(responses: DataFrame) -> DataFrame:
    m = comment_metrics(responses)
    raw = F.round((F.lit(0.7) * F.col("cic") + F.lit(0.3) * F.col("cls")) * 30, 1)
    rungs = [("skipped_task", F.col("idx").isin(*COM_BLOCKLIST), 0.0), ("no_code", ~nonempty(F.col("code")), 0.0)]
    return m.select("idx", "pos", "model", F.coalesce(F.col("programming_language"), F.lit("python")).alias("programming_language"), *graded(rungs, raw))


def score_comment(responses: DataFrame) -> DataFrame:
    return graded_comment(responses).drop("reason", "raw")


def comment_report(responses: DataFrame) -> DataFrame:
    return regroup(score_comment(responses))
