"""Code in free text for the modularity scorer: fenced blocks, runs of code-like lines, whole texts
with enough signs of code; and the repair of Python code before it is parsed. Folds over the lines of one answer that carry a few numbers, so an answer
of any length takes linear time."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradewell.functions.text import NL, before_last, count_sub, indent, let, lines, strip

# What makes a stripped line look like code.
CODE_MARKERS = [
    r"^(def|class|if|for|while|import|from|try|except|return|with)\s", r":\s*$", r"=\s*[\w\[\{\(]", r"^[\s]*[\w\.]+\(",
    r"^\s*@\w+", r"^\s*#", r"^\s*\/\/", r"^\s*\/\*", r"^\s*\*\/", r"^\s*\{|\}$", r"^\s*public|private|protected",
    r"^\s*function\s+\w+", r"^\s{2,}[^\s]", r"^\t+[^\t]",
]
# Signs of code in a whole text; INDICATORS of them make it code.
SIGNS = [r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+", r"\bimport\s+\w+", r"\bfrom\s+\w+\s+import", r":\s*$", r"\breturn\s+", r"=\s*[\w\[\{\(]", r"^\s{4}"]
SIGN_PARTS = ["def", "class", "import", "import", ":", "return", "=", ""]  # what a text with the sign contains
HEADED = ["if", "for"]  # r"\b<word>\s+.*:"
INDICATORS = 3
LEAST_LINES, LEAST_TEXT = 6, 31
MARKUP_LINES = [r"#+\s*.*?\n", r">\s*.*?\n"]
MARKUP_SPANS = [r"\*\*.*?\*\*", r"\*.*?\*"]


def _body(text: Column) -> Column:
    """Lines between two fences without leading and trailing blank lines."""
    def trimmed(t):
        base = F.regexp_replace(t, r"(?<!\s)\s+$", "")
        rest = F.regexp_extract(F.substring(t, F.length(base) + 1, F.length(t)), r"^[^\n]*", 0)
        return F.when(F.trim(base) == "", F.lit("")).otherwise(F.concat(base, rest))
    return let(F.regexp_replace(text, r"^\s*\n", ""), trimmed)


def longest_fence(text: Column, plain: bool) -> Column:
    """Longest block (first on ties) from a fence to the next one that starts a line, with a line that is not
    blank between them (a fence is one, too); NULL without any. ``plain``: nothing may follow the opening
    fence on its line."""
    def opens(line):
        return line.rlike(r"```\s*$") if plain else line.contains("```")

    def fold(ls):
        at = F.filter(F.transform(ls, lambda l, i: F.when(l.contains("```"), i)), lambda i: i.isNotNull())

        def step(a, i):
            line, start = F.get(ls, i), a["open"]
            between = F.slice(ls, start + 2, i - start - 1)
            closes = F.when((start >= 0) & line.rlike(r"^\s*```"), F.exists(between, lambda l: l.rlike(r"\S"))).otherwise(False)
            left = (F.when(closes, F.when(opens(F.regexp_replace(line, r"^\s*```", "")), i).otherwise(-1))
                    .when(start >= 0, start).when(opens(line), i).otherwise(-1))
            body = let(_body(F.array_join(between, NL)),
                       lambda b: F.when(a["best"].isNull() | (F.length(b) > F.length(a["best"])), b).otherwise(a["best"]))
            return F.struct(left.alias("open"), F.when(closes, body).otherwise(a["best"]).alias("best"))
        return F.aggregate(at, F.struct(F.lit(-1).alias("open"), F.lit(None).cast("string").alias("best")), step, lambda a: a["best"])
    return let(lines(text), fold)


def code_blocks(text: Column) -> Column:
    """The longest run of LEAST_LINES lines or more (first on ties): it starts at a code-like line and goes
    on over blank lines, lines of at least its indent and code-like lines. NULL without any."""
    marked = "(?U)" + "|".join(f"(?:{p})" for p in CODE_MARKERS)

    def fold(ls):
        rows = F.transform(ls, lambda l: let(strip(l), lambda s: F.struct(
            indent(l).alias("indent"), (s == "").alias("blank"), s.rlike(marked).alias("like"), (F.length(l) + 1).alias("size"))))
        none = F.struct(*(F.lit(v).alias(n) for n, v in (("i", 0), ("start", -1), ("indent", 0), ("size", 0), ("best", -1), ("lines", 0), ("chars", 0))))

        def closed(a):
            """The best run once the current one ends before line i."""
            better = (a["start"] >= 0) & (a["i"] - a["start"] >= LEAST_LINES) & (a["size"] > a["chars"])
            pick = lambda x, y: F.when(better, x).otherwise(y)
            return [pick(a["start"], a["best"]).alias("best"), pick(a["i"] - a["start"], a["lines"]).alias("lines"), pick(a["size"], a["chars"]).alias("chars")]

        def step(a, x):
            goes_on = (a["start"] >= 0) & (x["blank"] | (x["indent"] >= a["indent"]) | x["like"])
            starts = (a["start"] < 0) & x["like"]
            now = [F.when(starts, a["i"]).when(goes_on, a["start"]).otherwise(-1).alias("start"),
                   F.when(starts, x["indent"]).otherwise(a["indent"]).alias("indent"),
                   F.when(starts, x["size"]).when(goes_on, a["size"] + x["size"]).otherwise(0).alias("size")]
            ends = (a["start"] >= 0) & ~goes_on
            kept = [F.when(ends, c).otherwise(a[n]).alias(n) for c, n in zip(closed(a), ("best", "lines", "chars"))]
            return F.struct((a["i"] + 1).alias("i"), *now, *kept)
        found = F.aggregate(rows, none, step, lambda a: F.struct(*closed(a)))
        return let(found, lambda b: F.when(b["best"] >= 0, F.array_join(F.slice(ls, b["best"] + 1, b["lines"]), NL)))
    return let(lines(text), fold)


def without_markup(text: Column) -> Column:
    """Text without headings, quotes and emphasis."""
    out = text
    for p in MARKUP_LINES:  # beyond the last line end nothing can match; nor does anything without the first mark
        out = let(out, lambda t: F.when(t.contains(p[0]), before_last(t, NL, lambda head, tail: F.concat(  # noqa: B023
            F.regexp_replace(head, "(?d)(?U)" + p, ""), tail))).otherwise(t))  # noqa: B023
    for p in MARKUP_SPANS:
        out = let(out, lambda t: F.when(t.contains("*"), F.regexp_replace(t, "(?d)(?U)" + p, "")).otherwise(t))  # noqa: B023
    return out


def has_code_indicators(text: Column) -> Column:
    """Whether INDICATORS signs of code occur."""
    n = sum((F.when(text.contains(part) & text.rlike("(?U)(?d)(?m)" + p), 1).otherwise(0) for p, part in zip(SIGNS, SIGN_PARTS)), F.lit(0))
    for word in HEADED:  # a word, white space and a colon on the line that follows it
        own = F.regexp_replace(text, rf"(?U)\b{word}\s*\n\s*", word + " ")
        hit = F.exists(lines(own), lambda l: before_last(l, ":", lambda head, tail: head).rlike(rf"(?U)\b{word}\s"))  # noqa: B023
        n = n + F.when(text.contains(word) & text.contains(":") & hit, 1).otherwise(0)
    return n >= INDICATORS


def loose_text(text: Column) -> Column:
    """The text without markup if that is long enough and looks like code, else NULL."""
    return let(without_markup(text), lambda t: F.when((F.length(strip(t)) >= LEAST_TEXT) & has_code_indicators(t), t))


def repaired(code: Column) -> Column:
    """Python code as it is parsed: lines that leave a string open go, unless they end in three quotes (then
    the string stays open over the next line); brackets left open, of whatever kind, are closed by as many ')'.

    Only a line after one that ends in three quotes can begin inside a string, and such lines always stay. So
    lines are taken in runs that end with the first line without that end: a fold over a run's quotes says
    whether its last line stays."""
    def quotes(line, state):
        """The quote that is open after a line; a quote behind a backslash does not close."""
        found = F.regexp_extract_all(line, F.lit(r"(\\?['\"])"), 1)
        return F.aggregate(found, state, lambda s, t: F.when(s == "", F.right(t, F.lit(1))).when(s == t, F.lit("")).otherwise(s))

    def kept(ls, triple):
        heads = F.filter(F.transform(ls, lambda l, i: F.when((i == 0) | ~F.get(triple, i - 1), i)), lambda i: i.isNotNull())

        def run(head, k, starts):
            n = F.coalesce(F.get(starts, k + 1), F.size(ls)) - head
            return let(F.slice(ls, head + 1, n), lambda r: F.when(
                F.get(triple, head + n - 1) | (F.aggregate(r, F.lit(""), lambda s, l: quotes(l, s)) == ""), r).otherwise(F.slice(r, F.lit(1), n - 1)))
        return let(heads, lambda starts: F.flatten(F.transform(starts, lambda h, k: run(h, k, starts))))

    def closed(text):
        open_ = sum((count_sub(text, c) for c in "([{"), F.lit(0)) - sum((count_sub(text, c) for c in ")]}"), F.lit(0))
        return F.concat(text, F.repeat(F.lit(")"), F.greatest(open_, F.lit(0)).cast("int")))
    return let(lines(code), lambda ls: let(
        F.transform(ls, lambda l: l.rlike(r"(?U)(?:\"{3}|'{3})\s*$")), lambda t: let(F.array_join(kept(ls, t), NL), closed)))
