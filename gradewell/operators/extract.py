"""Code extraction policies (one per score dimension).

Each policy is a pure Column expression over the answer text: regex
extraction, array slicing and ``coalesce`` ladders, all row-local. No policy
needs a UDF: fallbacks that "switch on and never switch off" in the
original loops collapse to "text from the first matching line on".
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradewell.functions.text import NL, let, lines, nonempty, strip, until

FENCE = "```"
INNER = f"({until(FENCE)})"  # what stands before the next fence


def _join_all(c: Column, pattern: str, group: int = 1) -> Column:
    """All non-overlapping matches of ``pattern`` joined by newline; NULL when none."""
    return let(F.regexp_extract_all(c, F.lit(pattern), group), lambda m: F.when(F.size(m) > 0, F.array_join(m, NL)))


def _suffix_from_first(c: Column, line_pred) -> Column:
    """Lines from the first one satisfying ``line_pred`` to the end, newline-joined; NULL if none."""
    ls = lines(c)
    at = F.array_position(F.transform(ls, lambda l: F.coalesce(line_pred(l), F.lit(False))), F.lit(True)).cast("int")
    return let(at, lambda k: F.when(k > 0, F.array_join(F.slice(ls, k, F.size(ls)), NL)))


# --- X4: standardization ---------------------------------------------------
def extract_std(response: Column) -> Column:
    """All tagged newline-delimited blocks, else all fence pairs, else the whole answer."""
    # The two fence patterns.
    tagged = _join_all(response, r"```(?:python|java|cpp|c\+\+)?\n(" + until(NL + FENCE) + r")\n```")
    bare = _join_all(response, f"```{INNER}```")
    return F.when(~nonempty(response), F.lit("")).otherwise(F.coalesce(tagged, bare, response))


# --- X3: simplicity --------------------------------------------------------
# Line starts that open code when no fence is present.
SIM_START_PY = ("def ", "class ", "import ", "from ", "if ", "for ", "while ")
SIM_START_CJ = ("public ", "private ", "class ", "import ", "package ", "#include", "void ", "int ")


def extract_sim(response: Column, lang: Column) -> Column:
    """All fenced blocks (optional ``lang`` tag, case-insensitive) joined, not stripped;
    else the text from the first line that starts like code; else ''."""
    py = _join_all(response, rf"(?i)```(?:python)?\s*{INNER}```")
    java = _join_all(response, rf"(?i)```(?:java)?\s*{INNER}```")
    cpp = _join_all(response, rf"(?i)```(?:c\+\+)?\s*{INNER}```")
    blocks = F.when(lang == "java", java).when(lang == "c++", cpp).otherwise(py)
    suffix = F.when(lang == "python", _suffix_from_first(response, lambda l: _starts_any(strip(l), SIM_START_PY))) \
        .otherwise(_suffix_from_first(response, lambda l: _starts_any(strip(l), SIM_START_CJ)))
    return F.when(~nonempty(response), F.lit("")).otherwise(F.coalesce(blocks, suffix, F.lit("")))


def _starts_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.startswith(w)
    return out


# --- X5: robustness --------------------------------------------------------
# Fixed value: what makes a line look like code.
CODE_LIKE = r"(?U)\b(def|class|if|for|while|return|import|function)\b|[{}\[\]();=]"
CODE_LIKE_FIRST = r"(?U)[{}\[\]();=]|(?=[cdfirw])\b(?:def|class|if|for|while|return|import|function)\b"  # the same, cheap tests first


def paragraphs(text: Column) -> Column:
    """Runs of non-blank lines, each newline-joined (linear: one pass and one split)."""
    flat = F.array_join(F.transform(lines(text), lambda l: F.when(strip(l) == "", F.lit("")).otherwise(l)), NL)
    return F.filter(F.transform(F.split(flat, r"\n{2,}"), lambda p: F.btrim(p, F.lit(NL))), lambda p: p != "")


def from_first(paragraph: Column, like) -> Column:
    """The lines of a paragraph from the first one that ``like`` accepts; no lines if none."""
    def tail(ls):
        return let(F.array_position(F.transform(ls, like), F.lit(True)).cast("int"), lambda at: F.when(
            at > 0, F.slice(ls, at, F.size(ls))).otherwise(F.array().cast("array<string>")))
    return let(F.split(paragraph, NL, -1), tail)


def _rob_lines(response: Column) -> Column:
    """Line filter: code-like lines start a run; a run keeps non-blank lines; once more than
    three lines are kept, a blank line ends the run.

    In paragraphs: nothing before the first code-like line; whole paragraphs while three or
    fewer lines are kept; then each paragraph from its first code-like line on. As each
    paragraph has a line, only the three after the first need their sizes."""
    def n_lines(p):
        return F.coalesce(F.regexp_count(p, F.lit(NL)) + 1, F.lit(0))

    def kept(ps, tails, first):
        n1 = F.size(F.get(tails, first))
        n2 = n1 + n_lines(F.get(ps, first + 1))
        n3 = n2 + n_lines(F.get(ps, first + 2))
        whole = first + F.when(n1 > 3, 0).when(n2 > 3, 1).when(n3 > 3, 2).otherwise(3)  # the last paragraph kept whole
        return let(whole, lambda last: F.concat(
            F.slice(tails, first + 1, F.lit(1)),
            F.transform(F.slice(ps, first + 2, last - first), lambda p: F.array(p)),
            F.slice(tails, last + 2, F.size(tails))))

    def filtered(ps):
        return let(F.transform(ps, lambda p: from_first(p, lambda l: l.rlike(CODE_LIKE_FIRST))), lambda tails: let(
            F.array_position(F.transform(tails, lambda t: F.size(t) > 0), F.lit(True)).cast("int") - 1,
            lambda first: F.when(first >= 0, F.array_join(F.flatten(kept(ps, tails, first)), NL)).otherwise(F.lit(""))))
    return let(paragraphs(response), filtered)


def extract_rob(response: Column) -> Column:
    """First fence pair (optional tag) stripped; else the line filter; '' when nothing."""
    pat = rf"```(?:python|java|cpp|c\+\+)?\s*{INNER}```"
    first = F.when(response.rlike(pat), strip(F.regexp_extract(response, pat, 1)))
    return F.when(~nonempty(response), F.lit("")).otherwise(F.coalesce(first, _rob_lines(response)))
