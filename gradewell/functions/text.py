"""String helpers with Python ``str`` semantics, built from Spark SQL functions.

Everything here returns a ``Column`` and stays inside the JVM (no UDF), so
the expressions are compiled into whole-stage code and run per row without
any shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

NL = "\n"
# Unicode's white space, the characters that ``(?U)\\s`` matches and ``str.strip`` removes from prose.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def until(mark: str) -> str:
    """Pattern of the text up to the next ``mark`` (two characters or more), which the caller's pattern goes on with.
    It matches what ``[\\s\\S]*?`` before the mark does, in one pass that keeps no way back."""
    first, rest = re.escape(mark[0]), re.escape(mark[1:])
    return rf"[^{first}]*+(?:{first}(?!{rest})[^{first}]*+)*+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(c: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def before_last(c: Column, mark: str, body) -> Column:
    """``body`` of the text up to and with the last ``mark`` ('' without one) and of the rest."""
    def parts(t):
        after = F.instr(F.reverse(t), mark[::-1])
        return let(F.when(after > 0, F.length(t) - after + 1).otherwise(0),
                   lambda n: body(F.substring(t, F.lit(1), n), F.substring(t, n + 1, F.length(t))))
    return let(c, parts)


def strip(c) -> Column:
    """``str.strip()``: Spark ``trim`` only removes spaces, this removes all whitespace."""
    return F.btrim(_c(c), F.lit(WHITE))


def lstrip(c) -> Column:
    return F.ltrim(_c(c), F.lit(WHITE))


def rstrip(c) -> Column:
    return F.rtrim(_c(c), F.lit(WHITE))


def indent(c) -> Column:
    """``len(s) - len(s.lstrip())``."""
    return F.length(_c(c)) - F.length(lstrip(c))


def lines(c) -> Column:
    """``s.split('\\n')`` — keeps trailing empty elements."""
    return F.split(_c(c), NL, -1)


def splitlines(c) -> Column:
    """``s.splitlines()`` for ``\\n``/``\\r\\n``/``\\r`` text: one trailing empty element dropped, '' -> []."""
    parts = F.split(_c(c), r"\r\n|\r|\n", -1)
    n = F.size(parts)
    return F.when(_c(c) == "", F.array().cast("array<string>")) \
        .when(F.element_at(parts, -1) == "", F.slice(parts, 1, n - 1)) \
        .otherwise(parts)


def count_sub(c, sub: str) -> Column:
    """``s.count(sub)`` — non-overlapping occurrences, as arithmetic on lengths in bytes (which need no pass over the text)."""
    c = _c(c)
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(sub), F.lit("")))) / F.lit(len(sub.encode()))).cast("long")


def contains_any(c, subs) -> Column:
    c = _c(c)
    out = F.lit(False)
    for s in subs:
        out = out | c.contains(s)
    return out


def rlike_any(c, patterns) -> Column:
    c = _c(c)
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def is_blank(c) -> Column:
    return strip(c) == ""


def nonempty(c) -> Column:
    """Python truthiness of a string: not NULL and not ''."""
    c = _c(c)
    return c.isNotNull() & (c != "")
