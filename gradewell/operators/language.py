"""Language detection and normalisation (CASE ladders over literal regexes)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradewell.functions.text import contains_any, let


def lang_instruction(instr: Column) -> Column:
    """Language named by the instruction text; content hints next; python by default."""
    low = F.lower(F.coalesce(instr, F.lit("")))
    raw = F.coalesce(instr, F.lit(""))
    return (F.when(low.contains("python"), "python")
            .when(low.contains("java"), "java")
            .when(low.contains("cpp") | low.contains("c++"), "cpp")
            .when(contains_any(raw, ["def ", "import ", "print("]), "python")
            .when(contains_any(raw, ["public class", "System.out"]), "java")
            .when(contains_any(raw, ["cout <<", "#include"]), "cpp")
            .otherwise("python"))


# What code of each language shows, in order; python where nothing does.
CODE_SIGNS = [("python", r"(?U)def\s+\w+\s*\(|import\s+\w+|print\("), ("java", r"(?U)public\s+class|System\.out\.|public\s+static\s+void\s+main"),
              ("cpp", r"(?U)#include|std::|cout\s*<<")]


def lang_code_rules(code: Column) -> Column:
    """The language that a piece of code shows; unknown without code. The code, itself a search, is worked out once."""
    def shown(c):
        out = F.when(c.isNull() | (c == ""), "unknown")
        for lang, pattern in CODE_SIGNS:
            out = out.when(c.rlike(pattern), lang)
        return out.otherwise("python")
    return let(code, shown)
