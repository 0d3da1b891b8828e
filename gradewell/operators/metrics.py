"""Scalar code metrics as Column expressions (string arithmetic, regex counts, math)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradewell.functions.text import count_sub, lines, strip

# --- simplicity -------------------------------------------------------------
# Branching keywords counted by the simplicity score.
CC_WORDS_PY = ["if", "for", "while", "and", "or", "elif", "except", "finally"]
CC_WORDS_CJ = ["if", "for", "while", "case", "catch", "&&", "||", "?"]


def loc_sim(code: Column) -> Column:
    """Non-blank lines not starting with ``#``, ``//`` or ``/*``; at least 1."""
    ls = F.transform(lines(code), lambda l: strip(l))
    n = F.size(F.filter(ls, lambda l: (l != "") & ~l.startswith("#") & ~l.startswith("//") & ~l.startswith("/*")))
    return F.greatest(F.lit(1), n).cast("long")


def cc_sim(code: Column, lang: Column) -> Column:
    """1 + occurrences of ``" kw "`` and ``"kw "`` (plain substrings) per keyword."""
    def total(words):
        s = F.lit(1).cast("long")
        for w in words:
            s = s + count_sub(code, f" {w} ") + count_sub(code, f"{w} ")
        return s
    return F.when(lang == "python", total(CC_WORDS_PY)) \
        .when(lang.isin("java", "c++"), total(CC_WORDS_CJ)).otherwise(F.lit(1).cast("long"))


def halstead_est(loc: Column) -> Column:
    return F.greatest(F.lit(1.0), (F.lit(45) * loc - 428).cast("double"))


def mi_sim(loc: Column, cc: Column, hv: Column) -> Column:
    loc, cc, hv = F.greatest(loc, F.lit(1)), F.greatest(cc, F.lit(1)), F.greatest(hv, F.lit(1.0))
    mi = F.lit(171.0) - F.lit(5.2) * F.ln(hv) - F.lit(0.23) * cc - F.lit(16.2) * F.ln(loc)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), mi))


def mi_band(mi: Column) -> Column:
    return (F.when(mi >= 85, 5.0).when(mi >= 65, 4.0).when(mi >= 50, 3.0).when(mi >= 30, 2.0).otherwise(1.0))


# --- robustness -------------------------------------------------------------
# Language features voted on by the robustness language guess.
FEATURES = {
    "python": ['def ', 'import ', 'print(', 'if __name__ == "__main__":', '# ', 'class ', 'self.', 'None', 'True', 'False'],
    "java": ['public class', 'public static void main', 'System.out.println', 'import java.', 'private ', 'protected ',
             '@Override', 'extends ', 'implements '],
    "cpp": ['#include', 'int main()', 'std::', 'cout <<', 'cin >>', 'using namespace', 'void ', 'return 0;', '->', '::'],
}


def _n_present(code: Column, feats) -> Column:
    s = F.lit(0)
    for f in feats:
        s = s + F.when(code.contains(f), 1).otherwise(0)
    return s


def lang_feature_vote(code: Column) -> Column:
    """Arg-max of feature counts (ties: python, java, cpp); below 2 a keyword ladder, else unknown."""
    p, j, c = (_n_present(code, FEATURES[k]) for k in ("python", "java", "cpp"))
    best = F.when((p >= j) & (p >= c), "python").when(j >= c, "java").otherwise("cpp")
    top = F.greatest(p, j, c)
    ladder = (F.when(code.contains("def ") | code.contains("import ") | code.contains("print("), "python")
              .when(code.contains("public class") | code.contains("public static void main"), "java")
              .when(code.contains("#include") | code.contains("int main()"), "cpp")
              .otherwise("unknown"))
    return F.when(~(code.isNotNull() & (code != "")), "unknown").when(top < 2, ladder).otherwise(best)


# Branch words counted by the fallback maintainability estimate.
MI_WORDS = {
    "python_fallback": "if|for|while|except|with|def|class",
    "java_parsed": "if|for|while|switch|catch|try|instanceof",
    "short": "if|for|while|switch|catch",
    "other": "if|for|while|switch|catch|try",
}


def mi_estimate(code: Column, words: str) -> Column:
    """``100 - (0.2 * lines + 0.5 * regex hits)`` clamped to 0..100, 1 decimal."""
    n_lines = F.size(lines(code))
    heads = "".join(sorted({w[0] for w in words.split("|")}))  # no word is tried where none can begin
    hits = F.regexp_count(code, F.lit(f"(?=[{heads}])(?:{words})"))
    mi = F.lit(100.0) - (n_lines * F.lit(0.2) + hits * F.lit(0.5))
    return F.round(F.greatest(F.lit(0.0), F.least(mi, F.lit(100.0))), 1)


def braces_balanced(code: Column) -> Column:
    return (count_sub(code, "{") == count_sub(code, "}")) & (count_sub(code, "(") == count_sub(code, ")"))


def error_handling(code: Column, lang: Column) -> Column:
    py = F.when(code.contains("try:") & code.contains("except"),
                20 + F.when(code.contains("finally:"), 10).otherwise(0)).otherwise(0)
    java = F.when(code.contains("try {") & code.contains("catch"),
                  20 + F.when(code.contains("finally"), 10).otherwise(0)).otherwise(0)
    cpp = F.when(code.contains("try {") & code.contains("catch"), 25).otherwise(0)
    return F.when(lang == "python", py).when(lang == "java", java).when(lang == "cpp", cpp).otherwise(0)


def input_validation(code: Column, lang: Column) -> Column:
    cmp_ = code.contains("if ") & (code.contains(" < ") | code.contains(" > ") | code.contains(" == "))
    second = F.when(cmp_, 10).otherwise(0)
    py = F.when(code.contains("isinstance(") | code.contains("type("), 10).otherwise(0) + second
    java = F.when(code.contains("null") & code.contains("if"), 10).otherwise(0) + second
    cpp = F.when(code.contains("nullptr") | code.contains("NULL"), 10).otherwise(0) + second
    return F.when(lang == "python", py).when(lang == "java", java).when(lang == "cpp", cpp).otherwise(0)


def resource_mgmt(code: Column, lang: Column) -> Column:
    py = F.when(code.contains("with "), 15).otherwise(0) + F.when(code.contains(".close()"), 10).otherwise(0)
    java = F.when(code.contains("try ("), 15).otherwise(0) + F.when(code.contains(".close()"), 10).otherwise(0)
    cpp = (F.when(code.contains("delete ") | code.contains("delete[]"), 15).otherwise(0)
           + F.when(code.contains("unique_ptr") | code.contains("shared_ptr"), 10).otherwise(0))
    return F.when(lang == "python", py).when(lang == "java", java).when(lang == "cpp", cpp).otherwise(0)
