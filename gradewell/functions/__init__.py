from gradewell.functions.text import (strip, lstrip, rstrip, indent, lines, splitlines, count_sub,
                                      contains_any, rlike_any, is_blank, nonempty)

__all__ = ["strip", "lstrip", "rstrip", "indent", "lines", "splitlines", "count_sub",
           "contains_any", "rlike_any", "is_blank", "nonempty"]
