"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark plans: the same fixed rule values, but
the evaluation is DuckDB's (RE2 regex, list lambdas). Tables are the
driver's pre-registered views; the corpus comes from ``CORPUS_CTES``.
"""

from __future__ import annotations

from gradewell.operators.rules import STD_RULES
from gradewell.sources.corpus import oracle_with

N = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_round(x: str, d: int) -> str:
    """Round like Spark: the double's shortest decimal text, rounded half-up."""
    return f"CAST(round(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, 17)), {d}) AS DOUBLE)"


def sql_lang_instruction(col: str = "instruction") -> str:
    i = f"coalesce({col}, '')"
    return f"""CASE WHEN contains(lower({i}), 'python') THEN 'python'
      WHEN contains(lower({i}), 'java') THEN 'java'
      WHEN contains(lower({i}), 'cpp') OR contains(lower({i}), 'c++') THEN 'cpp'
      WHEN contains({i}, 'def ') OR contains({i}, 'import ') OR contains({i}, 'print(') THEN 'python'
      WHEN contains({i}, 'public class') OR contains({i}, 'System.out') THEN 'java'
      WHEN contains({i}, 'cout <<') OR contains({i}, '#include') THEN 'cpp'
      ELSE 'python' END"""


def sql_join_all(col: str, pattern: str, group: int = 1) -> str:
    m = f"regexp_extract_all({col}, {q(pattern)}, {group})"
    return f"CASE WHEN len({m}) > 0 THEN array_to_string({m}, {N}) END"


def sql_extract_std(col: str = "response") -> str:
    return (f"coalesce({sql_join_all(col, r'```(?:python|java|cpp|c\+\+)?\n([\s\S]*?)\n```')}, "
            f"{sql_join_all(col, r'```([\s\S]*?)```')}, {col})")


def unicode_words(pattern: str) -> str:
    """RE2's ``\\w`` is ASCII; the rules mean any letter, mark, digit or connector."""
    return pattern.replace(r"\w", r"[\p{L}\p{M}\p{Nd}\p{Pc}]")


def sql_rule_penalty(code: str, lang: str) -> str:
    parts = []
    for lg, rules in STD_RULES.items():
        s = " + ".join(f"(CASE WHEN regexp_matches({code}, {q(unicode_words(p))}) THEN {pen} ELSE 0.0 END)" for p, pen, _ in rules)
        parts.append(f"WHEN {lang} = '{lg}' THEN ({s})")
    return f"CAST(CASE {' '.join(parts)} ELSE 0.0 END AS DECIMAL(6,1))"


def sql_indent(x: str) -> str:
    return f"length(regexp_extract({x}, '^\\s*', 0))"


def sql_indent_breaks(code: str) -> str:
    ls = f"string_split({code}, {N})"
    return (f"CAST(len(list_filter(range(2, len({ls}) + 1), lambda i: "
            f"regexp_matches({ls}[i], '\\S') AND regexp_matches({ls}[i - 1], '\\S') "
            f"AND abs({sql_indent(f'{ls}[i]')} - {sql_indent(f'{ls}[i - 1]')}) NOT IN (0, 4))) AS BIGINT)")


def _std_base() -> str:
    return oracle_with(f"""
std_in AS (
  SELECT idx, pos, model, programming_language, {sql_lang_instruction()} AS lang, {sql_extract_std()} AS code
  FROM responses WHERE response IS NOT NULL AND response <> ''),
std_scored AS (
  SELECT idx, pos, model, coalesce(programming_language, lang) AS programming_language, lang, code,
    CASE WHEN code = '' THEN 0.0 ELSE CAST(greatest(0.0, least(10.0,
      10.0 - {sql_rule_penalty('code', 'lang')} - 0.2 * {sql_indent_breaks('code')})) * 3 AS DOUBLE) END AS score
  FROM std_in)""")


def score_standardization() -> str:
    return _std_base() + "SELECT idx, pos, model, programming_language, score FROM std_scored"


def standardization_report() -> str:
    return _std_base() + """SELECT idx, max(programming_language) AS programming_language,
  max(score) FILTER (WHERE model = 'gpt') AS gpt, max(score) FILTER (WHERE model = 'claude') AS claude,
  max(score) FILTER (WHERE model = 'deepseek') AS deepseek, max(score) FILTER (WHERE model = 'qwen') AS qwen
FROM std_scored GROUP BY idx"""


def rule_violations() -> str:
    rows = []
    for lg, rules in STD_RULES.items():
        for n, (p, pen, _) in enumerate(rules, start=1):
            rows.append(f"('{lg}', {n}, {q(unicode_words(p))}, {pen})")
    return _std_base() + f"""SELECT s.lang, r.rule_no, count(*) AS n_answers, CAST(sum(r.penalty) AS DOUBLE) AS penalty_total
FROM std_scored s JOIN (VALUES {', '.join(rows)}) r(lang, rule_no, pattern, penalty)
  ON s.lang = r.lang AND regexp_matches(s.code, r.pattern)
WHERE s.code <> ''
GROUP BY s.lang, r.rule_no"""


def indent_break_counts() -> str:
    return _std_base() + f"SELECT idx, model, {sql_indent_breaks('code')} AS indent_breaks FROM std_scored"


# --- shared text helpers ------------------------------------------------------
def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_count(code: str, sub: str) -> str:
    return f"CAST((length({code}) - length(replace({code}, {q(sub)}, ''))) // {len(sub)} AS BIGINT)"


def sql_starts_any(x: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(w)})" for w in words) + ")"


def sql_suffix_from_first(col: str, line_pred) -> str:
    ls = f"string_split({col}, {N})"
    hits = f"list_filter(range(1, len({ls}) + 1), lambda i: {line_pred(f'{ls}[i]')})"
    return f"CASE WHEN len({hits}) > 0 THEN array_to_string(list_slice({ls}, {hits}[1], len({ls})), {N}) END"


def nonempty_sql(col: str) -> str:
    return f"({col} IS NOT NULL AND {col} <> '')"


# --- simplicity -----------------------------------------------------------------
def _sim_base() -> str:
    from gradewell.operators.extract import SIM_START_CJ, SIM_START_PY
    from gradewell.operators.metrics import CC_WORDS_CJ, CC_WORDS_PY

    def blocks(tag):
        return sql_join_all("response", f"(?i)```(?:{tag})?[\\s\\n]*([\\s\\S]*?)```")

    py_sfx = sql_suffix_from_first("response", lambda l: sql_starts_any(sql_strip(l), SIM_START_PY))
    cj_sfx = sql_suffix_from_first("response", lambda l: sql_starts_any(sql_strip(l), SIM_START_CJ))
    ls = "string_split(code, chr(10))"
    loc = (f"greatest(1, len(list_filter({ls}, lambda l: {sql_strip('l')} <> '' AND NOT starts_with({sql_strip('l')}, '#') "
           f"AND NOT starts_with({sql_strip('l')}, '//') AND NOT starts_with({sql_strip('l')}, '/*'))))")

    def cc(words):
        return "1 + " + " + ".join(f"{sql_count('code', ' ' + w + ' ')} + {sql_count('code', w + ' ')}" for w in words)

    return oracle_with(f"""
sim_t AS (
  SELECT idx, max(CASE WHEN model = 'base' THEN CASE
      WHEN contains(coalesce(response, ''), '```java') OR contains(coalesce(response, ''), 'import java.') THEN 'java'
      WHEN contains(coalesce(response, ''), '```c++') OR contains(coalesce(response, ''), '#include') THEN 'c++'
      ELSE 'python' END END) AS bl
  FROM responses GROUP BY idx),
sim_r AS (
  SELECT r.idx, r.pos, r.model, coalesce(t.bl, 'python') AS programming_language, r.response
  FROM responses r JOIN sim_t t ON r.idx = t.idx),
sim_c AS (
  SELECT *, CASE WHEN NOT {nonempty_sql('response')} THEN '' ELSE coalesce(
      CASE programming_language WHEN 'java' THEN {blocks('java')} WHEN 'c++' THEN {blocks('c\\+\\+')} ELSE {blocks('python')} END,
      CASE WHEN programming_language = 'python' THEN {py_sfx} ELSE {cj_sfx} END, '') END AS code
  FROM sim_r),
sim_m AS (
  SELECT *, CAST({loc} AS BIGINT) AS loc,
    CAST(CASE WHEN programming_language = 'python' THEN {cc(CC_WORDS_PY)}
         WHEN programming_language IN ('java', 'c++') THEN {cc(CC_WORDS_CJ)} ELSE 1 END AS BIGINT) AS cc
  FROM sim_c),
sim_h AS (SELECT *, greatest(1.0, CAST(45 * loc - 428 AS DOUBLE)) AS hv FROM sim_m),
sim_mi AS (
  SELECT *, greatest(0.0, least(100.0, 171.0 - 5.2 * ln(greatest(hv, 1.0)) - 0.23 * greatest(cc, 1)
      - 16.2 * ln(greatest(loc, 1)))) AS mi
  FROM sim_h),
sim_s AS (
  SELECT *, CASE WHEN {nonempty_sql('response')} AND code <> '' THEN round(6 * CASE WHEN mi >= 85 THEN 5.0 WHEN mi >= 65 THEN 4.0
      WHEN mi >= 50 THEN 3.0 WHEN mi >= 30 THEN 2.0 ELSE 1.0 END, 1) ELSE 0.0 END AS score
  FROM sim_mi)""")


def score_simplicity() -> str:
    return _sim_base() + "SELECT idx, pos, model, programming_language, CAST(score AS DOUBLE) AS score FROM sim_s"


def simplicity_metrics() -> str:
    return _sim_base() + "SELECT idx, model, loc, cc, round(hv, 6) AS hv, round(mi, 6) AS mi FROM sim_s"


# --- robustness -------------------------------------------------------------------
def sql_rob_lines(col: str) -> str:
    like = "regexp_matches(l, '\\b(def|class|if|for|while|return|import|function)\\b|[{}\\[\\]();=]')"
    blank = f"({sql_strip('l')} = '')"
    take = f"({like} OR (acc.on AND NOT {blank}))"
    step = (f"{{'on': CASE WHEN {like} THEN true WHEN acc.on AND {blank} AND acc.n > 3 THEN false ELSE acc.on END, "
            f"'n': acc.n + CASE WHEN {take} THEN 1 ELSE 0 END, "
            f"'out': CASE WHEN {take} THEN list_append(acc.out, l) ELSE acc.out END}}")
    kept = (f"list_reduce(string_split({col}, {N}), lambda acc, l: {step}, "
            f"{{'on': false, 'n': 0, 'out': []::VARCHAR[]}}).out")
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, {N}) ELSE '' END"


def sql_extract_rob(col: str = "response") -> str:
    pat = q(r"```(?:python|java|cpp|c\+\+)?\s*([\s\S]*?)```")
    return (f"CASE WHEN NOT {nonempty_sql(col)} THEN '' WHEN regexp_matches({col}, {pat}) "
            f"THEN {sql_strip(f'regexp_extract({col}, {pat}, 1)')} ELSE {sql_rob_lines(col)} END")


def sql_lang_feature_vote(code: str) -> str:
    from gradewell.operators.metrics import FEATURES

    def n(lang):
        return "(" + " + ".join(f"CASE WHEN contains({code}, {q(f)}) THEN 1 ELSE 0 END" for f in FEATURES[lang]) + ")"
    p, j, c = n("python"), n("java"), n("cpp")
    return f"""CASE WHEN {code} IS NULL OR {code} = '' THEN 'unknown'
      WHEN greatest({p}, {j}, {c}) < 2 THEN CASE
        WHEN contains({code}, 'def ') OR contains({code}, 'import ') OR contains({code}, 'print(') THEN 'python'
        WHEN contains({code}, 'public class') OR contains({code}, 'public static void main') THEN 'java'
        WHEN contains({code}, '#include') OR contains({code}, 'int main()') THEN 'cpp' ELSE 'unknown' END
      WHEN {p} >= {j} AND {p} >= {c} THEN 'python' WHEN {j} >= {c} THEN 'java' ELSE 'cpp' END"""


def sql_mi_estimate(code: str, words: str) -> str:
    return (f"CAST(round(greatest(0.0, least(100.0 - (len(string_split({code}, {N})) * 0.2 "
            f"+ len(regexp_extract_all({code}, '({words})', 1)) * 0.5), 100.0)), 1) AS DOUBLE)")


def robustness_components() -> str:
    from gradewell.operators.metrics import MI_WORDS
    fld = "coalesce(programming_language, '')"
    detect = (f"(lower({fld}) = '' OR {fld} = 'python或Java或C++' OR contains(lower({fld}), 'python') "
              f"OR contains(lower({fld}), 'java') OR contains(lower({fld}), 'c++'))")
    eh = """CASE lang WHEN 'python' THEN CASE WHEN contains(code, 'try:') AND contains(code, 'except')
          THEN 20 + CASE WHEN contains(code, 'finally:') THEN 10 ELSE 0 END ELSE 0 END
        WHEN 'java' THEN CASE WHEN contains(code, 'try {') AND contains(code, 'catch')
          THEN 20 + CASE WHEN contains(code, 'finally') THEN 10 ELSE 0 END ELSE 0 END
        WHEN 'cpp' THEN CASE WHEN contains(code, 'try {') AND contains(code, 'catch') THEN 25 ELSE 0 END ELSE 0 END"""
    cmp_ = "CASE WHEN contains(code, 'if ') AND (contains(code, ' < ') OR contains(code, ' > ') OR contains(code, ' == ')) THEN 10 ELSE 0 END"
    iv = f"""CASE lang WHEN 'python' THEN (CASE WHEN contains(code, 'isinstance(') OR contains(code, 'type(') THEN 10 ELSE 0 END) + {cmp_}
        WHEN 'java' THEN (CASE WHEN contains(code, 'null') AND contains(code, 'if') THEN 10 ELSE 0 END) + {cmp_}
        WHEN 'cpp' THEN (CASE WHEN contains(code, 'nullptr') OR contains(code, 'NULL') THEN 10 ELSE 0 END) + {cmp_} ELSE 0 END"""
    rm = """CASE lang WHEN 'python' THEN (CASE WHEN contains(code, 'with ') THEN 15 ELSE 0 END) + (CASE WHEN contains(code, '.close()') THEN 10 ELSE 0 END)
        WHEN 'java' THEN (CASE WHEN contains(code, 'try (') THEN 15 ELSE 0 END) + (CASE WHEN contains(code, '.close()') THEN 10 ELSE 0 END)
        WHEN 'cpp' THEN (CASE WHEN contains(code, 'delete ') OR contains(code, 'delete[]') THEN 15 ELSE 0 END)
          + (CASE WHEN contains(code, 'unique_ptr') OR contains(code, 'shared_ptr') THEN 10 ELSE 0 END) ELSE 0 END"""
    bal = (f"({sql_count('code', '{')} = {sql_count('code', '}')} AND {sql_count('code', '(')} = {sql_count('code', ')')})")
    return oracle_with(f"""
rob_c AS (SELECT idx, pos, model, programming_language, response, {sql_extract_rob()} AS code FROM responses),
rob_l AS (
  SELECT *, CASE WHEN l0 IN ('c++', 'c', 'cpp') THEN 'cpp' WHEN l0 IN ('python', 'java') THEN l0 ELSE 'unknown' END AS lang
  FROM (SELECT *, CASE WHEN {detect} THEN {sql_lang_feature_vote('code')} ELSE lower({fld}) END AS l0 FROM rob_c))""") + f"""
SELECT idx, pos, model, programming_language, lang, code,
  length({sql_strip('code')}) < 20 AS too_short,
  CAST({eh} AS INTEGER) AS error_handling, CAST({iv} AS INTEGER) AS input_validation, CAST({rm} AS INTEGER) AS resource_mgmt,
  {sql_mi_estimate('code', MI_WORDS['python_fallback'])} AS mi_python_fallback,
  CASE WHEN {bal} THEN {sql_mi_estimate('code', MI_WORDS['java_parsed'])} ELSE {sql_mi_estimate('code', MI_WORDS['short'])} END AS mi_java,
  {sql_mi_estimate('code', MI_WORDS['short'])} AS mi_cpp
FROM rob_l"""


# --- efficiency -------------------------------------------------------------------
def efficiency_inputs() -> str:
    from gradewell.plans.efficiency import (CPP_METHOD, CPP_OUT, EFF_BARE, EFF_LINE_START, EFF_TAGGED, GUESS,
                                            JAVA_METHOD, JAVA_OUT, PARAMS, RETURN, STATEMENT_PATTERNS)

    def guess(code):
        return "CASE " + " ".join(f"WHEN regexp_matches({code}, {q(p)}) THEN '{lg}'" for lg, p in GUESS) + " ELSE '' END"

    ls = f"string_split(response, {N})"
    hits = (f"list_filter(range(1, len({ls}) + 1), lambda i: regexp_matches({ls}[i], {q(EFF_LINE_START[0])}) "
            f"OR regexp_matches({ls}[i], {q(EFF_LINE_START[1])}))")
    suffix = f"array_to_string(list_slice({ls}, {hits}[1], len({ls})), {N})"

    def cnt(p):
        return f"CAST(len(regexp_extract_all(code, {q(p)}, 0)) AS BIGINT)"

    stmts = " + ".join(cnt(p) for p in STATEMENT_PATTERNS)
    ps = f"regexp_extract_all(code, {q(PARAMS)}, 0)"
    max_in = (f"CAST(coalesce(list_max(list_transform(list_filter({ps}, lambda p: regexp_replace(p, '^[()]+|[()]+$', '', 'g') <> ''), "
              f"lambda p: {sql_count('p', ',')} + 1)), 0) AS BIGINT)")
    loc = (f"CAST(len(list_filter(string_split({sql_strip('code')}, {N}), lambda l: {sql_strip('l')} <> '' "
           f"AND NOT regexp_matches(l, '^\\s*[{{}}()\\[\\]]*\\s*$'))) AS BIGINT)")
    return oracle_with(f"""
eff_x AS (
  SELECT idx, pos, model, programming_language, response,
    CASE WHEN response IS NULL THEN {{'code': '', 'tag': ''}}
      WHEN regexp_matches(response, {q(EFF_TAGGED)}) THEN {{'code': regexp_extract(response, {q(EFF_TAGGED)}, 2),
                                                        'tag': lower(regexp_extract(response, {q(EFF_TAGGED)}, 1))}}
      WHEN regexp_matches(response, {q(EFF_BARE)}) THEN {{'code': regexp_extract(response, {q(EFF_BARE)}, 1), 'tag': ''}}
      WHEN len({hits}) > 0 THEN {{'code': {suffix}, 'tag': {guess(suffix)}}}
      ELSE {{'code': '', 'tag': ''}} END AS x
  FROM responses),
eff_l AS (
  SELECT idx, pos, model, programming_language, response, x.code AS code, x.tag AS tag,
    lower(CASE WHEN (CASE WHEN x.tag <> '' THEN x.tag ELSE coalesce(programming_language, 'python') END) = ''
      THEN {guess('x.code')} ELSE (CASE WHEN x.tag <> '' THEN x.tag ELSE coalesce(programming_language, 'python') END) END) AS lang
  FROM eff_x)""") + f"""
SELECT *, CASE WHEN lang = 'python' THEN 'python' WHEN lang = 'java' THEN 'java' WHEN lang IN ('cpp', 'c++') THEN 'cpp'
    ELSE 'base' END AS analyzer,
  {loc} AS loc, {cnt(JAVA_METHOD)} AS java_methods, {cnt(CPP_METHOD)} AS cpp_methods,
  {stmts} AS regex_statements, {max_in} AS regex_max_inputs,
  {cnt(JAVA_OUT)} + {cnt(RETURN)} AS java_outputs, {cnt(CPP_OUT)} + {cnt(RETURN)} AS cpp_outputs
FROM eff_l"""


# --- comment ------------------------------------------------------------------------
def _sql_list(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def _sql_longest(lst: str) -> str:
    return (f"list_reduce({lst}, lambda acc, x: CASE WHEN acc IS NULL OR length(x) > length(acc) THEN x ELSE acc END, "
            f"NULL::VARCHAR)")


def _sql_splitlines(c: str) -> str:
    parts = f"string_split_regex({c}, '\\r\\n|\\r|\\n')"
    return (f"(CASE WHEN {c} = '' THEN []::VARCHAR[] WHEN {parts}[-1] = '' THEN list_slice({parts}, 1, len({parts}) - 1) "
            f"ELSE {parts} END)")


def _sql_runs(ls: str, marker: str) -> str:
    flags = f"list_transform({ls}, lambda l: starts_with({sql_strip('l')}, {q(marker)}))"
    starts = (f"list_filter(range(1, len({ls}) + 1), lambda i: {flags}[i] AND (i = 1 OR NOT {flags}[greatest(i - 1, 1)]))")
    stop = f"coalesce(list_position(list_slice({flags}, s + 1, len({ls})), false), 0)"
    length = f"(CASE WHEN {stop} = 0 THEN len({ls}) - s + 1 ELSE {stop} END)"
    body = f"list_slice({ls}, s, s + {length} - 1)"
    text = (f"array_to_string(list_transform({body}, lambda l: {sql_strip(f'substr(l, strpos(l, {q(marker)}) + {len(marker)})')}), ' ')")
    runs = f"list_transform({starts}, lambda s: {{'text': {text}, 'n': {length}, 's': s}})"
    return f"list_filter({runs}, lambda r: NOT (r.s = 1 AND r.n >= 2))"


def _sql_extract_com(col: str) -> str:
    from gradewell.plans.comment import CODE_LIKE_COM, FENCE_PATTERNS
    text = f"coalesce({col}, 'None')"
    cands = [sql_strip(_sql_longest(f"regexp_extract_all({text}, {q(p)}, 1)")) for p in FENCE_PATTERNS]
    ls = f"string_split({text}, {N})"
    ind = f"list_filter(range(2, len({ls}) + 1), lambda i: starts_with({ls}[i], '    ') OR starts_with({ls}[i], chr(9)))"
    cands.append(sql_strip(f"CASE WHEN len({ind}) > 0 THEN array_to_string(list_slice({ls}, {ind}[1], len({ls})), {N}) END"))
    st = f"list_filter(range(2, len({ls}) + 1), lambda i: NOT starts_with({ls}[i], '```'))"
    bl = f"list_filter(range(2, len({ls}) + 1), lambda i: {ls}[i] = '')"
    cands.append(sql_strip(f"CASE WHEN len({st}) > 0 AND len({bl}) > 0 AND {bl}[-1] > {st}[1] "
                           f"THEN array_to_string(list_slice({ls}, {st}[1], {bl}[-1] - 1), {N}) || {N} END"))
    like = " OR ".join(f"regexp_matches(l, {q(p.replace('(?U)', ''))})" for p in CODE_LIKE_COM)
    step = (f"{{'on': CASE WHEN {like} THEN true WHEN {sql_strip('l')} = '' THEN false ELSE acc.on END, "
            f"'out': CASE WHEN ({like}) OR (acc.on AND {sql_strip('l')} <> '') THEN list_append(acc.out, l) ELSE acc.out END}}")
    kept = f"list_reduce({ls}, lambda acc, l: {step}, {{'on': false, 'out': []::VARCHAR[]}}).out"
    lines_fb = f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, {N}) END"
    ladder = " ".join(f"WHEN {c} IS NOT NULL AND {c} <> '' THEN {c}" for c in cands)
    found = f"CASE {ladder} ELSE {lines_fb} END"
    return f"CASE WHEN {text} = '' THEN NULL ELSE {sql_strip(f'regexp_replace({found}, {q(chr(40) + "?i" + chr(41) + "^(python|java|cpp)" + chr(10))}, {q("")})')} END"


def _com_base() -> str:
    from gradewell.plans.comment import COM_ALIASES, CPP_KEYWORDS, JAVA_KEYWORDS, PYTHON_KEYWORDS
    alias = "CASE lower(coalesce(programming_language, '')) " + " ".join(
        f"WHEN {q(k)} THEN {q(v)}" for k, v in COM_ALIASES.items()) + " ELSE 'python' END"
    ls = _sql_splitlines("code")
    py_blocks = "regexp_extract_all(code, '(''''''[\\s\\S]*?''''''|\"\"\"[\\s\\S]*?\"\"\")', 1)"
    py_txt = f"list_transform({py_blocks}, lambda b: regexp_replace(regexp_replace(b, '^''+|''+$', '', 'g'), '^\"+|\"+$', '', 'g'))"
    cj_blocks = "regexp_extract_all(code, '(/\\*[\\s\\S]*?\\*/|/\\*\\*[\\s\\S]*?\\*/)', 1)"
    cj_txt = f"list_transform({cj_blocks}, lambda b: {sql_strip(chr(114) + 'egexp_replace(b, ' + q('^[/*]+|[/*]+$') + ', ' + q('') + ', ' + q('g') + ')')})"
    inline = f"list_filter({ls}, lambda l: NOT starts_with({sql_strip('l')}, '#') AND contains(l, '#'))"
    inline_txt = f"list_transform({inline}, lambda l: {sql_strip('substr(l, strpos(l, chr(35)) + 1)')})"

    def blines(bs):
        return f"list_sum(list_transform({bs}, lambda b: len(string_split(b, {N}))))"
    py_runs, cj_runs = _sql_runs(ls, "#"), _sql_runs(ls, "//")
    py_comments = f"list_concat({py_txt}, list_transform({py_runs}, lambda r: r.text), {inline_txt})"
    cj_comments = f"list_concat({cj_txt}, list_transform({cj_runs}, lambda r: r.text))"
    py_n = f"coalesce({blines(py_blocks)}, 0) + coalesce(list_sum(list_transform({py_runs}, lambda r: r.n)), 0) + len({inline})"
    cj_n = f"coalesce({blines(cj_blocks)}, 0) + coalesce(list_sum(list_transform({cj_runs}, lambda r: r.n)), 0)"
    pc = ("CASE WHEN lang = 'python' THEN regexp_replace(regexp_replace(regexp_replace(code, '#.*', '', 'g'), "
          "'''''''[\\s\\S]*?''''''', '', 'g'), '\"\"\"[\\s\\S]*?\"\"\"', '', 'g') "
          "ELSE regexp_replace(regexp_replace(regexp_replace(code, '//.*', '', 'g'), '/\\*[\\s\\S]*?\\*/', '', 'g'), "
          "'/\\*\\*[\\s\\S]*?\\*/', '', 'g') END")
    allp = ("list_distinct(list_concat(regexp_extract_all(pc, '[a-zA-Z][a-z]*', 0), "
            "regexp_extract_all(replace(pc, '_', ' '), '[a-zA-Z]+', 0), regexp_extract_all(pc, '[A-Z]+(?:[a-z]+)?', 0), "
            "regexp_extract_all(pc, '\\b[a-zA-Z_][a-zA-Z0-9_]*\\b', 0)))")
    kw = (f"CASE WHEN lang = 'java' THEN {_sql_list(JAVA_KEYWORDS)} WHEN lang = 'cpp' THEN {_sql_list(CPP_KEYWORDS)} "
          f"ELSE {_sql_list(PYTHON_KEYWORDS)} END")
    terms = ("list_distinct(list_transform(list_filter(flatten(list_transform(comments, lambda c: "
             f"regexp_split_to_array({sql_strip('c')}, '\\s+'))), lambda w: w <> ''), lambda w: lower(w)))")
    return oracle_with(f"""
com_c AS (SELECT idx, pos, model, programming_language, response, {alias} AS lang, {_sql_extract_com('response')} AS code
  FROM responses),
com_m AS (
  SELECT *, CASE WHEN lang = 'python' THEN {py_comments} ELSE {cj_comments} END AS comments,
    CAST(CASE WHEN lang = 'python' THEN {py_n} ELSE {cj_n} END AS INTEGER) AS comment_lines, {pc} AS pc
  FROM com_c),
com_i AS (
  SELECT *, CASE WHEN pc = '' OR pc IS NULL THEN []::VARCHAR[] ELSE list_filter({allp}, lambda x: NOT list_contains({kw}, x)) END AS ids,
    {terms} AS terms
  FROM com_m),
com_s AS (
  SELECT *, len(list_distinct(list_concat(terms, ids))) AS nu, len(list_intersect(terms, ids)) AS ni,
    CASE WHEN len(comments) = 0 THEN 0.0 ELSE list_sum(list_transform(comments, lambda c: CASE WHEN length(c) <= 2 THEN 0.0
      WHEN length(c) <= 30 THEN (length(c) - 2) / 28.0 ELSE 1.0 END)) / len(comments) END AS avg_cls
  FROM com_i)""")


def comment_metrics() -> str:
    return _com_base() + """SELECT idx, pos, model, programming_language, lang, code,
  CASE WHEN code IS NOT NULL THEN comment_lines END AS comment_lines,
  CASE WHEN code IS NOT NULL THEN CAST(len(comments) AS INTEGER) END AS n_comments,
  CASE WHEN code IS NOT NULL THEN CAST(len(ids) AS INTEGER) END AS n_identifiers,
  CASE WHEN code IS NOT NULL THEN CAST(len(terms) AS INTEGER) END AS n_terms,
  CASE WHEN code IS NOT NULL THEN """ + sql_round("CASE WHEN nu = 0 THEN 1.0 ELSE ni / nu END", 3) + """ END AS cic,
  CASE WHEN code IS NOT NULL THEN """ + sql_round("avg_cls", 3) + """ END AS cls
FROM com_s"""


def score_comment() -> str:
    from gradewell.operators.rules import COM_BLOCKLIST
    return _com_base() + f"""SELECT idx, pos, model, coalesce(programming_language, 'python') AS programming_language,
  CASE WHEN idx IN ({', '.join(map(str, COM_BLOCKLIST))}) THEN 0.0 WHEN code IS NULL OR code = '' THEN 0.0
    ELSE {sql_round("(0.7 * " + sql_round("CASE WHEN nu = 0 THEN 1.0 ELSE CAST(ni AS DOUBLE) / nu END", 3) + " + 0.3 * " + sql_round("avg_cls", 3) + ") * 30", 1)} END AS score
FROM com_s"""


# --- functionality --------------------------------------------------------------------
def _fun_any(c: str, subs) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(x)})" for x in subs) + ")"


def _fun_components_cte() -> str:
    from gradewell.plans.functionality import (COVERAGE_DANGER, DANGER, FENCE_TAGS, GUARD_WORDS, LINE_START_WORDS)
    tags = "(" + ", ".join(q(t) for t in FENCE_TAGS) + ")"
    r1, r2 = q(r"(?s)```(?:python|java|cpp|c\+\+)?\n(.*?)\n```"), q(r"(?s)```(.*?)```")
    r = "response"
    c1 = (f"CASE WHEN contains({r}, '```') AND regexp_matches({r}, {r1}) THEN {sql_strip(f'regexp_extract({r}, {r1}, 1)')} "
          f"WHEN contains({r}, '```') AND regexp_matches({r}, {r2}) THEN {sql_strip(f'regexp_extract({r}, {r2}, 1)')} END")
    parts = f"string_split({r}, '```')"
    inner = f"list_slice({parts}, 2, len({parts}) - 1)"
    cand = (f"list_filter(list_transform({inner}, lambda p: CASE WHEN NOT {sql_strip('p')} IN {tags} AND contains(p, {N}) "
            f"AND {sql_strip(f'split_part(p, {N}, 1)')} IN {tags} THEN {sql_strip(f'substr(p, strpos(p, {N}) + 1)')} END), "
            f"lambda x: x IS NOT NULL)")
    block = f"CASE WHEN contains({r}, '```') AND len({parts}) >= 3 AND len({cand}) > 0 THEN {cand}[1] END"
    ls = f"string_split({r}, {N})"
    hit = f"list_filter(range(1, len({ls}) + 1), lambda i: {_fun_any(f'{ls}[i]', LINE_START_WORDS)})"
    suffix = (f"CASE WHEN {_fun_any(r, ['def ', 'class ', 'public class', '#include'])} AND len({hit}) > 0 "
              f"THEN array_to_string(list_slice({ls}, {hit}[1], len({ls})), {N}) END")
    whole = f"CASE WHEN length({r}) > 20 AND length({r}) < 5000 AND {_fun_any(r, ['def', 'class', 'function'])} THEN {r} END"
    fb = (f"CASE WHEN NOT {nonempty_sql(r)} OR contains({r}, 'Feature not available') OR starts_with({r}, 'Error:') THEN NULL "
          f"WHEN ({block}) IS NOT NULL THEN {block} ELSE coalesce({suffix}, {whole}) END")
    known = (f"(model IN ('gpt', 'claude', 'deepseek', 'qwen') AND length({r}) > 50 AND {_fun_any(r, ['def ', 'class ', 'if '])})")
    code = (f"CASE WHEN {nonempty_sql(f'({c1})')} THEN {c1} WHEN {nonempty_sql(f'({fb})')} THEN {fb} "
            f"WHEN {known} THEN {r} END")
    det = ("CASE WHEN " + _fun_any("code", ["```java", "import java.", "public class"]) + " THEN 'java' WHEN "
           + _fun_any("code", ["```c++", "#include"]) + " THEN 'cpp' WHEN " + _fun_any("code", ["```python", "def "])
           + " THEN 'python' END")

    def pick(p):
        return f"coalesce(nullif(regexp_extract(code, {q(p)}, 1), ''), 'solution')"
    fl = f"coalesce({det}, task_lang)"
    fname = (f"CASE WHEN {fl} = 'python' THEN {pick(r'def\s+(\w+)')} "
             f"WHEN {fl} = 'java' THEN {pick(r'(?:public\s+)?(?:static\s+)?(?:\w+)\s+(\w+)\s*\(')} "
             f"WHEN {fl} IN ('cpp', 'c++') THEN {pick(r'(?:\w+)\s+(\w+)\s*\(')} ELSE 'solution' END")
    return f"""
fun_t AS (
  SELECT idx, max(lower(coalesce(programming_language, 'python'))) AS l0,
    max(CASE WHEN model = 'base' THEN 1 ELSE 0 END) AS has_base,
    max(CASE WHEN model = 'base' THEN coalesce(response, '') END) AS base
  FROM responses GROUP BY idx),
fun_r AS (
  SELECT r.idx, r.pos, r.model, r.response, coalesce(r.instruction, '') AS instruction,
    CASE WHEN t.l0 = 'python' AND t.has_base = 1 AND (contains(t.base, '```java') OR contains(t.base, 'import java.')) THEN 'java'
         WHEN t.l0 = 'python' AND t.has_base = 1 AND (contains(t.base, '```c++') OR contains(t.base, '#include')) THEN 'cpp'
         ELSE t.l0 END AS task_lang
  FROM responses r JOIN fun_t t ON r.idx = t.idx),
fun_x AS (SELECT idx, pos, model, task_lang, instruction, {code} AS code FROM fun_r),
fun_c AS (
  SELECT idx, pos, model, task_lang, {_fun_any('lower(instruction)', GUARD_WORDS)} AS instr_guard,
    {nonempty_sql('code')} AS has_code, {det} AS detected,
    (contains(lower(code), 'division by zero') OR contains(code, 'ZeroDivisionError')) AS divzero,
    length(code) > 5000 AS too_long,
    {_fun_any('code', DANGER['python'])} AS danger_python, {_fun_any('code', DANGER['cpp'])} AS danger_cpp,
    {_fun_any('code', DANGER['java'])} AS danger_java, {_fun_any('code', COVERAGE_DANGER)} AS coverage_danger,
    {fname} AS func_name
  FROM fun_x)"""


def functionality_components() -> str:
    return oracle_with(_fun_components_cte()) + "SELECT * FROM fun_c"


def _semantic_cte() -> str:
    return """
sem AS (
  SELECT r.idx, r.model,
    CASE WHEN a.embedding IS NULL OR b.embedding IS NULL THEN 0.5
      ELSE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) END AS semantic
  FROM responses r LEFT JOIN embeddings a ON a.vec_id = r.idx * 4 + r.pos
    LEFT JOIN embeddings b ON b.vec_id = r.idx * 4 + r.pos + 1)"""


def semantic_similarity() -> str:
    return oracle_with(_semantic_cte()) + f"SELECT idx, model, {sql_round('semantic', 6)} AS semantic FROM sem"


def pass_rates() -> str:
    return oracle_with("") + """SELECT idx, model, avg(CAST(passed AS DOUBLE)) AS pass_rate, bool_and(ran) AS ran
FROM case_outcomes GROUP BY idx, model"""


def score_functionality() -> str:
    from gradewell.operators.rules import FUN_BLOCKLIST
    blk = ", ".join(map(str, FUN_BLOCKLIST))
    return oracle_with(_fun_components_cte() + "," + _semantic_cte() + """,
rates AS (SELECT idx, model, avg(CAST(passed AS DOUBLE)) AS pass_rate, bool_and(ran) AS ran FROM case_outcomes GROUP BY idx, model),
fun_j AS (
  SELECT c.*, s.semantic, p.pass_rate, p.ran,
    coalesce(last_value(CASE WHEN c.has_code THEN c.detected END IGNORE NULLS) OVER (PARTITION BY c.idx ORDER BY c.pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c.task_lang) AS lang,
    coalesce(last_value(CASE WHEN c.has_code THEN c.detected END IGNORE NULLS) OVER (PARTITION BY c.idx ORDER BY c.pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), c.task_lang) AS final_lang,
    bool_or(c.instr_guard) OVER (PARTITION BY c.idx) AS guard
  FROM fun_c c LEFT JOIN sem s ON c.idx = s.idx AND c.model = s.model
    LEFT JOIN rates p ON c.idx = p.idx AND c.model = p.model),
fun_k AS (
  SELECT *, lang IN ('python', 'cpp', 'c++', 'java') AND NOT (CASE WHEN lang = 'python' THEN danger_python
    WHEN lang = 'cpp' THEN danger_cpp WHEN lang = 'java' THEN danger_java ELSE false END) AS runnable
  FROM fun_j)""") + f"""
SELECT idx, pos, model,
  CASE WHEN idx IN ({blk}) OR guard THEN task_lang ELSE final_lang END AS programming_language,
  CASE WHEN idx IN ({blk}) THEN 0.0 WHEN guard THEN 15.0 WHEN NOT has_code THEN 0.0 WHEN divzero THEN 10.0 WHEN too_long THEN 10.0
    ELSE {sql_round("(0.4 * semantic + 0.3 * CASE WHEN runnable THEN coalesce(pass_rate, 0.0) ELSE 0.0 END "
      "+ 0.2 * CASE WHEN lang = 'python' AND NOT coverage_danger THEN 0.5 ELSE 0.0 END "
      "+ 0.1 * CAST(CASE WHEN runnable THEN coalesce(ran, false) ELSE false END AS DOUBLE)) * 30", 1)} END AS score
FROM fun_k"""


# --- modularity -----------------------------------------------------------------------
def _sql_without_markup(x: str) -> str:
    from gradewell.operators.blocks import MARKUP_LINES, MARKUP_SPANS
    for p in MARKUP_LINES + MARKUP_SPANS:
        x = f"regexp_replace({x}, {q(p)}, '', 'g')"
    return x


def _sql_code_signs(x: str) -> str:
    from gradewell.operators.blocks import HEADED, SIGNS
    patterns = [unicode_words(p) for p in SIGNS] + [rf"\b{w}\s+.*:" for w in HEADED]
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {q('(?m)' + p)}) AS INTEGER)" for p in patterns) + ")"


def _sql_code_block() -> str:
    """A fold with one struct as state and element: the run that is open and the best so far."""
    from gradewell.operators.blocks import CODE_MARKERS
    marked = q("|".join(f"(?:{unicode_words(p)})" for p in CODE_MARKERS))
    ls = f"string_split(coalesce(response, ''), {N})"
    element = (f"{{'i': i, 'ind': {sql_indent('l')}, 'blank': {sql_strip('l')} = '', 'fit': regexp_matches({sql_strip('l')}, {marked}), 'size': length(l) + 1, "
               "'start': 0, 'base': 0, 'len': 0, 'best': 0, 'n': 0, 'chars': 0}")
    first = "{'i': 0, 'ind': 0, 'blank': false, 'fit': false, 'size': 0, 'start': 0, 'base': 0, 'len': 0, 'best': 0, 'n': 0, 'chars': 0}"
    last = f"{{'i': len({ls}) + 1, 'ind': -1, 'blank': false, 'fit': false, 'size': 0, 'start': 0, 'base': 0, 'len': 0, 'best': 0, 'n': 0, 'chars': 0}}"
    on = "(a.start > 0 AND (x.blank OR x.ind >= a.base OR x.fit))"
    win = f"(a.start > 0 AND NOT {on} AND x.i - a.start > 5 AND a.len > a.chars)"
    step = (f"{{'i': x.i, 'ind': x.ind, 'blank': x.blank, 'fit': x.fit, 'size': x.size, "
            f"'start': CASE WHEN {on} THEN a.start WHEN a.start = 0 AND x.fit THEN x.i ELSE 0 END, "
            f"'base': CASE WHEN a.start = 0 AND x.fit THEN x.ind ELSE a.base END, "
            f"'len': CASE WHEN {on} THEN a.len + x.size WHEN a.start = 0 AND x.fit THEN x.size ELSE 0 END, "
            f"'best': CASE WHEN {win} THEN a.start ELSE a.best END, 'n': CASE WHEN {win} THEN x.i - a.start ELSE a.n END, "
            f"'chars': CASE WHEN {win} THEN a.len ELSE a.chars END}}")
    kind = "STRUCT(i BIGINT, ind BIGINT, blank BOOLEAN, fit BOOLEAN, size BIGINT, start BIGINT, base BIGINT, len BIGINT, best BIGINT, n BIGINT, chars BIGINT)"
    rows = f"list_concat([CAST({first} AS {kind})], list_transform({ls}, lambda l, i: CAST({element} AS {kind})), [CAST({last} AS {kind})])"
    found = f"list_reduce({rows}, lambda a, x: CAST({step} AS {kind}))"
    return f"(SELECT CASE WHEN b.best > 0 THEN array_to_string(list_slice({ls}, b.best, b.best + b.n - 1), {N}) END FROM (SELECT {found} AS b))"


def _sql_repaired(x: str) -> str:
    """A fold whose state is the open quote and the lines kept so far."""
    triple = "regexp_matches(x.line, '(?:\"{3}|''{3})\\s*$')"
    quote = "list_reduce(list_concat([a.open], regexp_extract_all(x.line, '(\\\\?[''\"])', 1)), lambda s, t: CASE WHEN s = '' THEN right(t, 1) WHEN s = t THEN '' ELSE s END)"
    keep = f"({quote} = '' OR {triple})"
    kind = "STRUCT(line VARCHAR, open VARCHAR, kept VARCHAR[])"
    rows = f"list_concat([CAST({{'line': '', 'open': '', 'kept': []}} AS {kind})], list_transform(string_split({x}, {N}), lambda l: CAST({{'line': l, 'open': '', 'kept': []}} AS {kind})))"
    step = f"CAST({{'line': '', 'open': CASE WHEN {keep} THEN {quote} ELSE '' END, 'kept': CASE WHEN {keep} THEN list_append(a.kept, x.line) ELSE a.kept END}} AS {kind})"
    text = f"array_to_string(list_reduce({rows}, lambda a, x: {step}).kept, {N})"
    count = lambda chars: f"(length(t) - length(regexp_replace(t, '[{chars}]', '', 'g')))"
    opening, closing = count("(\\[{"), count(")\\]}")
    return f"(SELECT t || repeat(')', CAST(greatest(0, {opening} - {closing}) AS BIGINT)) FROM (SELECT {text} AS t))"


def modularity_inputs() -> str:
    from gradewell.plans.modularity import API_WORDS, CPP_INCLUDE, JAVA_IMPORT, MOD_ALIASES, MOD_FENCES, PY_IMPORT_RE
    alias = ("CASE WHEN lower(coalesce(programming_language, '')) = '' THEN 'python' ELSE CASE lower(programming_language) "
             + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in MOD_ALIASES.items()) + " ELSE 'python' END END")
    ladder = []
    for p in MOD_FENCES:
        best = _sql_longest(f"regexp_extract_all(coalesce(response, ''), {q(p)}, 1)")
        ladder.append(f"WHEN {best} IS NOT NULL AND length({sql_strip(best)}) > 10 AND contains({best}, {N}) THEN {sql_strip(best)}")
    code = "CASE " + " ".join(ladder) + " WHEN block IS NOT NULL THEN block WHEN signs THEN loose ELSE '' END"
    cl = f"list_filter(string_split(code, {N}), lambda l: {sql_strip('l')} <> '' AND NOT starts_with({sql_strip('l')}, '#'))"
    mi = f"coalesce(list_max(list_transform({cl}, lambda l: length(l) - length(regexp_replace(l, '^\\s+', '')))), 0)"
    funcs = "len(regexp_extract_all(code, 'def\\s+\\w+\\s*\\(', 0))"
    classes = "len(regexp_extract_all(code, 'class\\s+\\w+', 0))"
    factor = (f"(CASE WHEN len({cl}) < 20 THEN 0.85 WHEN len({cl}) > 100 THEN 1.05 ELSE 1.0 END) "
              f"* (CASE WHEN {mi} > 16 THEN 0.95 ELSE 1.0 END) "
              f"* (CASE WHEN {funcs} > 5 OR {classes} > 2 THEN 1.08 WHEN {funcs} <= 1 AND {classes} = 0 THEN 0.9 ELSE 1.0 END)")
    py_imp = (f"list_distinct(list_filter(list_concat(regexp_extract_all(parsed_code, {q(PY_IMPORT_RE)}, 1), "
              f"regexp_extract_all(parsed_code, {q(PY_IMPORT_RE)}, 2)), lambda x: x <> ''))")
    fn, cn = (f"len(regexp_extract_all(parsed_code, {q(unicode_words(p))}, 0))" for p in (r"def\s+\w+\s*\(", r"class\s+\w+"))
    lcom2 = f"CASE WHEN {cn} = 0 THEN 0.4 + {fn} / 20 WHEN {fn} / {cn} < 3 THEN 0.2 ELSE 0.3 + {fn} / {cn} / 20 END"
    return oracle_with(f"""
mod_l AS (SELECT *, {_sql_code_block()} AS block, {_sql_without_markup("coalesce(response, '')")} AS loose FROM responses),
mod_s AS (SELECT *, length({sql_strip("loose")}) > 30 AND {_sql_code_signs("loose")} >= 3 AS signs FROM mod_l),
mod_x AS (SELECT idx, pos, model, programming_language, {alias} AS lang, {code} AS code FROM mod_s),
mod_c AS (SELECT *, CASE WHEN lang = 'python' THEN {_sql_repaired("code")} ELSE code END AS parsed_code FROM mod_x)""") + f"""
SELECT *, round(CAST({factor} AS DOUBLE), 6) AS factor,
  CAST(len(list_distinct(regexp_extract_all(code, {q(JAVA_IMPORT)}, 1))) AS BIGINT) AS java_ce,
  CAST(len(list_distinct(regexp_extract_all(code, {q(CPP_INCLUDE)}, 1))) AS BIGINT) AS cpp_ce,
  CAST(len({py_imp}) AS BIGINT) AS py_regex_ce,
  CAST(len(regexp_extract_all(parsed_code, 'def\\s+\\w+\\s*\\(', 0)) AS BIGINT) AS def_count, regexp_matches(parsed_code, {q(API_WORDS)}) AS api_words,
  CAST(CASE WHEN len({py_imp}) > 0 THEN len({py_imp}) ELSE greatest(1, least(15, len(string_split(parsed_code, {N})) // 20)) END AS BIGINT) AS feature_ce,
  CAST(4 + CASE WHEN {cn} > 0 THEN least(2 * {cn}, 6) ELSE 0 END + CASE WHEN {fn} > 3 THEN least({fn} // 2, 4) ELSE 0 END AS BIGINT) AS feature_ca,
  round(CAST(greatest(0.1, least(0.9, {lcom2})) AS DOUBLE), 6) AS feature_lcom2
FROM mod_c"""


def balance_repair() -> str:
    n = lambda x: f"len(string_split({x}, {N}))"
    return f"""SELECT idx, model, parsed_code, CAST({n("code")} AS BIGINT) AS code_lines, CAST({n("code")} - {n("parsed_code")} AS BIGINT) AS dropped_lines,
  CAST(length(parsed_code) - length(rtrim(parsed_code, ')')) AS BIGINT) AS closing_brackets FROM ({modularity_inputs()}) WHERE lang = 'python'"""


def score_reasons() -> str:
    from gradewell.operators.rules import COM_BLOCKLIST, EFF_BLOCKLIST, FUN_BLOCKLIST, ROB_BLOCKLIST
    skipped = lambda b: f"WHEN idx IN ({', '.join(map(str, b))}) THEN 'skipped_task'"
    parts = {
        "functionality": f"""SELECT CASE {skipped(FUN_BLOCKLIST)} WHEN bool_or(instr_guard) OVER (PARTITION BY idx) THEN 'guarded_instruction'
            WHEN NOT has_code THEN 'no_code' WHEN divzero THEN 'division_by_zero' WHEN too_long THEN 'too_long' ELSE 'scored' END AS reason
          FROM ({functionality_components()})""",
        "modularity": f"SELECT CASE WHEN code = '' THEN 'no_code' ELSE 'scored' END AS reason FROM ({modularity_inputs()})",
        "simplicity": _sim_base() + f"SELECT CASE WHEN NOT ({nonempty_sql('response')}) THEN 'empty_answer' WHEN code = '' THEN 'no_code' ELSE 'scored' END AS reason FROM sim_s",
        "standardization": _std_base() + """SELECT CASE WHEN code = '' THEN 'no_code' ELSE 'scored' END AS reason FROM std_scored
          UNION ALL SELECT 'empty_answer' FROM responses WHERE response IS NULL OR response = ''""",
        "robustness": f"""SELECT CASE {skipped(ROB_BLOCKLIST)} WHEN code = '' THEN 'no_code' WHEN too_short THEN 'too_short'
            WHEN lang = 'unknown' THEN 'unknown_language' ELSE 'scored' END AS reason FROM ({robustness_components()})""",
        "efficiency": f"""SELECT CASE {skipped(EFF_BLOCKLIST)} WHEN coalesce(starts_with(response, 'Error:'), false) THEN 'error_response'
            WHEN code = '' THEN 'no_code' ELSE 'scored' END AS reason FROM ({efficiency_inputs()})""",
        "comment": f"SELECT CASE {skipped(COM_BLOCKLIST)} WHEN code IS NULL OR code = '' THEN 'no_code' ELSE 'scored' END AS reason FROM ({comment_metrics()})",
    }
    return "SELECT dimension, reason, count(*) AS n_answers FROM (" + " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, reason FROM ({x})" for d, x in parts.items()) + ") GROUP BY ALL"


TASKS = "SELECT idx, max(programming_language) AS programming_language, max(instruction) AS instruction, count(*) AS n FROM responses GROUP BY idx"


def test_case_plan() -> str:
    from gradewell.plans.functionality import TEST_KINDS
    low = "lower(coalesce(instruction, ''))"
    kind = " ".join(f"WHEN {_fun_any(low, words)} THEN {q(k)}" for k, words, _ in TEST_KINDS[:-1])
    cases = ", ".join(f"({q(k)}, {n}, {q(i)}, {q(e)}, {'true' if i.startswith('[') else 'false'})"
                      for k, _, rows in TEST_KINDS for n, (i, e) in enumerate(rows))
    return oracle_with() + f"""SELECT t.idx, t.kind, c.case_no, c.input, c.expected, c.is_list
FROM (SELECT idx, CASE {kind} ELSE 'basic' END AS kind FROM ({TASKS})) t
JOIN (VALUES {cases}) c(kind, case_no, input, expected, is_list) USING (kind)"""


def scan_lenient() -> str:
    return oracle_with() + f"""SELECT CAST(idx AS VARCHAR) AS index, lower(programming_language) AS programming_language, instruction,
  CAST(n AS INT) AS n_models FROM ({TASKS})"""


def scan_counts() -> str:
    return oracle_with() + f"""SELECT count(*) AS total, CAST(0 AS BIGINT) AS blank, CAST(0 AS BIGINT) AS malformed,
  CAST(0 AS BIGINT) AS bad_shape, count(*) AS ok FROM ({TASKS})"""


def task_keys() -> str:
    from gradewell.operators.rules import COM_BLOCKLIST, EFF_BLOCKLIST, FUN_BLOCKLIST, ROB_BLOCKLIST
    skips = {"functionality": FUN_BLOCKLIST, "efficiency": EFF_BLOCKLIST, "comment": COM_BLOCKLIST, "robustness": ROB_BLOCKLIST}
    missing = {"item": ("'number'", "CAST(item_no AS VARCHAR)"), "none": ("'null'", "CAST(NULL AS VARCHAR)"), "zero": ("'number'", "'0'")}
    parts = []
    for d, policy in (("functionality", "item"), ("efficiency", "item"), ("comment", "item"), ("modularity", "line"),
                      ("robustness", "none"), ("simplicity", "none"), ("standardization", "zero")):
        if policy == "line":
            kind = "CASE s WHEN 0 THEN 'number' WHEN 1 THEN 'text' WHEN 2 THEN 'text' ELSE 'number' END"
            key = "CASE s WHEN 0 THEN i WHEN 1 THEN i WHEN 2 THEN 'MERGED_' || i || '_java' ELSE CAST(line_no + 1 AS VARCHAR) END"
        else:
            k, v = missing[policy]
            kind = f"CASE WHEN s = 0 THEN 'number' WHEN s = 1 THEN 'text' WHEN s >= 4 THEN 'null' ELSE {k} END"
            key = f"CASE WHEN s <= 1 THEN i WHEN s < 4 THEN {v} END"
        skip = f"kind = 'number' AND CAST(key AS BIGINT) IN ({', '.join(map(str, skips[d]))})" if d in skips else "false"
        language = "CASE WHEN s IN (0, 3) THEN 'java' WHEN s = 2 THEN 'java' ELSE 'python' END" if d == "modularity" else "CAST(NULL AS VARCHAR)"
        parts.append(f"SELECT line_no, '{d}' AS dimension, kind, key, coalesce({skip}, false) AS skipped, {language} AS language "
                     f"FROM (SELECT *, {kind} AS kind, {key} AS key FROM keyed)")
    return oracle_with("""
keyed AS (SELECT idx % 6 AS s, CAST(idx AS VARCHAR) AS i, row_number() OVER (ORDER BY idx) - 1 AS item_no,
  row_number() OVER (ORDER BY idx) - 1 + sum(CASE WHEN idx % 7 = 0 THEN 1 ELSE 0 END) OVER (ORDER BY idx) AS line_no
  FROM (SELECT DISTINCT idx FROM responses))""") + " UNION ALL ".join(parts).replace("SELECT line_no,", "SELECT CAST(line_no AS BIGINT) AS line_no,")


def error_records() -> str:
    return oracle_with() + """SELECT CASE WHEN s < 3 THEN CAST(idx AS VARCHAR) END AS index, CASE WHEN s = 2 THEN 'Java' ELSE 'python' END AS programming_language,
  CASE s WHEN 1 THEN 'results missing' WHEN 2 THEN 'results is array' ELSE 'task is array' END AS error
FROM (SELECT DISTINCT idx, idx % 4 AS s FROM responses) WHERE s > 0"""


def code_languages() -> str:
    from gradewell.operators.language import CODE_SIGNS
    signs = " ".join(f"WHEN regexp_matches(code, {q(unicode_words(p.replace('(?U)', '')))}) THEN '{lang}'" for lang, p in CODE_SIGNS)
    return oracle_with() + f"""SELECT idx, model, CASE WHEN code IS NULL OR code = '' THEN 'unknown' {signs} ELSE 'python' END AS shown
FROM (SELECT idx, model, {sql_extract_std()} AS code FROM responses)"""


def answer_kinds() -> str:
    return oracle_with() + """SELECT idx, CAST(pos AS INTEGER) AS pos, model,
  CASE WHEN s = 0 AND response IS NULL THEN 'null' WHEN s = 0 THEN 'text' WHEN s <= 3 THEN 'object' WHEN s = 4 THEN 'number' ELSE 'list' END AS kind,
  CASE WHEN s <= 2 THEN response WHEN s = 4 AND length(response) > 0 THEN CAST(length(response) AS VARCHAR)
    WHEN s = 5 THEN '[' || idx || ',' || pos || ']' END AS unwrapped,
  CASE WHEN s = 0 THEN response END AS text
FROM (SELECT *, (idx + pos) % 6 AS s FROM responses)"""


def completeness_check() -> str:
    return oracle_with() + f"""SELECT count(*) AS lines_read, count(*) AS valid_tasks, count(n) AS rows_written,
  count(*) - count(n) AS missing, count(*) = count(n) AS complete FROM ({TASKS})"""


def comment_ratio() -> str:
    total = f"CASE WHEN code IS NULL THEN 0 ELSE len({_sql_splitlines('code')}) END"
    return f"""SELECT idx, model, comment_lines, total_lines, {sql_round("CASE WHEN total_lines = 0 THEN 0.0 WHEN r < 0.2 THEN power(r / 0.2, 3.0) WHEN r <= 0.3 THEN 1.0 ELSE exp(-5 * (r - 0.3)) END", 6)} AS ccrs
FROM (SELECT *, comment_lines / nullif(total_lines, 0)::DOUBLE AS r
  FROM (SELECT idx, model, coalesce(comment_lines, 0) AS comment_lines, CAST({total} AS INTEGER) AS total_lines FROM ({comment_metrics()})))"""


def regex_ecc() -> str:
    score = sql_round("CASE WHEN ecc >= 3 THEN 10.0 WHEN ecc <= 0.5 THEN 30.0 ELSE 30.0 - ((ecc - 0.5) / 2.5) * 20.0 END", 1)
    return f"""SELECT idx, model, analyzer, {sql_round("ecc", 6)} AS ecc,
  CASE WHEN ecc < 1 THEN 'low' WHEN ecc < 2 THEN 'medium' ELSE 'high' END AS risk, {score} AS ecc_score
FROM (SELECT idx, model, analyzer, CASE WHEN loc = 0 THEN 0.0 ELSE (regex_statements + regex_max_inputs
    + CASE WHEN analyzer = 'java' THEN java_methods + java_outputs ELSE cpp_methods + cpp_outputs END) / loc::DOUBLE END AS ecc
  FROM ({efficiency_inputs()}) WHERE analyzer IN ('java', 'cpp'))"""


def mean_pool() -> str:
    return """SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 4) AS mean FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY label, dim"""


def explode_models() -> str:
    return oracle_with() + "SELECT idx, pos, model, response FROM responses"


def regroup_scores() -> str:
    return f"""SELECT idx, CAST(count(score) AS INTEGER) AS n_models, string_agg(model, ',' ORDER BY pos) AS models, sum(score) AS total
FROM ({score_standardization()}) GROUP BY idx"""


def dedupe_last() -> str:
    return oracle_with() + """SELECT model, max(idx) AS idx, max_by(response, idx) AS response, max_by(pos, idx) AS pos
FROM (SELECT model, idx, coalesce(response, '') AS response, pos FROM responses) GROUP BY model"""
