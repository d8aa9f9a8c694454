"""DuckDB expression builders used by the oracle SQL.

DuckDB's regex engine (RE2) has no lookaround and ASCII ``\\s``/``\\w``/
``\\b``; these helpers spell out the Unicode classes and rewrite the
lookarounds so the oracle answers the same question independently of the
Spark code.
"""

from __future__ import annotations

import unicodedata

from ravel.params import FLAGGED_SCRIPTS

# Python's str.isspace() set.
WS = r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"[\pL\pN_]"
NW = r"[^\pL\pN_]"
D = r"\p{Nd}"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def key(x: str) -> str:
    return f"lower({strip(x)})"


def rx(x: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {q(pattern)}{', ' + q(flags) if flags else ''})"


def rcount(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def word(words: list[str]) -> str:
    """Whole-word alternation with Unicode boundaries (match test only)."""
    return f"(^|{NW})({'|'.join(words)})($|{NW})"


def topic(x: str) -> str:
    t = f"lower({x})"
    plain = [
        r"\\lim", r"approaches", r"tends to", r"f'\(", r"f''", r"dy/dx", r"d/dx", r"\\frac\{d", r"\\partial",
        r"\\int", r"antiderivative", r"primitive", r"convergent", r"divergent", r"taylor", r"maclaurin",
        r"\\sum.*n=", r"differential equation", r"discontinuous", r"critical point", r"inflection", r"concav",
        r"extrema", r"maximum.*function", r"minimum.*function", r"monoton", r"increasing.*function",
        r"decreasing.*function", r"rate of change", r"instantaneous", r"tangent line", r"area under",
        r"volume of revolution", r"l'h[oô]pital",
    ]
    words = ["limit", "lim", "derivative", "differentiate", "differentiation", "integrate", "integration",
             "ode", "pde", "continuity"]
    integral_removed = f"regexp_replace({t}, {q('integral' + WS + '+(number|part|value)')}, '#', 'gi')"
    continuous = f"(^|{NW})continuous({WS}*\\(|{WS}+(function|at|on|over|from|if|and{WS}+differentiable))"
    return "(" + " OR ".join([
        rx(t, "|".join(plain), "i"),
        rx(t, word(words), "i"),
        rx(integral_removed, word(["integral"]), "i"),
        rx(t, continuous, "i"),
    ]) + ")"


LOW_QUALITY = "|".join([
    r"```", r"===+|---+", r"\[image.*\]", rf"Figure{WS}*{D}+", rf"Question{WS}*{D}+{WS}*:",
    rf"\.{WS}*\.{WS}*\.", rf"\\frac{WS}*{D}",
])


def low_quality(problem: str, think: str, response: str) -> str:
    resp = f"coalesce({response}, '')"
    after = f"string_split({resp}, '</think>')[-1]"
    no_box = f"NOT {rx(after, r'\\boxed' + WS + r'*\{')}"
    fields = [problem, resp, think]
    bad = " OR ".join(f"coalesce({rx(f, LOW_QUALITY, 'i')}, false)" for f in fields)
    return f"({no_box} OR {bad})"


def steps(x: str, n: int = 2) -> str:
    return f"({rcount(f'coalesce({x}, {q("")})', chr(10) + WS + '*' + D + r'+\.')} >= {n})"


def think_len(x: str) -> str:
    return f"CAST(length(coalesce({x}, '')) AS BIGINT)"


# ---------------------------------------------------------------------------
# answer extraction and normalisation
# ---------------------------------------------------------------------------

BOX = r"\boxed{"


def extract_boxed(x: str) -> str:
    tail = f"string_split({x}, {q(BOX)})[-1]"
    fold = (
        f"list_reduce(regexp_extract_all({tail}, {q(r'\{|\}|[^{}]+')}), lambda acc, t: "
        "CASE WHEN acc.done THEN acc "
        "WHEN t = '{' THEN {'d': acc.d + 1, 'n': acc.n + 1, 'done': false} "
        "WHEN t = '}' THEN {'d': acc.d - 1, 'n': CASE WHEN acc.d - 1 = 0 THEN acc.n ELSE acc.n + 1 END, 'done': acc.d - 1 = 0} "
        "ELSE {'d': acc.d, 'n': acc.n + length(t), 'done': false} END, {'d': 1, 'n': 0, 'done': false})"
    )
    keep = f"(CASE WHEN ({fold}).done THEN ({fold}).n ELSE length({tail}) - 1 END)"
    return f"(CASE WHEN contains({x}, {q(BOX)}) THEN {strip(f'substr({tail}, 1, greatest({keep}, 0))')} ELSE '' END)"


def after_equals(x: str) -> str:
    return strip(f"string_split({x}, '=')[-1]")


def text_cmd(x: str) -> str:
    pat = r"\\text\{([^}]*)\}"
    pieces = f"string_split_regex({x}, {q(pat)})"
    inner = f"list_concat(list_transform(regexp_extract_all({x}, {q(pat)}, 1), lambda m: lower(m)), [''])"
    return f"array_to_string(list_transform(list_zip({pieces}, {inner}), lambda z: concat(z[1], z[2])), '')"


def dne(x: str) -> str:
    return f"(CASE WHEN regexp_full_match({strip(x)}, {q('(?i)does' + WS + '+not' + WS + '+exist')}) THEN 'dne' ELSE {x} END)"


def choice_letter(x: str) -> str:
    t = strip(x)
    return (f"(CASE WHEN regexp_full_match({t}, {q(r'\\text\{[A-Da-d]\}')}) THEN upper(regexp_extract({t}, {q(r'\\text\{([A-Da-d])\}')}, 1)) "
            f"WHEN upper({t}) IN ('A', 'B', 'C', 'D') THEN upper({t}) ELSE '' END)")


def choice_value(letter: str, question: str) -> str:
    def pat(L: str) -> str:
        return (rf"(?s)(?:\*\*|\$)?{L}[.):](?:\*\*|\$)?{WS}*(.+?)(?:{WS}*(?:(?:\*\*|\$)?[B-D][.):])|$)")

    cases = " ".join(
        f"WHEN {letter} = '{L}' THEN coalesce(regexp_extract({question}, {q(pat(L))}, 1), '')" for L in "ABCD"
    )
    raw = f"(CASE {cases} ELSE '' END)"
    return strip(f"regexp_replace({strip(raw)}, '\\.+$', '')")


def canonical(x: str) -> str:
    s = f"regexp_replace({x}, {q(r'\\(left|right|displaystyle)(' + NW + '|$)')}, '\\2', 'g')"
    s = f"regexp_replace({s}, {q(r'\\[!,;:]')}, '', 'g')"
    s = f"regexp_replace({s}, {q(r'\\[dt]frac')}, {q(r'\\frac')}, 'g')"
    s = f"regexp_replace({s}, {q(r'\^\{?\\circ\}?')}, '', 'g')"
    s = f"regexp_replace({s}, {q(WS + '+|\\$')}, '', 'g')"
    return f"regexp_replace({s}, '\\.+$', '')"


NUM = r"-?[0-9]+(?:\.[0-9]+)?"


def numeric(x: str) -> str:
    frac = rf"(-?)\\frac\{{({NUM})\}}\{{({NUM})\}}"
    slash = rf"({NUM})/({NUM})"

    def ratio(a: str, b: str) -> str:
        return f"(CASE WHEN CAST({b} AS DOUBLE) <> 0 THEN CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END)"

    fv = ratio(f"regexp_extract({x}, {q(frac)}, 2)", f"regexp_extract({x}, {q(frac)}, 3)")
    return (f"(CASE WHEN regexp_full_match({x}, {q(NUM)}) THEN CAST({x} AS DOUBLE) "
            f"WHEN regexp_full_match({x}, {q(frac)}) THEN (CASE WHEN regexp_extract({x}, {q(frac)}, 1) = '-' THEN -{fv} ELSE {fv} END) "
            f"WHEN regexp_full_match({x}, {q(slash)}) THEN {ratio(f'regexp_extract({x}, {q(slash)}, 1)', f'regexp_extract({x}, {q(slash)}, 2)')} END)")


NUMBER = r"~?[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?"
LANES = (1, 2)


def expression_ctes(src: str, out: str) -> str:
    """CTEs up to ``{out}v`` (s, v1, v2): values of the expressions among the canonical answers at two real points.

    Found by rewriting text: letters become numbers, products are spelled out, and then the first
    innermost bracket is worked off, one operation a step, until a number is left (``~`` is a sign).
    """
    cols = ("pa_c", "ga_c", "pf_c", "gf_c")
    bare = f"regexp_replace(s, {q(r'\\[A-Za-z]+')}, ' ', 'g')"
    frac = q(r"\\frac\{([^{}]*)\}\{([^{}]*)\}")
    t = f"regexp_replace(regexp_replace(s, {frac}, {q(r'((\1)/(\2))')}, 'g'), {frac}, {q(r'((\1)/(\2))')}, 'g')"
    t = f"regexp_replace(regexp_replace({t}, {q(r'[\[{]')}, '(', 'g'), {q(r'[\]}]')}, ')', 'g')"
    t = f"regexp_replace({t}, {q(r'\\(sin|cos)([a-z])')}, {q(r'\\\1(\2)')}, 'g')"
    for name, sign in (("sin", "§"), ("cos", "¢"), ("sqrt", "¤"), ("cdot", "*"), ("times", "*"), ("pi", "(3.141592653589793)")):
        t = f"replace({t}, {q(chr(92) + name)}, {q(sign)})"
    t = f"regexp_replace({t}, {q(r'(^|[(*/+^-])-')}, {q(r'\1(0-1)*')}, 'g')"
    letter = "CASE WHEN c = 'e' THEN '(2.718281828459045)' WHEN regexp_matches(c, '[A-Za-z]') THEN printf('(%.4f)', 0.5 + ((ascii(c) * 7919 * lane + 1729) % 1000) / 700.0) ELSE c END"
    t = f"array_to_string(list_transform(string_split({t}, ''), lambda c: {letter}), '')"
    times = q(r"([0-9)])([(§¢¤])")
    t = f"regexp_replace(regexp_replace(regexp_replace({t}, {times}, {q(r'\1*\2')}, 'g'), {times}, {q(r'\1*\2')}, 'g'), {q(r'(\))([0-9])')}, {q(r'\1*\2')}, 'g')"
    inner = q(r"([§¢¤]?)\(([^()]*)\)")
    num = lambda x: f"TRY_CAST(replace({x}, '~', '-') AS DOUBLE)"
    signed = lambda v: f"(CASE WHEN {v} < 0 THEN '~' ELSE '' END || CAST(abs({v}) AS VARCHAR))"

    def reduced(pattern: str, value: str) -> str:
        m = f"regexp_extract(c, {q(pattern)}, ['a', 'x', 'o', 'y', 'z'])"
        return f"(SELECT m.a || {signed('v')} || m.z FROM (SELECT m, {value} AS v FROM (SELECT {m} AS m)))"

    power, product, total = rf"^(|.*[-+*/^])({NUMBER})(\^)({NUMBER})(.*)$", rf"^(|.*?[-+*/])({NUMBER})([*/])({NUMBER})(.*)$", rf"^()({NUMBER})([-+])({NUMBER})(.*)$"
    x, y = num("m.x"), num("m.y")
    step = f"""CASE WHEN regexp_full_match(c, {q(NUMBER)}) THEN (SELECT {signed('v')} FROM (SELECT CASE f WHEN '§' THEN sin({num('c')}) WHEN '¢' THEN cos({num('c')}) WHEN '¤' THEN sqrt({num('c')}) ELSE {num('c')} END AS v))
      WHEN regexp_matches(c, {q(power)}) THEN f || '(' || {reduced(power, f'pow({x}, {y})')} || ')'
      WHEN regexp_matches(c, {q(product)}) THEN f || '(' || {reduced(product, f"CASE WHEN m.o = '*' THEN {x} * {y} ELSE {x} / {y} END")} || ')'
      WHEN regexp_matches(c, {q(total)}) THEN f || '(' || {reduced(total, f"CASE WHEN m.o = '+' THEN {x} + {y} ELSE {x} - {y} END")} || ')' END"""
    return f"""
{out}t AS MATERIALIZED (SELECT s, lane, '(' || {t} || ')' AS e FROM (SELECT DISTINCT s FROM ({' UNION ALL '.join(f'SELECT {c} AS s FROM {src}' for c in cols)})), (SELECT unnest({list(LANES)}) AS lane)
  WHERE regexp_full_match(s, {q(r'[-A-Za-z0-9.+*/^(){}\[\]\\]+')}) AND NOT regexp_matches({bare}, '[A-Za-z]{{3}}')),
{out}w AS (SELECT s, lane, e, 0 AS n FROM {out}t WHERE regexp_full_match(e, {q(r'[-0-9.+*/^()§¢¤]+')})
  UNION ALL SELECT s, lane, substr(e, 1, p - 1) || r || substr(e, p + length(g)), n + 1 FROM (
    SELECT s, lane, e, n, g, strpos(e, g) AS p, {step} AS r FROM (
      SELECT s, lane, e, n, regexp_extract(e, {inner}, 0) AS g, regexp_extract(e, {inner}, 1) AS f, regexp_extract(e, {inner}, 2) AS c FROM {out}w WHERE contains(e, '(') AND n < 200))
  WHERE r IS NOT NULL),
{out}v AS MATERIALIZED (SELECT s, {', '.join(f'max(CASE WHEN lane = {k} THEN {num("e")} END) AS v{k}' for k in LANES)} FROM {out}w WHERE regexp_full_match(e, {q(NUMBER)}) GROUP BY s)"""


def grade_ctes(src: str, question: str, pred: str, gold: str, ignore: bool, out: str = "g") -> str:
    """CTEs up to ``{out}5``, which has the source columns + ``is_correct`` (one of them is recursive)."""
    eq_parts = []

    def eq(a: str, b: str) -> str:
        ca, cb = f"{a}_c", f"{b}_c"
        same_num = (f"({a}_v IS NOT NULL AND {b}_v IS NOT NULL AND abs({a}_v - {b}_v) <= 1e-9 * greatest(1.0, abs({b}_v)))")
        points = " AND ".join(f"abs({a}_e.v{k} - {b}_e.v{k}) <= 1e-9 * greatest(1.0, abs({b}_e.v{k}))" for k in LANES)
        same = f"({ca} <> '' AND ({ca} = {cb} OR {same_num} OR coalesce({points}, false)))"
        return f"({cb} = '' OR {same})" if ignore else f"coalesce({same}, false)"

    eq_parts.append(eq("pa", "ga"))
    eq_parts.append(eq("pf", "gf"))
    names = ("pa", "ga", "pf", "gf")
    return f"""
{out}1 AS MATERIALIZED (SELECT *, {dne(text_cmd(f'coalesce({pred}, {q("")})'))} AS _p0, {dne(text_cmd(f'coalesce({gold}, {q("")})'))} AS _g0 FROM {src}),
{out}2 AS MATERIALIZED (SELECT *, {choice_letter('_p0')} AS _pl, {choice_letter('_g0')} AS _gl FROM {out}1),
{out}3 AS MATERIALIZED (SELECT *, CASE WHEN _pl <> '' AND {choice_value('_pl', question)} <> '' THEN {choice_value('_pl', question)} ELSE _p0 END AS _p,
                    CASE WHEN _gl <> '' AND {choice_value('_gl', question)} <> '' THEN {choice_value('_gl', question)} ELSE _g0 END AS _g FROM {out}2),
{out}4 AS MATERIALIZED (SELECT *, {canonical(after_equals('_p'))} AS pa_c, {canonical(after_equals('_g'))} AS ga_c,
                    {canonical('_p')} AS pf_c, {canonical('_g')} AS gf_c FROM {out}3),
{expression_ctes(out + "4", out)},
{out}5 AS MATERIALIZED (SELECT x.* EXCLUDE (_p0, _g0, _pl, _gl, _p, _g, pa_c, ga_c, pf_c, gf_c, pa_v, ga_v, pf_v, gf_v),
                  coalesce({eq_parts[0]} OR {eq_parts[1]}, false) AS is_correct
           FROM (SELECT *, {numeric('pa_c')} AS pa_v, {numeric('ga_c')} AS ga_v, {numeric('pf_c')} AS pf_v, {numeric('gf_c')} AS gf_v FROM {out}4) x
           {' '.join(f'LEFT JOIN {out}v {n}_e ON {n}_e.s = x.{n}_c' for n in names)})"""


def last_line(x: str) -> str:
    s = strip(x)
    lb = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
    return f"(CASE WHEN {s} = '' THEN NULL ELSE string_split_regex({s}, {q(lb)})[-1] END)"


def normalize_gold(x: str) -> str:
    return strip(f"replace({last_line(f'CAST({x} AS VARCHAR)')}, '#### ', '')")


def parse_verdict(x: str) -> str:
    v = f"upper(regexp_extract({x}, {q('(?i)boxed' + WS + r'*\{' + WS + '*(TRUE|FALSE)' + WS + r'*\}')}, 1))"
    return f"(CASE WHEN {v} = 'TRUE' THEN true WHEN {v} = 'FALSE' THEN false END)"


def count_literal(x: str, needle: str) -> str:
    return f"CAST((length({x}) - length(replace({x}, {q(needle)}, ''))) / {len(needle)} AS INTEGER)"


def count_word(x: str, word: str) -> str:
    """Whole-word occurrences: maximal word-character runs equal to the word."""
    return f"CAST(len(list_filter(regexp_extract_all(coalesce({x}, ''), {q(W + '+')}), lambda w: w = {q(word)})) AS BIGINT)"


def marker_total(x: str) -> str:
    return "(" + " + ".join(count_word(x, w) for w in ("Wait", "Alternatively", "But")) + ")"


def split_ws(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE string_split_regex({s}, {q(WS + '+')}) END)"


def rewrite_steps(x: str) -> str:
    return strip(f"regexp_replace({x}, {q(chr(10) + WS + '*(' + D + '+)' + r'\.')}, {q(chr(10) + chr(10) + '---' + chr(10) + chr(10) + '### Step \\1: ')}, 'g')")


def strip_outer_tags(x: str) -> str:
    head = f"regexp_replace({x}, {q('^' + WS + '*<[^>]+>' + WS + '*')}, '')"
    return f"regexp_replace({head}, {q(WS + '*</?[^>]+>' + WS + '*$')}, '')"


# Java (?U) word characters and White_Space (for [^\w\s]-style classes).
JW = r"\pL\p{Nl}\pM\p{Nd}\p{Pc}\x{200c}\x{200d}"
JS = r"\t\n\x{0b}\x{0c}\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def approx_tokens(x: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), {q('[' + JW + ']+|[^' + JW + JS + ']')})) AS BIGINT)"


def md5_unit(seed: str, key: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {seed}, CAST({key} AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0)"


def histogram(src: str, col: str, bins: int) -> str:
    """numpy-style equal-width histogram over [min, max] of ``col`` in ``src``."""
    step = f"((e.hi - e.lo) / {bins}.0)"

    def edge(k: str) -> str:
        return f"(CASE WHEN {k} = {bins} THEN e.hi ELSE CAST({k} AS DOUBLE) * {step} + e.lo END)"

    return f"""
h_e0 AS (SELECT CAST(min({col}) AS DOUBLE) AS lo0, CAST(max({col}) AS DOUBLE) AS hi0 FROM {src}),
h_e AS (SELECT CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM h_e0),
h_i1 AS (SELECT CAST({col} AS DOUBLE) AS x, e.lo, e.hi,
   CASE WHEN CAST(floor((CAST({col} AS DOUBLE) - e.lo) * ({bins}.0 / (e.hi - e.lo))) AS INTEGER) = {bins} THEN {bins - 1}
        ELSE CAST(floor((CAST({col} AS DOUBLE) - e.lo) * ({bins}.0 / (e.hi - e.lo))) AS INTEGER) END AS i1
   FROM {src}, h_e e),
h_i2 AS (SELECT x, lo, hi, CASE WHEN x < {edge('i1').replace('e.', '')} THEN i1 - 1 ELSE i1 END AS i2 FROM h_i1),
h_i3 AS (SELECT CASE WHEN x >= {edge('(i2 + 1)').replace('e.', '')} AND i2 <> {bins - 1} THEN i2 + 1 ELSE i2 END AS bin FROM h_i2),
h_c AS (SELECT bin, count(*) AS n FROM h_i3 GROUP BY bin),
h_all AS (SELECT CAST(b.range AS INTEGER) AS bin, e.lo, e.hi FROM range({bins}) b, h_e e)"""


def histogram_select(round_edges: bool = False) -> str:
    lo = "CAST(a.bin AS DOUBLE) * ((a.hi - a.lo) / BINS.0) + a.lo"
    hi = "CASE WHEN a.bin = BINS - 1 THEN a.hi ELSE CAST(a.bin + 1 AS DOUBLE) * ((a.hi - a.lo) / BINS.0) + a.lo END"
    if round_edges:
        lo, hi = f"round({lo}, 9)", f"round({hi}, 9)"
    return f"SELECT a.bin, {lo} AS lo, {hi} AS hi, coalesce(c.n, 0) AS n FROM h_all a LEFT JOIN h_c c ON c.bin = a.bin"


def flagged_class() -> str:
    """Characters whose compatibility decomposition holds a flagged script, as an RE2 class."""
    scripts = {c for lo, hi in FLAGGED_SCRIPTS for c in range(lo, hi + 1)}
    held = {c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and not scripts.isdisjoint(map(ord, unicodedata.normalize("NFKD", chr(c))))}
    starts, ends = sorted(c for c in held if c - 1 not in held), sorted(c for c in held if c + 1 not in held)
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(starts, ends, strict=True)) + "]"
