"""Answer normalisation and grading as Column expressions.

``with_grade`` follows the original order of steps: ``\\text{}`` to lowercase,
"does not exist" to ``dne``, a choice letter to the value printed in the
question, then a comparison of the after-``=`` forms or else the full forms.

The comparison itself is re-aimed: the original calls a symbolic maths
verifier per row.  Here two answers are equal when their canonical strings
are equal (whitespace, ``$``, ``\\left``/``\\right``, spacing commands,
``\\dfrac``/``\\tfrac``, degree marks and a trailing period removed), when
both parse as the same number (integer, decimal, ``a/b``, ``\\frac{a}{b}``,
signed), or when both are expressions with the same values (``x+1`` and
``1+x``, see :mod:`ravel.functions.algebra`).  An empty canonical gold counts as
"not parseable".  Sets, intervals, relations and matrices are compared as strings
only; the ``join_verdicts`` operator lets an external verdict table fill that gap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravel.functions import algebra
from ravel.functions.boxed import after_equals
from ravel.functions.text import WS, col_, last_line, py_rstrip_chars, py_strip
from ravel.params import GOLD_SIGNAL, TEXT_COMMAND, TEXT_LETTER, TOPIC_WORD

LETTERS = ("A", "B", "C", "D")


def normalize_text_cmd(c: Column | str) -> Column:
    """``\\text{X}`` -> lowercase ``X`` (every occurrence)."""
    s = col_(c)
    pieces = F.split(s, TEXT_COMMAND)
    inner = F.regexp_extract_all(s, F.lit(TEXT_COMMAND), F.lit(1))
    lowered = F.concat(F.transform(inner, lambda x: F.lower(x)), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, lowered, lambda p, m: F.concat(p, m)), "")


def normalize_dne(c: Column | str) -> Column:
    """Whole text "does not exist" (any case, any spacing) -> ``dne``."""
    s = col_(c)
    return F.when(py_strip(s).rlike(rf"(?iU)\Adoes{WS}+not{WS}+exist\z"), F.lit("dne")).otherwise(s)


def choice_letter(c: Column | str) -> Column:
    """``A``..``D`` (any case) or ``\\text{A}`` -> uppercase letter, else ''."""
    t = py_strip(c)
    return (
        F.when(t.rlike(TEXT_LETTER), F.upper(F.regexp_extract(t, TEXT_LETTER, 1)))
        .when(F.upper(t).isin(*LETTERS), F.upper(t))
        .otherwise(F.lit(""))
    )


def _choice_pattern(letter: str) -> str:
    # "A." / "A)" / "A:" optionally wrapped in ** or $, value up to the next
    # B-D label or the end of the question.
    return (
        rf"(?sdU)(?:\*\*|\$)?{letter}[.):](?:\*\*|\$)?\s*(.+?)"
        r"(?:\s*(?:(?:\*\*|\$)?[B-D][.):])|$)"
    )


def choice_value(letter: Column | str, question: Column | str) -> Column:
    """Value printed after the letter's label in the question, '' if none."""
    lt = F.upper(py_strip(letter))
    q = col_(question)
    out = F.lit("")
    for L in reversed(LETTERS):
        pat = _choice_pattern(L)
        val = F.when(q.rlike(pat), F.regexp_extract(q, pat, 1)).otherwise(F.lit(""))
        out = F.when(lt == L, val).otherwise(out)
    return py_strip(py_rstrip_chars(py_strip(out), "."))


def canonical(c: Column | str) -> Column:
    """Canonical answer string used for the equality test."""
    s = col_(c)
    s = F.regexp_replace(s, r"\\(?:left|right|displaystyle)\b", "")
    s = F.regexp_replace(s, r"\\[!,;:]", "")
    s = F.regexp_replace(s, r"\\[dt]frac", r"\\frac")
    s = F.regexp_replace(s, r"\^\{?\\circ\}?", "")
    s = F.regexp_replace(s, rf"(?U){WS}+|\$", "")
    return F.regexp_replace(s, r"\.+\z", "")


_NUM = r"-?\d+(?:\.\d+)?"


def numeric_value(c: Column | str) -> Column:
    """Number written as ``12``, ``-1.5``, ``3/4`` or ``\\frac{3}{4}``; null otherwise."""
    s = col_(c)
    dec = rf"\A{_NUM}\z"
    frac = rf"\A(-?)\\frac\{{({_NUM})\}}\{{({_NUM})\}}\z"
    slash = rf"\A({_NUM})/({_NUM})\z"

    def ratio(a: Column, b: Column) -> Column:
        b = b.cast("double")
        return F.when(b != 0, a.cast("double") / b)

    frac_val = ratio(F.regexp_extract(s, frac, 2), F.regexp_extract(s, frac, 3))
    frac_val = F.when(F.regexp_extract(s, frac, 1) == "-", -frac_val).otherwise(frac_val)
    return (
        F.when(s.rlike(dec), s.cast("double"))
        .when(s.rlike(frac), frac_val)
        .when(s.rlike(slash), ratio(F.regexp_extract(s, slash, 1), F.regexp_extract(s, slash, 2)))
    )


def normalize_gold(c: Column | str, signal: str = GOLD_SIGNAL) -> Column:
    """Gold answer: stripped string, last line, signal removed, stripped."""
    return py_strip(F.replace(last_line(col_(c).cast("string")), F.lit(signal), F.lit("")))


def parse_verdict(c: Column | str) -> Column:
    """``boxed{TRUE|FALSE}`` (any case, any spacing) -> true/false, else null."""
    v = F.upper(F.regexp_extract(col_(c), r"(?iU)boxed\s*\{\s*(TRUE|FALSE)\s*\}", 1))
    return F.when(v == "TRUE", F.lit(True)).when(v == "FALSE", F.lit(False))


def parse_topic_verdict(c: Column | str, word: str = TOPIC_WORD) -> Column:
    """Reply names the topic word (after strip and uppercase)."""
    return F.upper(py_strip(col_(c))).contains(word)


def with_grade(df, question: str, pred: Column | str, gold: Column | str, out: str = "is_correct",
               ignore_not_parseable: bool = False):
    """Is the predicted answer equal to the gold answer, as staged projections: every intermediate is computed once.

    Each normaliser reads its input several times; nesting them as one
    expression would copy the inner ones over and over.  Separate
    projections of non-trivial expressions are kept apart by the optimizer,
    so the work per row stays linear.
    """
    s = df.withColumn("_gp0", normalize_text_cmd(F.coalesce(col_(pred), F.lit(""))))
    s = s.withColumn("_gg0", normalize_text_cmd(F.coalesce(col_(gold), F.lit(""))))
    s = s.withColumn("_gp1", normalize_dne("_gp0")).withColumn("_gg1", normalize_dne("_gg0"))
    s = s.withColumn("_gpl", choice_letter("_gp1")).withColumn("_ggl", choice_letter("_gg1"))
    s = s.withColumn("_gpv", F.when(F.col("_gpl") != "", choice_value("_gpl", question)).otherwise(F.lit("")))
    s = s.withColumn("_ggv", F.when(F.col("_ggl") != "", choice_value("_ggl", question)).otherwise(F.lit("")))
    s = s.withColumn("_gp", F.when(F.col("_gpv") != "", F.col("_gpv")).otherwise(F.col("_gp1")))
    s = s.withColumn("_gg", F.when(F.col("_ggv") != "", F.col("_ggv")).otherwise(F.col("_gg1")))
    for side in ("p", "g"):
        s = s.withColumn(f"_g{side}a", canonical(after_equals(f"_g{side}")))
        s = s.withColumn(f"_g{side}f", canonical(f"_g{side}"))
    for c in ("pa", "ga", "pf", "gf"):
        s = s.withColumn(f"_g{c}v", numeric_value(f"_g{c}"))

    # expressions are read only where strings and numbers leave the question open, and the full forms only where they differ from the others
    def is_open(p: str, g: str) -> Column:
        cp, cg = F.col(f"_g{p}"), F.col(f"_g{g}")
        settled = (cp == cg) | (F.col(f"_g{p}v").isNotNull() & F.col(f"_g{g}v").isNotNull())
        return ~settled & algebra.looks_algebraic(cp) & algebra.looks_algebraic(cg)

    s = s.withColumn("_goa", is_open("pa", "ga"))
    s = s.withColumn("_gof", is_open("pf", "gf") & ~((F.col("_gpa") == F.col("_gpf")) & (F.col("_gga") == F.col("_ggf"))))
    read = [F.when(F.col("_goa"), F.col(f"_g{c}")) for c in ("pa", "ga")] + [F.when(F.col("_gof"), F.col(f"_g{c}")) for c in ("pf", "gf")]
    s = s.withColumn("_gx", F.when(F.col("_goa") | F.col("_gof"), algebra.values(F.array(*read))))

    sides = {"pa": 0, "ga": 1, "pf": 2, "gf": 3}

    def eq(p: str, g: str) -> Column:
        cp, cg, vp, vg = F.col(f"_g{p}"), F.col(f"_g{g}"), F.col(f"_g{p}v"), F.col(f"_g{g}v")
        same_num = vp.isNotNull() & vg.isNotNull() & (F.abs(vp - vg) <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(vg)))
        same = (cp != "") & ((cp == cg) | same_num | algebra.same_values(F.get("_gx", sides[p]), F.get("_gx", sides[g])))
        return ((cg == "") | same) if ignore_not_parseable else F.coalesce(same, F.lit(False))

    s = s.withColumn(out, F.coalesce(eq("pa", "ga") | eq("pf", "gf"), F.lit(False)))
    helpers = [c for c in s.columns if c.startswith("_g") and c not in df.columns]
    return s.drop(*helpers)
