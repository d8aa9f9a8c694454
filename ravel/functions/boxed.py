"""Answer extraction from model text: ``\\boxed{...}`` and friends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravel.functions.text import col_, py_strip
from ravel.params import NOT_FOUND_TEXT

BOXED_OPEN = "\\boxed{"


def extract_boxed(c: Column | str) -> Column:
    """Content of the last ``\\boxed{`` with balanced braces, stripped.

    Empty string when there is no box.  When the box is never closed the
    content runs to the end of the text minus its last character (the scan
    stops at the end and drops one character, as the original loop does).
    The brace scan is a fold over brace/non-brace tokens, so it stays linear
    and JVM-side.
    """
    s = col_(c)
    tail = F.substring_index(s, BOXED_OPEN, -1)
    tokens = F.regexp_extract_all(tail, F.lit(r"\{|\}|[^{}]+"), F.lit(0))
    init = F.struct(F.lit(1).alias("d"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(acc, t):
        opened = acc["d"] + 1
        closed = acc["d"] - 1
        return (
            F.when(acc["done"], acc)
            .when(t == "{", F.struct(opened.alias("d"), (acc["n"] + 1).alias("n"), F.lit(False).alias("done")))
            .when(
                t == "}",
                F.struct(
                    closed.alias("d"),
                    F.when(closed == 0, acc["n"]).otherwise(acc["n"] + 1).alias("n"),
                    (closed == 0).alias("done"),
                ),
            )
            .otherwise(F.struct(acc["d"].alias("d"), (acc["n"] + F.length(t)).alias("n"), F.lit(False).alias("done")))
        )

    state = F.aggregate(tokens, init, step)
    keep = F.when(state["done"], state["n"]).otherwise(F.length(tail) - 1)
    content = tail.substr(F.lit(1), F.greatest(keep, F.lit(0)))
    return F.when(s.contains(BOXED_OPEN), py_strip(content)).otherwise(F.lit(""))


def after_equals(c: Column | str) -> Column:
    """Text after the last ``=``, stripped (whole text stripped if none)."""
    return py_strip(F.substring_index(col_(c), "=", -1))


def first_boxed_simple(c: Column | str) -> Column:
    """First ``\\boxed{...}`` without nesting, on one line; null if none."""
    s = col_(c)
    pat = r"(?dU)\\boxed\{(.*?)\}"
    return F.when(s.rlike(pat), py_strip(F.regexp_extract(s, pat, 1)))


def extract_answer_fallback(c: Column | str) -> Column:
    """First simple box, else the last digit run, else a not-found text."""
    s = col_(c)
    digits = F.regexp_extract_all(s, F.lit(r"(?U)\d+"), F.lit(0))
    last_digits = F.when(F.size(digits) > 0, F.element_at(digits, -1))
    return F.coalesce(first_boxed_simple(s), last_digits, F.lit(NOT_FOUND_TEXT))


def fix_choice_box(c: Column | str) -> Column:
    """In each ``\\boxed{...}`` (one nested level allowed) keep only a letter A-D if one is present.

    The letter must be followed by whitespace, ``.)`` ``,:;`` or the end of
    the box content; the first such letter (any case) is kept, uppercased.
    Boxes without such a letter are left as they are.
    """
    s = F.coalesce(col_(c), F.lit(""))
    box = r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}"
    pieces = F.split(s, box)
    boxes = F.regexp_extract_all(s, F.lit(box), F.lit(0))
    letter_pat = r"(?idU)([A-D])(?=[\s\x1c-\x1f.),:;]|$)"

    def fix(b):
        inner = F.regexp_extract(b, r"(?s)\A\\boxed\{(.*)\}\z", 1)
        letter = F.regexp_extract(inner, letter_pat, 1)
        return F.when(letter != "", F.concat(F.lit("\\boxed{"), F.upper(letter), F.lit("}"))).otherwise(b)

    fixed = F.concat(F.transform(boxes, fix), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, fixed, lambda p, b: F.concat(p, b)), "")
