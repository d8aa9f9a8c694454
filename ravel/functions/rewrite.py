"""Row-level text shaping used by curation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravel.functions.text import col_, py_lines, py_pattern, py_strip
from ravel.params import EASY_BELOW, MEDIUM_BELOW

THINK_END = "</think>"


def rewrite_steps(c: Column | str) -> Column:
    """Newline + ``N.`` becomes a rule and ``### Step N: ``; result stripped."""
    return py_strip(F.regexp_replace(col_(c), py_pattern(r"(?U)\n\s*(\d+)\."), "\n\n---\n\n### Step $1: "))


def box_answer_signal(c: Column | str, signal: str) -> Column:
    """If the last line starts with ``signal``, rewrite it as ``The answer is: \\boxed{...}``.

    Every occurrence of the signal in that line is removed before boxing;
    the lines are joined again with ``\\n``.  Null for blank text.
    """
    s = py_strip(c)
    lines = py_lines(s)
    last = F.element_at(lines, -1)
    boxed = F.concat(F.lit("The answer is: \\boxed{"), py_strip(F.replace(last, F.lit(signal), F.lit(""))), F.lit("}"))
    new_last = F.when(last.startswith(signal), boxed).otherwise(last)
    rebuilt = F.array_join(F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(new_last)), "\n")
    return F.when(s != "", rebuilt)


def split_think_answer(c: Column | str) -> tuple[Column, Column]:
    """(think, answer) split at the first ``</think>``; both null when absent."""
    s = col_(c)
    has = s.contains(THINK_END)
    think = py_strip(F.substring_index(s, THINK_END, 1))
    answer = py_strip(s.substr(F.locate(THINK_END, s) + F.lit(len(THINK_END)), F.lit(2**31 - 1)))
    return F.when(has, think), F.when(has, answer)


def bucket_difficulty(tok_len: Column | str) -> Column:
    t = col_(tok_len)
    return F.when(t < EASY_BELOW, "easy").when(t < MEDIUM_BELOW, "medium").otherwise("hard")


def think_length(c: Column | str) -> Column:
    """Code-point length of the think text, 0 when missing."""
    return F.length(F.coalesce(col_(c), F.lit(""))).cast("long")


def fill_template(template: str, slots: tuple[str, ...], values: list[Column]) -> Column:
    """Fill slots one after another with literal replacement (like chained ``str.replace``)."""
    out = F.lit(template)
    for slot, val in zip(slots, values):
        out = F.replace(out, F.lit(slot), F.coalesce(val, F.lit("")))
    return out


def approx_token_count(c: Column | str) -> Column:
    """Pre-tokeniser count (word runs and single punctuation marks).

    A stand-in when no token-length column is supplied: sub-word tokenisers
    are per-row codecs that run outside this library.
    """
    return F.regexp_count(F.coalesce(col_(c), F.lit("")), F.lit(r"(?U)\w+|[^\w\s]")).cast("long")
