"""Row filters and predicates (all JVM-side Column expressions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, NumericType, StringType

from ravel.functions.rewrite import THINK_END
from ravel.functions.text import col_, has_any, py_pattern, py_strip
from ravel.params import GOOD_THINKING_MARKERS, LOW_QUALITY_PATTERNS, TOPIC_PATTERNS

TOPIC_FLAGS = "iudU"  # case-insensitive (Unicode), '.'/'$' stop at \n only, Unicode classes


def nonempty(c: Column | str) -> Column:
    """Question present and not the empty string (whitespace-only passes)."""
    c = col_(c)
    return c.isNotNull() & (c != "")


def filter_nonempty_question(df: DataFrame, question: str = "problem") -> DataFrame:
    return df.filter(nonempty(question))


def any_key_equals(pairs) -> Column:
    """Any ``(column, value)`` pair matches (null-safe)."""
    return reduce(lambda a, b: a | b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in pairs])


def filter_any_key_equals(df: DataFrame, pairs) -> DataFrame:
    return df.filter(any_key_equals(pairs))


def correct_flag(df: DataFrame, column: str) -> Column:
    """Grade normalised to boolean: "Yes" or true (first element of a list)."""
    dtype = df.schema[column].dataType
    c = F.col(column)
    if isinstance(dtype, ArrayType):
        dtype, c = dtype.elementType, F.get(c, 0)
    if isinstance(dtype, StringType):
        return F.coalesce(c == "Yes", F.lit(False))
    if isinstance(dtype, BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(dtype, NumericType):
        return F.coalesce(c == 1, F.lit(False))
    return F.lit(False)


def filter_correct(df: DataFrame, column: str) -> DataFrame:
    return df.filter(correct_flag(df, column))


def topic_match(c: Column | str, patterns=TOPIC_PATTERNS) -> Column:
    """Any topic pattern matches the lowercased text."""
    return has_any(F.lower(col_(c)), patterns, TOPIC_FLAGS)


def filter_topic(df: DataFrame, column: str = "problem", patterns=TOPIC_PATTERNS) -> DataFrame:
    return df.filter(topic_match(column, patterns))


def has_boxed(c: Column | str) -> Column:
    """Response contains ``\\boxed`` (no brace needed); null counts as ''."""
    return F.coalesce(col_(c), F.lit("")).contains("\\boxed")


def filter_has_boxed(df: DataFrame, response: str = "response") -> DataFrame:
    return df.filter(has_boxed(response))


def low_quality(problem: Column | str, think: Column | str | None, response: Column | str) -> Column:
    """Low quality when no ``\\boxed{`` follows the last ``</think>`` of the response,
    or any low-quality pattern occurs in problem, think or response.

    The patterns are checked per field: in the rendered chat the fields are
    separated by markup and newlines no pattern can span.
    """
    resp = F.coalesce(col_(response), F.lit(""))
    after = F.substring_index(resp, THINK_END, -1)
    no_box = ~after.rlike(py_pattern(r"(?U)\\boxed\s*\{"))
    fields = [resp, col_(problem)] + ([col_(think)] if think is not None else [])  # the short one first
    return reduce(lambda a, b: a | b, [low_quality_text(f) for f in fields], no_box)


def low_quality_text(c: Column | str) -> Column:
    """Any low-quality pattern occurs in the text."""
    return has_any(c, LOW_QUALITY_PATTERNS, "iUd")


def filter_low_quality(df: DataFrame, problem="problem", think="think", response="response") -> DataFrame:
    return df.filter(~low_quality(problem, think if think in df.columns else None, response))


def step_by_step(c: Column | str, min_steps: int = 2) -> Column:
    """At least ``min_steps`` numbered steps (newline, optional space, digits, dot)."""
    return F.regexp_count(F.coalesce(col_(c), F.lit("")), F.lit(py_pattern(r"(?U)\n\s*\d+\."))) >= min_steps


def filter_step_by_step(df: DataFrame, response: str = "response") -> DataFrame:
    return df.filter(step_by_step(response))


def good_thinking(think: Column | str, solution: Column | str, max_segment_chars: int | None = None,
                  markers=GOOD_THINKING_MARKERS) -> Column:
    """Think null passes; else every ``\\n\\n`` segment (stripped) is short enough and a
    marker word occurs in the lowercased think.  The solution must not open a LaTeX
    environment."""
    t = col_(think)
    has_marker = F.exists(F.array(F.lower(t)), lambda low: reduce(lambda a, b: a | b, [low.contains(m) for m in markers]))
    think_ok = has_marker
    if max_segment_chars is not None:
        seg_ok = F.forall(F.split(t, "\n\n"), lambda s: F.length(py_strip(s)) <= max_segment_chars)
        think_ok = seg_ok & has_marker
    return (t.isNull() | think_ok) & ~F.coalesce(col_(solution), F.lit("")).contains("\\begin{")


def filter_good_thinking(df: DataFrame, think="think", solution="response", max_segment_chars=None) -> DataFrame:
    return df.filter(good_thinking(think, solution, max_segment_chars))


def token_in_range(c: Column | str, min_token: int | None, max_token: int | None) -> Column:
    bounds = [lambda n, b=min_token: n >= b] * (min_token is not None) + [lambda n, b=max_token: n <= b] * (max_token is not None)
    if not bounds:
        return F.lit(True)
    # the count is one element of an array, so that it is taken once for both bounds
    return F.exists(F.array(col_(c)), lambda n: reduce(lambda a, b: a & b, [test(n) for test in bounds]))


def filter_token_range(df: DataFrame, token_len: str, min_token=None, max_token=None) -> DataFrame:
    return df.filter(token_in_range(token_len, min_token, max_token))
