"""Whole-word marker counts (case-sensitive)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravel.functions.text import col_, py_pattern
from ravel.params import MARKER_WORDS


def count_word(c: Column | str, word: str) -> Column:
    """Occurrences of ``word`` as a whole word (Unicode word boundaries)."""
    escaped = "".join("\\" + ch if not ch.isalnum() else ch for ch in word)
    return F.regexp_count(F.coalesce(col_(c), F.lit("")), F.lit("(?U)" + py_pattern(rf"\b{escaped}\b"))).cast("long")


def marker_counts(c: Column | str, words: tuple[str, ...] = MARKER_WORDS) -> dict[str, Column]:
    return {w: count_word(c, w) for w in words}


def marker_total(c: Column | str, words: tuple[str, ...] = MARKER_WORDS) -> Column:
    return reduce(lambda a, b: a + b, marker_counts(c, words).values())
