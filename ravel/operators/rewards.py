"""Reward columns over completion rows ``(completion_id, prompt_id, content, solution)``.

Each reward is a Column builder, so a scoring job is one projection; only
``reward_length`` needs per-group extremes, computed by a grouped
aggregate joined back with hot groups salted (no task holds a whole group).
"""

from __future__ import annotations

import math
import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravel.functions.boxed import extract_boxed
from ravel.functions.markers import marker_total
from ravel.functions.text import col_, count_literal, py_split_ws
from ravel.operators.joins import join_per_key
from ravel.params import (
    FLAGGED_SCRIPTS, LATEX_COMMAND, LATEX_SPAN, REPETITION_MAX_PENALTY, REPETITION_NGRAM, STEP_REWARD_PATTERN, CosineParams,
)


def with_correct(df: DataFrame, content: str = "content", solution: str = "solution", out: str = "_correct") -> DataFrame:
    """Add the correctness flag once (staged grading) so several rewards can share it."""
    from ravel.functions.answers import with_grade

    staged = df.withColumn("_boxed", extract_boxed(content))
    return with_grade(staged, content, "_boxed", solution, out, ignore_not_parseable=True).drop("_boxed")


def reward_accuracy(correct: Column) -> Column:
    """1.0 where the completion is correct (see :func:`with_correct`), else 0.0."""
    return correct.cast("double")


def reward_format(content: Column | str) -> Column:
    """1.0 iff ``\\n</think>\\n`` occurs exactly once."""
    return F.when(count_literal(content, "\n</think>\n") == 1, 1.0).otherwise(0.0)


def reward_steps(content: Column | str) -> Column:
    """min(1, matches / 3) of step markers; ``^\\d+\\.`` only at the start of the text."""
    n = F.regexp_count(F.coalesce(col_(content), F.lit("")), F.lit("(?U)" + STEP_REWARD_PATTERN))
    return F.least(F.lit(1.0), n / F.lit(3.0))


def _cosine(progress: Column, correct: Column, p: CosineParams) -> Column:
    cos = F.cos(progress * F.lit(math.pi))
    lo = F.when(correct, F.lit(p.min_value_correct)).otherwise(F.lit(p.max_value_wrong))
    hi = F.when(correct, F.lit(p.max_value_correct)).otherwise(F.lit(p.min_value_wrong))
    return lo + F.lit(0.5) * (hi - lo) * (F.lit(1.0) + cos)


def reward_cosine_length(content: Column | str, correct: Column, p: CosineParams = CosineParams()) -> Column:
    """Cosine-scaled reward on text length (wrong answers swap the bounds)."""
    progress = F.least(F.length(col_(content)) / F.lit(float(p.max_len)), F.lit(1.0))
    return _cosine(progress, correct, p)


def reward_cosine_markers(content: Column | str, correct: Column, p: CosineParams = CosineParams()) -> Column:
    """Same curve on the number of marker words (Wait / Alternatively / But)."""
    progress = F.least(marker_total(content) / F.lit(float(p.max_word)), F.lit(1.0))
    return _cosine(progress, correct, p)


def reward_repetition(content: Column | str, ngram: int = REPETITION_NGRAM, max_penalty: float = REPETITION_MAX_PENALTY) -> Column:
    """(1 - distinct n-grams / n-grams) * max_penalty over lowercased words; 0 if empty or too short.

    n-grams are joined into strings so ``array_distinct`` hashes them.
    """
    if max_penalty > 0:
        raise ValueError(f"max_penalty {max_penalty} should not be positive")
    # the words are split once: they are the one element of an array whose transform does the rest
    def score(words: Column) -> Column:
        total = F.size(words) - ngram + 1
        grams = F.slice(words, 1, F.greatest(total, F.lit(0)))
        for j in range(1, ngram):
            grams = F.zip_with(grams, F.slice(words, j + 1, F.greatest(total, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        value = (F.lit(1.0) - F.size(F.array_distinct(grams)) / total) * F.lit(float(max_penalty)) + F.lit(0.0)
        return F.when(F.size(words) < ngram, 0.0).otherwise(value)

    return F.get(F.transform(F.array(py_split_ws(F.lower(col_(content)))), score), 0)


def reward_formula(content: Column | str) -> Column:
    """1.0 if the first think block, up to its first blank line, has a ``- formula N:`` line."""
    header = F.regexp_extract(F.coalesce(col_(content), F.lit("")), r"(?s)<think>\n?(.*?)\n\n", 1)
    return F.when(header.rlike(r"(?mdU)^- formula \d+:"), 1.0).otherwise(0.0)


@lru_cache(maxsize=1)
def flagged_class() -> str:
    """Regex class of the characters whose compatibility decomposition (NFKD) holds one of the flagged scripts.

    Made by rule over all code points: a character of these scripts may decompose into others (the Greek
    question mark is a semicolon), and others may decompose into them (the ohm sign, the micro sign).
    """
    def flagged(c: int) -> bool:
        return any(lo <= ord(x) <= hi for x in unicodedata.normalize("NFKD", chr(c)) for lo, hi in FLAGGED_SCRIPTS)

    runs: list[list[int]] = []
    for c in range(sys.maxunicode + 1):
        if flagged(c):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "[" + "".join(f"\\x{{{lo:x}}}" if lo == hi else f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in runs) + "]"


def flag_script(content: Column | str) -> Column:
    """1.0 when the text outside LaTeX, in compatibility decomposition, has no Cyrillic/CJK/Arabic/Hebrew/Thai/Greek letters, else 0.0.

    The script test of the (disabled) language reward; its statistical
    language detector is not rebuilt.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce(col_(content), F.lit("")), LATEX_SPAN, ""), LATEX_COMMAND, "")
    return F.when(text.rlike(flagged_class()), 0.0).otherwise(1.0)


def reward_length(df: DataFrame, content: str = "content", solution: str = "solution", group: str = "prompt_id",
                  out: str = "reward_length", row_id: str = "completion_id") -> DataFrame:
    """Length reward within a group: λ = 0.5 - (len - min)/(max - min); wrong answers get min(0, λ);
    0 for every row when all lengths in the group are equal.  Rows without a group get none.

    The rows of a hot group are dealt over salts by ``row_id`` (by the whole row where there is none)."""
    has_flag = "_correct" in df.columns
    with_len = (df if has_flag else with_correct(df, content, solution)).withColumn("_len", F.length(F.col(content)))
    length = F.length(F.col(content))
    ext = df.groupBy(group).agg(F.min(length).alias("_min"), F.max(length).alias("_max"), F.count(F.lit(1)).alias("_rows"))
    j = join_per_key(with_len, ext, group, "_rows", spread=row_id if row_id in df.columns else None)
    lam = F.lit(0.5) - (F.col("_len") - F.col("_min")) / (F.col("_max") - F.col("_min"))
    val = F.when(F.col("_max") == F.col("_min"), 0.0).when(F.col("_correct"), lam).otherwise(F.least(F.lit(0.0), lam))
    out_df = j.withColumn(out, val).drop("_len", "_min", "_max")
    return out_df if has_flag else out_df.drop("_correct")


def reward_total(rewards: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum of the chosen rewards (names absent from ``rewards`` raise)."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * rewards[name] for name, w in weights.items()])


def reward_registry(correct: Column, content: str = "content", p: CosineParams = CosineParams()) -> dict[str, Column]:
    """Name -> reward Column (row-wise rewards; ``length`` is a DataFrame operator).

    ``correct`` is the flag added once by :func:`with_correct`."""
    return {
        "accuracy": reward_accuracy(correct),
        "format": reward_format(content),
        "reasoning_steps": reward_steps(content),
        "cosine": reward_cosine_length(content, correct, p),
        "cosine_markers": reward_cosine_markers(content, correct, p),
        "repetition": reward_repetition(content),
        "formula": reward_formula(content),
    }
