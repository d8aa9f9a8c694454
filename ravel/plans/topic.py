"""Topic filtering jobs with a single ``decision`` column.

Per row, in source order: ``duplicate`` (normalised problem seen earlier) ->
``no_boxed`` (response has no ``\\boxed``) -> ``topic`` / ``other``.  The
duplicate check runs first, so a dropped first row still shadows its
copies.  Keyword classification is a Column; model verdicts are a table
joined by id (hybrid: keyword hit or a positive verdict).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.functions.answers import parse_topic_verdict
from ravel.functions.text import normalized_key
from ravel.operators.dedup import mark_first
from ravel.operators.filters import has_boxed, topic_match
from ravel.operators.ranking import take_first
from ravel.params import TOPIC_PATTERNS


def classify_topic(df: DataFrame, problem: str = "problem", mode: str = "keyword", verdicts: DataFrame | None = None,
                   key: str = "id", reply: str | None = None, verdict_flag: str | None = "is_topic",
                   patterns=TOPIC_PATTERNS) -> DataFrame:
    """Add ``is_topic``.

    ``keyword``: pattern match.  ``model``: the verdict table only.
    ``hybrid``: keyword hit, else the verdict (missing verdict = false).
    A verdict is either a boolean column (``verdict_flag``) or a reply text
    (``reply``) holding the topic word.
    """
    kw = topic_match(problem, patterns)
    if mode == "keyword":
        return df.withColumn("is_topic", kw)
    if verdicts is None:
        raise ValueError(f"mode {mode!r} needs a verdicts table")
    flag = parse_topic_verdict(reply) if reply else F.col(verdict_flag)
    v = verdicts.select(F.col(key), flag.alias("_verdict"))
    joined = df.join(v, on=key, how="left")
    model = F.coalesce(F.col("_verdict"), F.lit(False))
    out = model if mode == "model" else (kw | model)
    return joined.withColumn("is_topic", out).drop("_verdict")


def topic_decisions(df: DataFrame, problem: str = "problem", response: str = "response", row_id: str = "id",
                    filter_duplicates: bool = True, filter_boxed: bool = True, **classify) -> DataFrame:
    """Every row with its ``decision`` (duplicate / no_boxed / topic / other)."""
    rows = classify_topic(df, problem, **classify)
    if filter_duplicates:
        rows = mark_first(rows, normalized_key(F.coalesce(F.col(problem), F.lit(""))), row_id)
        dup = ~F.col("_first")
    else:
        dup = F.lit(False)
    no_box = ~has_boxed(response) if filter_boxed else F.lit(False)
    decision = F.when(dup, "duplicate").when(no_box, "no_boxed").when(F.col("is_topic"), "topic").otherwise("other")
    return rows.withColumn("decision", decision).drop("_first")


def filter_topic(df: DataFrame, **kw) -> DataFrame:
    """Topic rows (the kept output); ``decision = 'other'`` rows are the rejects sink."""
    return topic_decisions(df, **kw).filter(F.col("decision") == "topic")


def filter_topic_dataset(df: DataFrame, max_samples: int | None = None, row_id: str = "id", **kw) -> DataFrame:
    """Same from a dataset: first ``max_samples`` rows, duplicates and box-less rows dropped before classifying."""
    rows = take_first(df, [F.col(row_id)], max_samples) if max_samples else df
    return topic_decisions(rows, row_id=row_id, **kw).filter(F.col("decision") == "topic")
