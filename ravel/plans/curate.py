"""Curation jobs: one raw source to the curated schema, unions, the test set.

Row order matters in the original (a shuffled stream with "first accepted"
caps).  Here the shuffle is a key (md5 of seed and row id) and every
order-dependent step is a rank on that key: per-group caps are
``row_number() <= N`` per group, the sample cap is a top-n on the key.
The curated schema always has the same columns:
``row_id, problem, response, data_type, difficulty, source, answer, mask,
think, boxed_force``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ravel.functions.boxed import extract_boxed
from ravel.functions.chat import build_messages, render_chat
from ravel.functions.rewrite import approx_token_count, box_answer_signal, bucket_difficulty, rewrite_steps, split_think_answer
from ravel.functions.text import py_strip, strip_named_tags, strip_outer_tags
from ravel.operators.filters import (
    any_key_equals, correct_flag, good_thinking, low_quality, low_quality_text, nonempty, step_by_step, token_in_range, topic_match,
)
from ravel.operators.ranking import global_rank, take_first
from ravel.operators.sampling import cap_per_group, sample_by_length, sample_first_accepted, seeded_shuffle, shuffle_key
from ravel.params import TEST_SHUFFLE_SEED, SourceSpec
from ravel.session import written

BUCKET = 100_000  # rows per bucket of the turn of questions
CURATED_COLUMNS = ["row_id", "problem", "response", "data_type", "difficulty", "source", "answer", "mask", "think", "boxed_force"]


def _first(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return F.get(c, 0) if isinstance(df.schema[name].dataType, ArrayType) else c


def rendered_token_count(question: str, think: str, answer: str, spec: SourceSpec) -> Column:
    """Token count of the rendered chat: the parts' counts and those of the template around them.

    Newlines and markup separate the parts, so no token spans two; the template's own
    count is a constant (rendered with empty parts) that the planner folds.
    """
    def template(empty_think: Column) -> Column:
        msgs = build_messages(F.lit(""), empty_think, F.lit(""), spec.boxed_force, True, spec.system_prompt)
        return approx_token_count(render_chat(msgs))

    around = F.when(F.col(think).isNull(), template(F.lit(None).cast("string"))).otherwise(template(F.lit("")))
    return around + approx_token_count(question) + approx_token_count(think) + approx_token_count(answer)


def _source_rows(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    df = raw
    if spec.max_data_samples is not None:
        df = take_first(df, [F.col(spec.row_id_col)], spec.max_data_samples)
    return df.filter(any_key_equals(spec.keys_equal)) if spec.keys_equal else df


def _shape_answers(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """What a row's shape and filters take from its answer and thinking alone: ``_a, _think`` plus the raw columns."""
    answer = _first(df, spec.answer_col).cast("string") if spec.answer_col in df.columns else F.lit(None).cast("string")
    if spec.correct_col is not None:
        df = df.filter(correct_flag(df, spec.correct_col))
    df = df.withColumn("_a", answer)
    if spec.answer_signal is not None:
        df = df.withColumn("_a", box_answer_signal("_a", spec.answer_signal))
    think = F.lit(None).cast("string")
    if spec.think_col is not None:
        think = F.coalesce(_first(df, spec.think_col).cast("string"), F.lit(""))
        if spec.answer_col == "</think>":
            t, a = split_think_answer(think)
            df = df.withColumn("_a", a)
            think = t
        df = df.withColumn("_think", think).filter(F.col("_think").isNotNull() | F.lit(spec.answer_col != "</think>"))
        df = df.withColumn("_think", strip_outer_tags("_think"))
    else:
        df = df.withColumn("_think", think)
    df = df.filter(F.col("_a").isNotNull())
    if spec.strip_answer_tags:
        df = df.withColumn("_a", strip_named_tags("_a", spec.strip_answer_tags))
    return df.filter(step_by_step("_a") & good_thinking("_think", "_a", spec.max_think_segment_chars) & ~low_quality(F.lit(""), "_think", "_a"))


def _asked(question: str, spec: SourceSpec) -> Column:
    """Is the question itself one to keep (whatever its length)."""
    good = nonempty(question) & ~low_quality_text(question)
    return good & topic_match(question, spec.topic_patterns) if spec.topic_only else good


def _token_count(question: str, spec: SourceSpec) -> Column:
    if spec.token_len_col is not None:
        return F.col(spec.token_len_col).cast("long")
    return rendered_token_count(question, "_think", "_a", spec)


def shape_source(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Per-row mapping and filters (no caps): ``_q, _a, _think, _tok`` plus the raw columns."""
    df = _source_rows(raw, spec).withColumn("_q", F.col(spec.question_col).cast("string")).filter(_asked("_q", spec))
    df = _shape_answers(df, spec)
    return df.withColumn("_tok", _token_count("_q", spec)).filter(token_in_range("_tok", spec.min_token, spec.max_token))


def _parity(before: WindowSpec, start: Column) -> Column:
    """0 / 1 before a row, from ``start`` on: the last value set before it, turned by the flips since (or ``start``, by all)."""
    flips = F.coalesce(F.sum("_flip").over(before), F.lit(0))
    held = F.last(F.when(F.col("_set").isNotNull(), F.struct("_set", F.col("_done").alias("done"))), ignorenulls=True).over(before)
    return F.pmod(F.when(held.isNotNull(), held["_set"] + flips - held["done"]).otherwise(start + flips), F.lit(2)).cast("int")


def alternate_questions(flags: DataFrame, row_id: str, order: list[Column], bucket: int = BUCKET) -> DataFrame:
    """``(row_id, alternate)`` of the accepted rows when the second question is asked after an odd number of accepted rows.

    ``flags`` says with ``_e`` and ``_v`` (1 or 0, not both 0) whether a row would be accepted with the first
    and the second question.  Going through the rows in ``order``, one that both accept flips the parity, one that only
    the first (second) accepts sets it to 1 (0).  These four maps compose, so buckets of
    ``bucket`` rows are summed up on their own, a table with one row per bucket gives each its
    start, and the rows of a bucket follow from there: no task sees the whole source.
    """
    keys = [k.alias(f"_k{i}") for i, k in enumerate(order)]
    ranked = global_rank(flags.select(row_id, "_e", "_v", *keys), [f"_k{i}" for i in range(len(order))], "_rank")
    rows = (ranked.withColumn("_b", F.floor(F.col("_rank") / bucket))
            .withColumn("_flip", F.col("_e") * F.col("_v"))
            .withColumn("_set", F.when(F.col("_e") != F.col("_v"), F.col("_e"))))
    upto = Window.partitionBy("_b").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_done", F.sum("_flip").over(upto))
    last = F.max_by(F.struct("_set", F.col("_done").alias("done")), F.when(F.col("_set").isNotNull(), F.col("_rank")))
    sums = rows.groupBy("_b").agg(last.alias("_l"), F.sum("_flip").alias("_n"))
    sums = sums.select("_b", F.pmod(F.col("_l._set") + F.col("_n") - F.col("_l.done"), F.lit(2)).alias("_set"),
                       F.when(F.col("_l").isNull(), F.col("_n")).otherwise(0).alias("_flip"))
    everything = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_done", F.sum("_flip").over(everything))
    starts = sums.select("_b", _parity(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), F.lit(0)).alias("_start"))
    earlier = Window.partitionBy("_b").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    told = rows.join(starts, "_b").withColumn("_p", _parity(earlier, F.col("_start")))
    taken = F.when(F.col("_p") == 0, F.col("_e")).otherwise(F.col("_v")) == 1
    return told.filter(taken).select(row_id, (F.col("_p") == 1).alias("alternate"))


def _accepted(raw: DataFrame, spec: SourceSpec, order: list[Column]) -> DataFrame:
    """Shaped rows; with a second question column, each row with the question that its turn asks.

    Answer and thinking are shaped once, each question is tested on the same row, and what either question would accept is
    written once; the turns are read from its slim flags and the output from its rows.
    """
    if spec.question_alt_col is None:
        return shape_source(raw, spec)
    if spec.group_col is not None:
        raise ValueError("the turn of a question depends on all rows accepted before; it can't be paired with a cap per group")
    both = {"_q1": F.col(spec.question_col).cast("string"), "_q2": F.col(spec.question_alt_col).cast("string")}
    asked = _source_rows(raw, spec).withColumns(both).withColumns({f"_ask{i}": F.coalesce(_asked(f"_q{i}", spec), F.lit(False)) for i in (1, 2)})
    shaped = _shape_answers(asked.filter("_ask1 or _ask2"), spec)
    counted = shaped.withColumns({f"_tok{i}": F.when(F.col(f"_ask{i}"), _token_count(f"_q{i}", spec)) for i in (1, 2)})
    fits = {flag: F.coalesce(F.col(f"_ask{i}") & token_in_range(f"_tok{i}", spec.min_token, spec.max_token), F.lit(False)).cast("int") for i, flag in ((1, "_e"), (2, "_v"))}
    rows = written(counted.withColumns(fits).drop("_ask1", "_ask2").filter("_e + _v > 0"), "questions")
    turns = alternate_questions(rows.select(spec.row_id_col, "_e", "_v"), spec.row_id_col, order)
    second = F.col("alternate")
    told = rows.join(turns, spec.row_id_col).withColumns({"_q": F.when(second, F.col("_q2")).otherwise(F.col("_q1")), "_tok": F.when(second, F.col("_tok2")).otherwise(F.col("_tok1"))})
    return told.drop("_q1", "_q2", "_tok1", "_tok2", "_e", "_v", "alternate")


def curate_source(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """One raw source -> curated rows (see module docstring for the order of steps)."""
    order = [shuffle_key(spec.seed, spec.row_id_col), F.col(spec.row_id_col)]
    df = _accepted(raw, spec, order)
    if spec.group_col is not None and spec.max_per_group is not None:
        df = cap_per_group(df, spec.group_col, spec.max_per_group, order)
    if spec.length_sampling:
        if spec.n_samples is None:
            raise ValueError("length sampling needs n_samples")
        if spec.max_candidates is not None:
            df = sample_first_accepted(df, spec.max_candidates, None, spec.seed, spec.row_id_col)
        df = sample_by_length(df, "_tok", spec.n_samples, spec.length_power, spec.seed, spec.row_id_col)
    else:
        df = sample_first_accepted(df, spec.n_samples, spec.max_candidates, spec.seed, spec.row_id_col)
    return curated_columns(df, spec)


def curated_columns(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """The curated schema of shaped rows."""
    a = py_strip("_a")
    return df.select(
        F.col(spec.row_id_col).cast("long").alias("row_id"),
        py_strip("_q").alias("problem"),
        rewrite_steps(a).alias("response"),
        F.lit(spec.data_type).alias("data_type"),
        bucket_difficulty("_tok").alias("difficulty"),
        F.lit(spec.name).alias("source"),
        (extract_boxed(a) if spec.boxed_force else F.lit(None).cast("string")).alias("answer"),
        (py_strip(F.col(spec.mask_col).cast("string")) if spec.mask_col else F.lit(None).cast("string")).alias("mask"),
        (py_strip("_think") if spec.think_col else F.lit(None).cast("string")).alias("think"),
        F.lit(spec.boxed_force).alias("boxed_force"),
    )


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Bag union by column name; missing columns are filled with nulls."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def build_corpus(sources: list[tuple[DataFrame, SourceSpec]]) -> DataFrame:
    return union_sources([curate_source(df, spec) for df, spec in sources])


def build_test_set(raw: DataFrame, spec: SourceSpec, seed: int = TEST_SHUFFLE_SEED) -> DataFrame:
    """Benchmark source with answer boxing, in a seeded shuffle order."""
    return seeded_shuffle(curate_source(raw, spec), seed, "row_id")
