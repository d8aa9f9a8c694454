"""Evaluation, reward scoring, answer comparison and SFT preparation jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.functions.answers import normalize_gold, parse_verdict, with_grade
from ravel.functions.boxed import extract_boxed
from ravel.functions.rewrite import fill_template
from ravel.functions.text import py_strip
from ravel.functions.tokens import mask_marker_words, mask_step_numbers, sft_labels
from ravel.operators.aggregates import eval_accuracy
from ravel.operators.ranking import take_first
from ravel.operators.rewards import reward_length, reward_registry, reward_total
from ravel.params import EQUIVALENCE_PROMPT, EQUIVALENCE_SLOTS, MASK_RATIO, REWARD_WEIGHTS


def evaluation_details(samples: DataFrame, outputs: DataFrame, key: str = "sample_id", problem: str = "problem",
                       answer: str = "answer", output: str = "output", tokens: str = "token_generated",
                       eval_size: int = 0, gold_last_line: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per-sample details: question, ground_truth, prediction, raw_output, token_generated, is_correct, and the columns to ``carry``."""
    s = take_first(samples, [F.col(key)], eval_size) if eval_size and eval_size > 0 else samples
    j = s.join(outputs, on=key, how="inner")
    gold = normalize_gold(answer) if gold_last_line else F.col(answer).cast("string")
    staged = j.select(
        F.col(key),
        F.col(problem).alias("question"),
        gold.alias("ground_truth"),
        extract_boxed(output).alias("prediction"),
        py_strip(output).alias("raw_output"),
        F.col(tokens).alias("token_generated"),
        *carry,
    )
    return with_grade(staged, "question", "prediction", "ground_truth", "is_correct")


def evaluate_runs(samples: DataFrame, outputs: DataFrame, group: list[str], **kw) -> tuple[DataFrame, DataFrame]:
    """(details, summary): summary = accuracy (%) and mean generated tokens per group."""
    own = {kw.get("key", "sample_id"), "question", "ground_truth", "prediction", "raw_output", "token_generated"}
    details = evaluation_details(samples, outputs, carry=tuple(g for g in group if g not in own), **kw)
    return details, eval_accuracy(details, group)


def score_completions(completions: DataFrame, content: str = "content", solution: str = "solution",
                      weights: dict[str, float] = REWARD_WEIGHTS, group: str = "prompt_id") -> DataFrame:
    """Every reward per completion plus the weighted total of the chosen ones."""
    from ravel.operators.rewards import with_correct

    scored = reward_length(with_correct(completions, content, solution), content, solution, group, out="length")
    regs = reward_registry(F.col("_correct"), content)
    regs["length"] = F.col("length")
    cols = [regs[name].alias(name) for name in regs if name != "length"]
    out = scored.select("*", *cols)
    return out.withColumn("total", reward_total({n: F.col(n) for n in regs}, weights)).drop("_correct")


def equivalence_prompts(pairs: DataFrame, instruction: str = "instruction", ans1: str = "ans1", ans2: str = "ans2",
                        template: str = EQUIVALENCE_PROMPT) -> DataFrame:
    return pairs.withColumn("prompt", fill_template(template, EQUIVALENCE_SLOTS, [F.col(instruction), F.col(ans1), F.col(ans2)]))


def compare_answers(pairs: DataFrame, replies: DataFrame, key: str = "id", reply: str = "verdict_text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``equivalent``, one-row counts of true / false)."""
    v = replies.select(F.col(key), parse_verdict(reply).alias("equivalent"))
    rows = pairs.join(v, on=key, how="left")
    counts = rows.agg(F.count_if(F.col("equivalent") == F.lit(True)).alias("true"),
                      F.count_if(F.col("equivalent") == F.lit(False)).alias("false"))
    return rows, counts


def prepare_sft(tokens: DataFrame, think_id: int, step_ids: list[int], colon_id: int, word_seqs: list[list[int]],
                ids: str = "input_ids", row_key: str = "id", mask: bool = True, ratio: float = MASK_RATIO,
                seed: int = 42) -> DataFrame:
    """input_ids + labels: prompt masked up to the think token; on training rows the step
    numbers (all but one) and a share of the marker-word spans are masked too."""
    rows = tokens.filter(F.array_contains(ids, think_id)).select(row_key, ids, sft_labels(ids, think_id).alias("labels"))
    if mask:
        rows = mask_step_numbers(rows, ids, "labels", step_ids, colon_id, row_key, seed)
        rows = mask_marker_words(rows, ids, "labels", word_seqs, ratio, row_key, seed)
    return rows
