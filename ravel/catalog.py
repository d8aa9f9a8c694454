"""Registered queries: one per operator / composite job, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the test tables (or the stand-in views derived from them
in ``ravel.sources.fixtures``) in full and runs the operator named by its
key through the library code.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravel.operators.dedup import dedup_problems
from ravel.operators.filters import low_quality, step_by_step, topic_match
from ravel.session import scratch_path, written
from ravel.sources.fixtures import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


# ---------------------------------------------------------------------------
# M0: usable unique topic problems per source (flagship)
# ---------------------------------------------------------------------------


@register("usable_topic_problems")
def usable_topic_problems(spark, sf):
    """Rows passing the quality, step and topic filters, deduplicated (first id wins), counted per source."""
    r = T(spark, sf, "reasoning")
    ok = r.filter(step_by_step("response") & topic_match("problem") & ~low_quality("problem", "think", "response"))
    return dedup_problems(ok, "problem", ["id"]).groupBy("src").agg(F.count(F.lit(1)).alias("n_problems"))


# ---------------------------------------------------------------------------
# imports for the operator queries
# ---------------------------------------------------------------------------
from ravel.functions import answers as A  # noqa: E402
from ravel.functions import boxed as B  # noqa: E402
from ravel.functions import chat as CH  # noqa: E402
from ravel.functions import rewrite as RW  # noqa: E402
from ravel.functions import text as TX  # noqa: E402
from ravel.functions import tokens as TK  # noqa: E402
from ravel.operators import aggregates as AG  # noqa: E402
from ravel.operators import filters as FL  # noqa: E402
from ravel.operators import joins as JN  # noqa: E402
from ravel.operators import rewards as RWD  # noqa: E402
from ravel.operators import sampling as SM  # noqa: E402
from ravel.operators import selection as SL  # noqa: E402
from ravel.operators import split as SP  # noqa: E402
from ravel.operators.dedup import dedup_keep_first, distinct_problems, estimated_problems, key_digest, problem_sketches  # noqa: E402
from ravel.operators.ranking import sort_by_difficulty  # noqa: E402
from ravel.params import EQUIVALENCE_PROMPT, EQUIVALENCE_SLOTS, MASK_WORDS  # noqa: E402

# Stand-in token sequences of the mask words: length_rows has word lengths for ids, so a word is its length; "Let" and "Now"
# become two tokens, as a sub-word tokeniser may cut them.
MASK_SEQS = [[len(w)] if w not in ("Let", "Now") else [3, len(w) + 1] for w in MASK_WORDS]
R9 = 9  # decimals kept for transcendental results (engines differ in the last bits)


def _boxed(spark, sf):
    c = T(spark, sf, "completions")
    return c.withColumn("boxed", B.extract_boxed("content"))


# ---- 2.9 scalar functions --------------------------------------------------


@register("extract_boxed")
def q_extract_boxed(spark, sf):
    return _boxed(spark, sf).select("completion_id", "boxed")


@register("after_equals")
def q_after_equals(spark, sf):
    return _boxed(spark, sf).select("completion_id", B.after_equals("boxed").alias("value"))


@register("normalize_text_cmd")
def q_normalize_text_cmd(spark, sf):
    return _boxed(spark, sf).select("completion_id", A.normalize_text_cmd("boxed").alias("value"))


@register("normalize_dne")
def q_normalize_dne(spark, sf):
    return _boxed(spark, sf).select("completion_id", A.normalize_dne("boxed").alias("value"))


@register("choice_letter")
def q_choice_letter(spark, sf):
    return _boxed(spark, sf).select("completion_id", A.choice_letter("boxed").alias("letter"))


@register("choice_value")
def q_choice_value(spark, sf):
    b = _boxed(spark, sf)
    return b.select("completion_id", A.choice_value(A.choice_letter("boxed"), F.col("problem")).alias("value"))


@register("grade")
def q_grade(spark, sf):
    b = _boxed(spark, sf)
    return A.with_grade(b, "problem", "boxed", "solution", "is_correct").select("completion_id", "is_correct")


@register("normalize_gold")
def q_normalize_gold(spark, sf):
    return T(spark, sf, "reasoning").select("id", A.normalize_gold("response").alias("gold"))


@register("extract_answer_fallback")
def q_extract_answer_fallback(spark, sf):
    c = T(spark, sf, "completions")
    return c.select("completion_id", B.extract_answer_fallback("content").alias("answer"))


@register("parse_verdict")
def q_parse_verdict(spark, sf):
    return T(spark, sf, "verdicts").select("id", A.parse_verdict("verdict_text").alias("verdict"))


@register("parse_topic_verdict")
def q_parse_topic_verdict(spark, sf):
    return T(spark, sf, "verdicts").select("id", A.parse_topic_verdict("verdict_text", "TRUE").alias("is_topic"))


@register("rewrite_steps")
def q_rewrite_steps(spark, sf):
    return T(spark, sf, "reasoning").select("id", RW.rewrite_steps("response").alias("response"))


@register("fix_choice_box")
def q_fix_choice_box(spark, sf):
    return T(spark, sf, "completions").select("completion_id", B.fix_choice_box("content").alias("content"))


@register("curated_answer")
def q_curated_answer(spark, sf):
    return T(spark, sf, "reasoning").select("id", B.extract_boxed(TX.py_strip("response")).alias("answer"))


@register("find_sublist_end")
def q_find_sublist_end(spark, sf):
    t = T(spark, sf, "token_rows")
    return t.select("id", TK.find_sublist_end("input_ids", [3, 4]).alias("end_pos"),
                    TK.find_sublist_end("input_ids", [1001]).alias("think_end"))


@register("generated_token_count")
def q_generated_token_count(spark, sf):
    t = T(spark, sf, "token_rows")
    return t.select("id", TK.generated_token_count("input_ids", 3, 1).alias("n_generated"))


def _labels(spark, sf, rows="token_rows"):
    t = T(spark, sf, rows)
    return t.withColumn("labels", TK.sft_labels("input_ids", 1000))


@register("sft_examples")
def q_sft_examples(spark, sf):
    return _labels(spark, sf).select("id", "input_ids", "labels")


@register("token_weights")
def q_token_weights(spark, sf):
    w = TK.token_weights("labels", 1001, 0.3)
    return _labels(spark, sf).select("id", F.transform(w, lambda x: F.round(x, R9)).alias("weights"))


@register("mask_step_numbers")
def q_mask_step_numbers(spark, sf):
    return TK.mask_step_numbers(_labels(spark, sf), "input_ids", "labels", [3, 4], 2, "id").select("id", "labels")


@register("mask_marker_words")
def q_mask_marker_words(spark, sf):
    return TK.mask_marker_words(_labels(spark, sf, "length_rows"), "input_ids", "labels", MASK_SEQS, 0.3, "id").select("id", "labels")


@register("pad_batches")
def q_pad_batches(spark, sf):
    from ravel.operators.batches import pad_batches

    lab = _labels(spark, sf).withColumn("batch_id", F.floor(F.col("id") / 8).cast("long"))
    return pad_batches(lab, "batch_id", ["id"], pad_id=0).select("id", "input_ids", "labels", "attention_mask")


# ---- 2.2 projections --------------------------------------------------------


@register("map_source_columns")
def q_map_source_columns(spark, sf):
    r = T(spark, sf, "reasoning")
    return r.select("id", TX.py_strip("problem").alias("problem"), TX.py_strip("response").alias("response"),
                    F.lit("math").alias("data_type"), F.col("src").alias("source"), F.lit(True).alias("boxed_force"))


@register("first_if_list")
def q_first_if_list(spark, sf):
    conv = T(spark, sf, "conversations").select("conv_id", "turn", F.split("text", "\n").alias("lines"))
    return conv.select("conv_id", "turn", TX.first_if_list(conv.schema["lines"].dataType, "lines").alias("first"))


@register("split_think_answer")
def q_split_think_answer(spark, sf):
    t, a = RW.split_think_answer("content")
    return T(spark, sf, "completions").select("completion_id", t.alias("think"), a.alias("answer"))


@register("box_answer_signal")
def q_box_answer_signal(spark, sf):
    return T(spark, sf, "reasoning").select("id", RW.box_answer_signal("response", "So ").alias("answer"))


@register("strip_outer_tags")
def q_strip_outer_tags(spark, sf):
    c = T(spark, sf, "completions")
    return c.select("completion_id", TX.strip_outer_tags(F.substring_index("content", "</think>", 1)).alias("think"))


@register("strip_named_tags")
def q_strip_named_tags(spark, sf):
    c = T(spark, sf, "completions")
    return c.select("completion_id", TX.strip_named_tags("content", ["think", "answer"]).alias("content"))


@register("bucket_difficulty")
def q_bucket_difficulty(spark, sf):
    r = T(spark, sf, "reasoning")
    return r.select("id", RW.bucket_difficulty(RW.approx_token_count("think")).alias("difficulty"))


@register("think_length")
def q_think_length(spark, sf):
    return T(spark, sf, "reasoning").select("id", RW.think_length("think").alias("think_len"))


@register("build_messages")
def q_build_messages(spark, sf):
    r = T(spark, sf, "reasoning")
    return r.select("id", CH.build_messages("problem", F.col("think"), F.col("response")).alias("messages"))


@register("render_chat")
def q_render_chat(spark, sf):
    r = T(spark, sf, "reasoning")
    msgs = CH.build_messages("problem", F.col("think"), F.col("response"))
    return r.select("id", CH.render_chat(msgs).alias("text"))


@register("rl_examples")
def q_rl_examples(spark, sf):
    r = T(spark, sf, "reasoning")
    return r.select("id", CH.build_messages("problem").alias("prompt"), F.col("answer").alias("solution"))


@register("topic_prompts")
def q_topic_prompts(spark, sf):
    return T(spark, sf, "reasoning").select("id", CH.topic_prompts("problem").alias("messages"))


@register("fill_equivalence_prompt")
def q_fill_equivalence_prompt(spark, sf):
    p = T(spark, sf, "answer_pairs")
    filled = RW.fill_template(EQUIVALENCE_PROMPT, EQUIVALENCE_SLOTS, [F.col("instruction"), F.col("ans1"), F.col("ans2")])
    return p.select("id", filled.alias("prompt"))


@register("drop_columns")
def q_drop_columns(spark, sf):
    r = T(spark, sf, "reasoning").withColumn("think_len", RW.think_length("think"))
    return r.drop("think_len", "grade")


# ---- 2.3 filters ------------------------------------------------------------


@register("filter_nonempty_question")
def q_filter_nonempty_question(spark, sf):
    return FL.filter_nonempty_question(T(spark, sf, "reasoning"), "problem").select("id")


@register("filter_any_key_equals")
def q_filter_any_key_equals(spark, sf):
    return FL.filter_any_key_equals(T(spark, sf, "reasoning"), [("lang", "de"), ("src", "src3")]).select("id")


@register("filter_correct")
def q_filter_correct(spark, sf):
    return FL.filter_correct(T(spark, sf, "reasoning"), "grade").select("id")


@register("topic_filter")
def q_topic_filter(spark, sf):
    return FL.filter_topic(T(spark, sf, "reasoning"), "problem").select("id")


@register("classify_topic")
def q_classify_topic(spark, sf):
    from ravel.plans.topic import classify_topic

    r = T(spark, sf, "reasoning")
    return classify_topic(r, "problem", mode="hybrid", verdicts=T(spark, sf, "verdicts")).select("id", "is_topic")


@register("filter_has_boxed")
def q_filter_has_boxed(spark, sf):
    return FL.filter_has_boxed(T(spark, sf, "reasoning"), "response").select("id")


@register("filter_low_quality")
def q_filter_low_quality(spark, sf):
    return FL.filter_low_quality(T(spark, sf, "reasoning")).select("id")


@register("filter_step_by_step")
def q_filter_step_by_step(spark, sf):
    return FL.filter_step_by_step(T(spark, sf, "reasoning"), "response").select("id")


@register("filter_good_thinking")
def q_filter_good_thinking(spark, sf):
    return FL.filter_good_thinking(T(spark, sf, "reasoning"), "think", "response", 2000).select("id")


@register("filter_token_range")
def q_filter_token_range(spark, sf):
    r = T(spark, sf, "reasoning").withColumn("tok", RW.approx_token_count("think"))
    return FL.filter_token_range(r, "tok", 100, 800).select("id", "tok")


# ---- 2.4 joins / 2.10 set operations ----------------------------------------


def _samples(spark, sf):
    return T(spark, sf, "reasoning").select(F.col("id").alias("sample_id"), "problem", "answer", "lang")


def _outputs(spark, sf):
    return T(spark, sf, "completions").select(F.col("completion_id").alias("sample_id"), F.col("content").alias("output"),
                                              "token_generated")


@register("join_predictions")
def q_join_predictions(spark, sf):
    j = JN.join_predictions(_samples(spark, sf), _outputs(spark, sf), "sample_id")
    return j.select("sample_id", "answer", F.length("output").alias("output_len"))


@register("join_solutions")
def q_join_solutions(spark, sf):
    sol = T(spark, sf, "reasoning").groupBy("prompt_id").agg(F.min("answer").alias("solution"))
    c = T(spark, sf, "completions").select("completion_id", "prompt_id", "content")
    return JN.join_solutions(c, sol, "prompt_id").select("completion_id", "prompt_id", "solution")


def _held_out(rows: DataFrame) -> DataFrame:
    """Problems of the val and test splits of ``rows``."""
    labels = SP.split_labels(rows, "problem", "think", "id").filter("split <> 'train'")
    return rows.join(labels, "id").select("problem")


@register("antijoin_holdout")
def q_antijoin_holdout(spark, sf):
    r = T(spark, sf, "reasoning").select("id", "problem", "think")
    return SP.antijoin_holdout(r, _held_out(r), "problem", "problem").select("id")


@register("semijoin_holdout")
def q_semijoin_holdout(spark, sf):
    r = T(spark, sf, "reasoning").select("id", "problem", "think")
    return SP.semijoin_holdout(r, _held_out(r), "problem", "problem").select("id")


@register("leakage")
def q_leakage(spark, sf):
    """Problems of the train split that the held-out splits hold as well: none."""
    split = SP.split_train_val_test(T(spark, sf, "reasoning"), "problem", "think", "id").select("id", "problem", "split")
    path = scratch_path(spark, "leakage")
    split.write.parquet(path)
    back = spark.read.schema(split.schema).parquet(path)
    return SP.leakage(back.filter("split = 'train'"), back.filter("split <> 'train'")).select("id")


@register("join_verdicts")
def q_join_verdicts(spark, sf):
    r = T(spark, sf, "reasoning").select("id", "src")
    return JN.join_verdicts(r, T(spark, sf, "verdicts"), "id").select("id", "verdict")


@register("except_holdout")
def q_except_holdout(spark, sf):
    r = T(spark, sf, "reasoning").select("id", "prompt_id")
    held = T(spark, sf, "verdicts").select("id")
    return r.join(held, "id", "left_anti")


@register("union_sources")
def q_union_sources(spark, sf):
    from ravel.plans.curate import union_sources

    r = T(spark, sf, "reasoning")
    a = r.select(F.col("id").alias("row_id"), "problem", F.lit("reasoning").alias("source"))
    b = T(spark, sf, "completions").select(F.col("completion_id").alias("row_id"), "problem",
                                           F.lit("completions").alias("source"), F.col("solution").alias("answer"))
    return union_sources([a, b]).select("row_id", "source", "answer", F.length("problem").alias("problem_len"))


# ---- 2.5 aggregations -------------------------------------------------------


def _details(spark, sf):
    from ravel.plans.evaluate import evaluation_details

    return evaluation_details(_samples(spark, sf), _outputs(spark, sf), gold_last_line=True, carry=("lang",))


@register("eval_accuracy")
def q_eval_accuracy(spark, sf):
    return AG.eval_accuracy(_details(spark, sf), ["lang"])


@register("curation_counts")
def q_curation_counts(spark, sf):
    from ravel.plans.topic import topic_decisions

    return AG.curation_counts(topic_decisions(T(spark, sf, "reasoning"), "problem", "response", "id"))


@register("count_marker_words")
def q_count_marker_words(spark, sf):
    return AG.count_marker_words(T(spark, sf, "completions"), "content")


@register("verdict_counts")
def q_verdict_counts(spark, sf):
    return AG.verdict_counts(T(spark, sf, "verdicts"), "verdict_text")


@register("length_profile")
def q_length_profile(spark, sf):
    p = AG.length_profile(T(spark, sf, "reasoning"), RW.think_length("think"))
    return p.select("n", "min_len", "max_len", F.round("mean_len", R9).alias("mean_len"), "median_len",
                    F.round("std_len", 6).alias("std_len"))


@register("length_histogram")
def q_length_histogram(spark, sf):
    return AG.length_histogram(T(spark, sf, "reasoning"), RW.think_length("think"))


@register("length_quantile_curve")
def q_length_quantile_curve(spark, sf):
    return AG.length_quantile_curve(T(spark, sf, "reasoning"), RW.think_length("think"))


def _aligned_tokens(spark, sf):
    """Loss rows with the next position's label and weight (one-position shift)."""
    rows = written(T(spark, sf, "token_rows"), "token-rows")  # made of texts once, read as labels and for the losses
    lab = rows.select("id", TK.sft_labels("input_ids", 1000).alias("labels"))
    losses = table(spark, sf, "sequence_losses", token_rows=rows)
    return AG.align_losses(losses, lab, ["nll", "neg_logprob_sum"], "id", "labels", TK.token_weights("labels", 1001, 0.3))


@register("token_loss_profile")
def q_token_loss_profile(spark, sf):
    p = AG.token_loss_profile(_aligned_tokens(spark, sf), "nll", "label", 0.15)
    return p.select("n_tokens", "n_below", "n_at_or_above", "min_loss", "max_loss", F.round("mean_loss", R9).alias("mean_loss"))


@register("token_loss_histogram")
def q_token_loss_histogram(spark, sf):
    h = AG.token_loss_histogram(_aligned_tokens(spark, sf), "nll", "label")
    return h.select("bin", F.round("lo", R9).alias("lo"), F.round("hi", R9).alias("hi"), "n")


@register("weighted_token_loss")
def q_weighted_token_loss(spark, sf):
    t = AG.weighted_token_loss(_aligned_tokens(spark, sf), ["id"], epsilon=0.1, threshold=0.1, vocab=10)
    return t.select("id", "n_active", F.round("loss", R9).alias("loss"))


LENGTH_QUANTILES = [0.1, 0.5, 0.9]


@register("length_sketch")
def q_length_sketch(spark, sf):
    """Lengths by source as mergeable sketches: are the ranks of the quantiles read from their union within 2 %?"""
    r = T(spark, sf, "reasoning").select("src", RW.think_length("think").alias("len"))
    merged = AG.merged_sketch(AG.length_sketches(r, "len", ["src"]))
    read = AG.sketch_quantiles(merged, LENGTH_QUANTILES)
    asked = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(c).alias("value")) for q, c in zip(LENGTH_QUANTILES, read.columns, strict=True)]))
    told = F.broadcast(read.select(asked.alias("x")).select("x.*"))  # one row per quantile
    ranks = r.join(told, F.lit(True)).groupBy("quantile").agg(
        F.avg((F.col("len") < F.col("value")).cast("double")).alias("below"), F.avg((F.col("len") <= F.col("value")).cast("double")).alias("upto"))
    return ranks.select("quantile", ((F.col("below") <= F.col("quantile") + 0.02) & (F.col("upto") >= F.col("quantile") - 0.02)).alias("within"))


@register("distinct_problems")
def q_distinct_problems(spark, sf):
    return distinct_problems(T(spark, sf, "reasoning"), "problem")


@register("distinct_problem_sketch")
def q_distinct_problem_sketch(spark, sf):
    """Unique problems of every source and of all sources from the same sketches: are they within 5 % of the exact numbers?"""
    r = T(spark, sf, "reasoning").select("src", "problem")
    sketches = written(problem_sketches(r, ["src"]), "problem-sketches")
    estimates = estimated_problems(sketches, ["src"]).union(estimated_problems(sketches).select(F.lit("all").alias("src"), "n_unique"))
    exact = r.groupBy("src").agg(F.count_distinct(key_digest(TX.normalized_key("problem"))).alias("n")).union(
        distinct_problems(r).select(F.lit("all").alias("src"), F.col("n_unique").alias("n")))
    return estimates.join(exact, estimates["src"].eqNullSafe(exact["src"])).select(
        exact["src"], F.col("n").alias("n_unique"), (F.abs(F.col("n_unique") - F.col("n")) <= 0.05 * F.col("n")).alias("within"))


# ---- 2.6 windows / 2.7 ordering, sampling, splitting ------------------------


@register("dedup_keep_first")
def q_dedup_keep_first(spark, sf):
    r = T(spark, sf, "reasoning").withColumn("_k", TX.normalized_key("problem"))
    return dedup_keep_first(r, "_k", ["id"]).select("id")


@register("cap_per_group")
def q_cap_per_group(spark, sf):
    r = T(spark, sf, "reasoning")
    return SM.cap_per_group(r, "src", 10, [SM.shuffle_key(3407, "id"), F.col("id")]).select("id", "src")


@register("running_accuracy")
def q_running_accuracy(spark, sf):
    r = SL.running_accuracy(_details(spark, sf), ["lang"], "sample_id", "is_correct")
    return r.select("lang", "batch", "correct_so_far", "seen_so_far", F.round("accuracy_so_far", R9).alias("accuracy_so_far"))


@register("reward_length")
def q_reward_length(spark, sf):
    out = RWD.reward_length(T(spark, sf, "completions"), "content", "solution", "prompt_id", out="reward")
    return out.select("completion_id", F.round("reward", R9).alias("reward"))


QUERIES["length_reward"] = q_reward_length


@register("even_spaced_rank")
def q_even_spaced_rank(spark, sf):
    return SP.even_spaced_rank(T(spark, sf, "reasoning"), "problem", "think", "id")


@register("take_n")
def q_take_n(spark, sf):
    return SM.take_n(T(spark, sf, "reasoning"), 100, "id").select("id")


@register("seeded_shuffle")
def q_seeded_shuffle(spark, sf):
    r = SM.seeded_shuffle(T(spark, sf, "reasoning"), 3407, "id")
    return r.select("id", SM.shuffle_key(3407, "id").alias("shuffle_key"))


@register("sample_first_accepted")
def q_sample_first_accepted(spark, sf):
    r = FL.filter_step_by_step(T(spark, sf, "reasoning"), "response")
    return SM.sample_first_accepted(r, 50, 80, 3407, "id").select("id")


@register("sample_by_length")
def q_sample_by_length(spark, sf):
    r = T(spark, sf, "reasoning").withColumn("think_len", RW.think_length("think"))
    return SM.sample_by_length(r, "think_len", 50, 0.7, 3407, "id").select("id")


@register("sort_by_difficulty")
def q_sort_by_difficulty(spark, sf):
    r = T(spark, sf, "reasoning").withColumn("think_len", RW.think_length("think"))
    return sort_by_difficulty(r, "think_len", "id").select("id", "think_len")


@register("split_train_val_test")
def q_split_train_val_test(spark, sf):
    return SP.split_train_val_test(T(spark, sf, "reasoning"), "problem", "think", "id").select("id", "split")


@register("best_checkpoint")
def q_best_checkpoint(spark, sf):
    m = T(spark, sf, "metrics_log").withColumn("checkpoint", F.concat(F.lit("best_model_step_"), F.col("step").cast("string")))
    return SL.best_checkpoint(m, ["run_id"], "checkpoint", "accuracy").select("run_id", "checkpoint", "accuracy")


@register("best_step")
def q_best_step(spark, sf):
    m = T(spark, sf, "metrics_log")
    return SL.best_step(m, "run_id", "step", "accuracy", "avg_tokens", eval_steps=5).select("run_id", "step", "accuracy", "avg_tokens")


@register("topk_rewards")
def q_topk_rewards(spark, sf):
    return SL.topk_rewards(T(spark, sf, "metrics_log"), 3, "run_id", "step", "reward").select("run_id", "step", "reward")


# ---- 2.8 rewards ------------------------------------------------------------


def _reward(col_builder, graded: bool = False):
    def q(spark, sf):
        c = T(spark, sf, "completions")
        if graded:
            c = RWD.with_correct(c, "content", "solution")
        return c.select("completion_id", F.round(col_builder(), R9).alias("reward"))

    return q


QUERIES["reward_accuracy"] = _reward(lambda: RWD.reward_accuracy(F.col("_correct")), True)
QUERIES["reward_format"] = _reward(lambda: RWD.reward_format("content"))
QUERIES["reward_steps"] = _reward(lambda: RWD.reward_steps("content"))
QUERIES["reward_cosine_length"] = _reward(lambda: RWD.reward_cosine_length("content", F.col("_correct")), True)
QUERIES["reward_cosine_markers"] = _reward(lambda: RWD.reward_cosine_markers("content", F.col("_correct")), True)
QUERIES["reward_repetition"] = _reward(lambda: RWD.reward_repetition("content"))
QUERIES["reward_formula"] = _reward(lambda: RWD.reward_formula("content"))
QUERIES["flag_script"] = _reward(lambda: RWD.flag_script("content"))


@register("reward_total")
def q_reward_total(spark, sf):
    c = RWD.with_correct(T(spark, sf, "completions"), "content", "solution")
    regs = RWD.reward_registry(F.col("_correct"))
    return c.select("completion_id", F.round(RWD.reward_total(regs, {"format": 1.0, "cosine_markers": 2.0, "repetition": 0.1}), R9).alias("reward"))


# ---- 2.12 composite jobs, 2.1 sources/sinks, 2.10 streams --------------------
from ravel.params import SourceSpec  # noqa: E402
from ravel.plans import curate as CU  # noqa: E402
from ravel.plans import evaluate as EV  # noqa: E402
from ravel.plans import topic as TP  # noqa: E402
from ravel.sources import io as IO  # noqa: E402

REASONING_SPEC = SourceSpec(name="reasoning", question_col="problem", answer_col="response", think_col="think",
                            correct_col="grade", row_id_col="id", min_token=10, max_token=6000)
COMPLETION_SPEC = SourceSpec(name="completions", question_col="problem", answer_col="</think>", think_col="content",
                             row_id_col="completion_id", max_token=8000)
TEST_SPEC = SourceSpec(name="test", question_col="problem", answer_col="response", row_id_col="id", answer_signal="So ")


@register("curate_source")
def q_curate_source(spark, sf):
    return CU.curate_source(T(spark, sf, "reasoning"), REASONING_SPEC)


# A stand-in second question: none for English rows, and one that points to a figure for some others.
SECOND_QUESTION = ("CASE WHEN lang <> 'en' THEN concat('Aufgabe: ', problem, "
                   "CASE WHEN length(problem) % 7 = 0 THEN ' Figure 3' ELSE '' END) END")


@register("alternate_question")
def q_alternate_question(spark, sf):
    raw = T(spark, sf, "reasoning").withColumn("problem2", F.expr(SECOND_QUESTION))
    return CU.curate_source(raw, replace(REASONING_SPEC, question_alt_col="problem2", max_token=None)).select("row_id", "problem")


@register("build_corpus")
def q_build_corpus(spark, sf):
    return CU.build_corpus([(T(spark, sf, "reasoning"), REASONING_SPEC), (T(spark, sf, "completions"), COMPLETION_SPEC)])


@register("build_test_set")
def q_build_test_set(spark, sf):
    return CU.build_test_set(T(spark, sf, "reasoning"), TEST_SPEC)


@register("filter_topic")
def q_filter_topic(spark, sf):
    out = TP.filter_topic(T(spark, sf, "reasoning"), problem="problem", response="response", row_id="id",
                          mode="hybrid", verdicts=T(spark, sf, "verdicts"))
    return out.select("id")


@register("filter_topic_dataset")
def q_filter_topic_dataset(spark, sf):
    return TP.filter_topic_dataset(T(spark, sf, "reasoning"), row_id="id").select("id")


@register("split_corpus")
def q_split_corpus(spark, sf):
    corpus = CU.curate_source(T(spark, sf, "reasoning"), REASONING_SPEC)
    split = SP.split_train_val_test(corpus, "problem", "think", "row_id")
    path = scratch_path(spark, "split")
    split.write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path).select("row_id", "split")


@register("evaluate_runs")
def q_evaluate_runs(spark, sf):
    _, summary = EV.evaluate_runs(_samples(spark, sf), _outputs(spark, sf), ["lang"])
    return summary


@register("score_completions")
def q_score_completions(spark, sf):
    s = EV.score_completions(T(spark, sf, "completions"))
    return s.select("completion_id", *[F.round(c, R9).alias(c) for c in ("accuracy", "length", "total")])


@register("compare_answers")
def q_compare_answers(spark, sf):
    rows, _ = EV.compare_answers(T(spark, sf, "answer_pairs"), T(spark, sf, "verdicts"))
    return rows.select("id", "equivalent")


@register("prepare_sft")
def q_prepare_sft(spark, sf):
    return EV.prepare_sft(T(spark, sf, "length_rows"), 1000, [3, 4], 2, MASK_SEQS).select("id", "labels")


@register("read_jsonl")
def q_read_jsonl(spark, sf):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    path = scratch_path(spark, "jsonl")
    T(spark, sf, "reasoning").select("id", "problem", "answer", "grade").write.json(path)
    schema = StructType([StructField("id", LongType()), StructField("problem", StringType()),
                         StructField("answer", StringType()), StructField("grade", StringType())])
    return IO.read_jsonl(spark, path, schema)


@register("read_text_blob")
def q_read_text_blob(spark, sf):
    """Documents written as text files and read back as one string per file: characters over all files."""
    path = scratch_path(spark, "blobs")
    IO.write_text_blobs(T(spark, sf, "documents"), path, "text")
    blobs = IO.read_text_blob(spark, path)
    return blobs.agg(F.sum(F.length("value")).alias("n_chars"))


@register("read_json_records")
def q_read_json_records(spark, sf):
    """Turns as JSON arrays of bounded size, a folder for each thousand conversation ids, read back."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    path = scratch_path(spark, "json-arrays")
    turns = T(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    IO.write_json_arrays(turns, path, F.floor(F.col("conv_id") / 1000))
    schema = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()), StructField("role", StringType()), StructField("text", StringType())])
    return IO.read_json_records(spark, f"{path}/part=*/block=*", schema)


@register("read_dataset")
def q_read_dataset(spark, sf):
    path = scratch_path(spark, "dataset")
    r = T(spark, sf, "reasoning").select("id", "problem", F.col("lang").alias("subset"), F.lit("train").alias("split"))
    r.write.partitionBy("subset", "split").parquet(path)
    return IO.read_dataset(spark, path, subset="en", split="train").select("id", "problem")


@register("stream_dataset")
def q_stream_dataset(spark, sf):
    """:func:`read_dataset` as a stream, a few files at a time, appended to a table."""
    from ravel.streaming.trackers import append_stream

    path = scratch_path(spark, "dataset")
    r = T(spark, sf, "reasoning").select("id", "problem", F.col("lang").alias("subset"), F.lit("train").alias("split"))
    IO.write_dataset(r, path, ["subset", "split"], "problem")
    return append_stream(IO.stream_dataset(spark, path, r.schema, subset="en", split="train", files_per_trigger=2), "dataset").select("id", "problem")


@register("write_records")
def q_write_records(spark, sf):
    path = scratch_path(spark, "records")
    corpus = CU.curate_source(T(spark, sf, "reasoning"), replace(REASONING_SPEC, max_token=None))
    IO.write_records(corpus, path, "json")
    return spark.read.schema(corpus.schema).json(path)


@register("write_with_rejects")
def q_write_with_rejects(spark, sf):
    path = scratch_path(spark, "rejects")
    dec = TP.topic_decisions(T(spark, sf, "reasoning"), "problem", "response", "id").select("id", "decision")
    IO.write_with_rejects(dec, path)
    return spark.read.parquet(path).filter(F.col("decision").isin("topic", "other")).select("id", "decision")


@register("write_jsonl_with_summary")
def q_write_jsonl_with_summary(spark, sf):
    path = scratch_path(spark, "equivalence")
    rows, counts = EV.compare_answers(T(spark, sf, "answer_pairs"), T(spark, sf, "verdicts"))
    IO.write_jsonl_with_summary(rows.select("id", "instruction", "ans1", "ans2", "equivalent"), counts, path)
    return spark.read.schema("true long, false long").json(f"{path}/summary")


@register("write_eval_details")
def q_write_eval_details(spark, sf):
    path = scratch_path(spark, "details")
    d = EV.evaluation_details(_samples(spark, sf), _outputs(spark, sf), gold_last_line=True)
    IO.write_eval_details(d, path)
    return IO.read_eval_details(spark, path, d.schema).select("sample_id", "question", "ground_truth", "prediction",
                                                             "raw_output", "token_generated", "is_correct")


@register("append_result")
def q_append_result(spark, sf):
    path = scratch_path(spark, "results")
    summary = AG.eval_accuracy(_details(spark, sf), ["lang"])
    for lang_model in ("fixture-a", "fixture-b"):
        IO.append_result(summary.withColumnRenamed("lang", "_l"), path, lang_model, "reasoning")
    back = spark.read.options(header="true").csv(path)
    dated = F.col("timestamp").rlike(r"\A\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\z").alias("dated")
    return back.groupBy("model", "dataset", "accuracy", "avg_tokens_generated", dated).agg(F.count(F.lit(1)).alias("n"))


def _replay(spark, sf, name: str, order: str, key: str | None = None, parts: int = 4):
    from ravel.streaming.trackers import write_in_arrival_order

    src = T(spark, sf, name)
    path = scratch_path(spark, f"replay-{name}")
    write_in_arrival_order(src, path, order, parts, key)
    return path, src.schema


@register("stream_topk")
def q_stream_topk(spark, sf):
    from ravel.streaming.trackers import stream_topk

    path, schema = _replay(spark, sf, "metrics_log", "step", "run_id")
    return stream_topk(spark, path, schema, 3)


@register("stream_best_step")
def q_stream_best_step(spark, sf):
    from ravel.streaming.trackers import stream_best_step

    path, schema = _replay(spark, sf, "metrics_log", "step", "run_id")
    return stream_best_step(spark, path, schema, 5)


@register("stream_curate")
def q_stream_curate(spark, sf):
    from ravel.streaming.trackers import stream_curate

    path, schema = _replay(spark, sf, "reasoning", "id")
    return stream_curate(spark, path, schema, REASONING_SPEC).select(F.md5(TX.normalized_key("problem")).alias("key_md5"))


@register("stream_dedup")
def q_stream_dedup(spark, sf):
    from ravel.streaming.trackers import stream_dedup

    path, schema = _replay(spark, sf, "reasoning", "id")
    return stream_dedup(spark, path, schema).select(F.md5(TX.normalized_key("problem")).alias("key_md5"))
