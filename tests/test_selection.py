"""Top-k by worked examples; best step; split properties; masks by worked examples."""

import random
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ravel.operators import selection as SL
from ravel.operators import split as SP
from ravel.sources.fixtures import table


@pytest.mark.parametrize("rewards,kept", [
    ([], []), ([5], [0]), ([1, 1], [0, 1]), ([1, 1, 1], [0, 1, 2]),
    ([1, 1, 1, 1], [0, 1, 2]),  # an equal reward does not get in
    ([1, 1, 1, 2], [1, 2, 3]),  # the oldest of the smallest goes
    ([3, 1, 1, 2], [0, 2, 3]), ([3, 1, 2, 1, 1], [0, 1, 2]), ([1, 2, 3, 4, 5], [2, 3, 4]), ([5, 4, 3, 2, 1], [0, 1, 2]),
    ([2, 2, 2, 3, 2, 3], [2, 3, 5]),  # the late 2 at step 4 never got in
    ([1, 2, 2, 2], [1, 2, 3]), ([1, 2, 2, 2, 2], [1, 2, 3]), ([2, 1, 1, 3, 3, 3], [3, 4, 5]), ([None, 1, None, 2], [1, 3]),
])
def test_topk(spark, rewards, kept):
    rows = [(run, i, None if r is None else float(r)) for run in (1, 2) for i, r in enumerate(rewards)]
    df = spark.createDataFrame(rows, "run_id long, step long, reward double")
    got = sorted((r.run_id, r.step, r.reward) for r in SL.topk_rewards(df, 3).collect())
    assert got == [(run, i, float(rewards[i])) for run in (1, 2) for i in kept]


def test_topk_of_a_hot_run(spark):
    rows = [(1, i, float(i % 7)) for i in range(6000)] + [(2 + i % 300, i, 1.0) for i in range(12_000)]
    df = spark.createDataFrame(rows, "run_id long, step long, reward double")
    got = sorted((r.run_id, r.step) for r in SL.topk_rewards(df, 3).collect())
    assert [s for r, s in got if r == 1] == [6, 13, 20]
    assert all([s for r, s in got if r == 2 + k] == [k, k + 300, k + 600] for k in range(300))


def test_best_step_ties(spark):
    rows = [(1, 5, 0.5, 100.0), (1, 10, 0.5, 50.0), (1, 15, 0.5, 50.0), (1, 20, 0.4, 10.0), (1, 3, 0.9, 1.0)]
    df = spark.createDataFrame(rows, "run_id long, step long, accuracy double, avg_tokens double")
    best = SL.best_step(df, eval_steps=5).collect()
    assert [(b.step, b.accuracy) for b in best] == [(10, 0.5)]


def test_split_properties(spark):
    r = table(spark, SF_SMALL, "reasoning")
    out = SP.split_train_val_test(r, "problem", "think", "id").cache()
    n_unique = r.select(F.lower(F.trim("problem"))).distinct().count()
    counts = {row.split: row["count"] for row in out.groupBy("split").count().collect()}
    k, n_val = SP.split_sizes(sum(counts.values()))
    assert counts.get("val", 0) == n_val and counts.get("test", 0) == k - n_val
    assert out.select("id").distinct().count() == out.count()
    assert sum(counts.values()) <= n_unique + 1


def test_step_spans_and_masks(spark):
    from ravel.functions import tokens as TK

    # prefix 3 4, numbers up to the next 2: spans at 2 (length 2) and 7 (length 1); the prefix at 9 is never closed
    ids = [3, 4, 8, 9, 2, 3, 4, 7, 2, 3, 4, 5]
    df = spark.createDataFrame([(1, ids, ids)], "id long, ids array<int>, labels array<int>")
    spans = df.select(TK.step_number_spans("ids", [3, 4], 2).alias("s")).first().s
    assert [(x.s, x.l) for x in spans] == [(2, 2), (7, 1)]
    out = TK.mask_step_numbers(df, "ids", "labels", [3, 4], 2, "id").first().labels
    first = [3, 4, -100, -100, 2, 3, 4, 7, 2, 3, 4, 5]
    second = [3, 4, 8, 9, 2, 3, 4, -100, 2, 3, 4, 5]
    assert out in (first, second)  # one step chosen at random is kept


def test_word_spans_and_masks(spark):
    from ravel.functions import tokens as TK

    # the first listed sequence wins at a position; a taken token starts no other match
    ids = [5, 6, 5, 5, 6, 7, 9]
    df = spark.createDataFrame([(1, ids, ids)], "id long, ids array<int>, labels array<int>")
    spans = df.select(TK.word_spans("ids", [[5, 6], [6, 7], [5], [9]]).alias("s")).first().s
    assert [(x.s, x.l) for x in spans] == [(0, 2), (2, 1), (3, 2), (6, 1)]
    out = TK.mask_marker_words(df, "ids", "labels", [[5, 6], [6, 7], [5], [9]], 1.0, "id").first().labels
    assert out == [-100, -100, -100, -100, -100, 7, -100]
    none = TK.mask_marker_words(df, "ids", "labels", [[5, 6]], 0.3, "id").first().labels
    assert none == ids


def test_many_sequences_and_long_rows(spark):
    from ravel.functions import tokens as TK

    rng = random.Random(5)
    ids = [rng.randrange(3000) for _ in range(30_000)]
    seqs = [[1000 + i, 2000 + i] for i in range(150)] + [[i] for i in range(150)] + [[], [7], [40, 41, 42]]
    for at in range(0, 29_000, 100):
        ids[at : at + 2] = [1000 + at % 150, 2000 + at % 150]
    df = spark.createDataFrame([(ids,)] * 8, "ids array<int>").repartition(8)
    began = time.time()
    spans = df.select(TK.word_spans("ids", seqs).alias("s")).collect()
    assert time.time() - began < 60
    known, want, at = {tuple(q): None for q in seqs if q}, [], 0
    while at < len(ids):
        size = next((len(q) for q in known if tuple(ids[at : at + len(q)]) == q), 0)
        want += [(at, size)] * (size > 0)
        at += size or 1
    assert all([(x.s, x.l) for x in r.s] == want for r in spans)
    assert [x.s for x in spark.range(1).select(TK.word_spans(F.array(F.lit(1)), []).alias("s")).collect()] == [[]]


def test_one_fold_per_mask_plan(spark):
    from ravel.plans.evaluate import prepare_sft

    t = table(spark, SF_SMALL, "token_rows")
    plan = prepare_sft(t, 1000, [3, 4], 2, [[4], [3, 4]])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2  # one for the steps, one for the words


def test_hot_problem(spark):
    from ravel.plans.topic import topic_decisions

    rows = [(i, "the limit" if i % 2 else f"sum {i}", "\\boxed{1}", "t" * (i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, problem string, response string, think string")
    n = {r.decision: r["count"] for r in topic_decisions(df).groupBy("decision").count().collect()}
    assert n == {"duplicate": 199, "topic": 1, "other": 200}
    assert SP.split_train_val_test(df).count() == 201


def test_take_first_any_size(spark):
    from ravel.operators.ranking import take_first

    df = spark.range(50).select((49 - F.col("id")).alias("id"), F.lit("text").alias("t"))
    for n in (0, 1, 7, 50, 80):
        assert sorted(r.id for r in take_first(df, [F.col("id")], n).collect()) == list(range(min(n, 50)))


def test_alternate_questions(spark):
    from ravel.plans.curate import alternate_questions

    rng = random.Random(9)
    rows = [(i, rng.random() < 0.6, rng.random() < 0.6) for i in range(300)]
    want, accepted = [], 0
    for i, e, v in rows:
        odd = accepted % 2 == 1
        if v if odd else e:
            want.append((i, odd))
            accepted += 1
    df = spark.createDataFrame(rows, "id long, e boolean, v boolean").filter("e or v")
    flags = df.select("id", F.col("e").cast("int").alias("_e"), F.col("v").cast("int").alias("_v"))
    for bucket in (7, 1000):
        got = alternate_questions(flags, "id", [F.col("id")], bucket).collect()
        assert sorted((r.id, r.alternate) for r in got) == want
