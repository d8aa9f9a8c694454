"""Alignment of per-sequence losses with the labels of the next position, and histograms of many values."""

import numpy as np
from pyspark.sql import functions as F

from ravel.operators import aggregates as AG


def test_histogram_bins_are_computed_step_by_step(spark):
    rng = np.random.default_rng(3)
    values = [*rng.normal(0, 1, 500).tolist(), *np.linspace(-4, 4, 41).tolist()]
    df = spark.createDataFrame([(v,) for v in [*values, None, None]], "x double")
    found = AG.histogram(df, "x", 40)
    n, edges = np.histogram(values, 40)
    rows = sorted(found.collect())
    assert [r.n for r in rows] == n.tolist() and np.allclose([r.lo for r in rows], edges[:-1])
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("floor(") == 1  # nested, the steps hold it dozens of times


def test_valid_losses_are_read_twice_but_aligned_once(spark):
    df = spark.createDataFrame([(0.5, 1), (1.5, 2), (9.0, -100)], "nll double, label int")
    found = AG.token_loss_histogram(df, bins=2)
    assert [(r.bin, r.lo, r.hi, r.n) for r in sorted(found.collect())] == [(0, 0.5, 1.0, 1), (1, 1.0, 1.5, 1)]
    assert "-100" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_losses_take_the_next_positions_label(spark):
    losses = spark.createDataFrame([(1, [0.1, 0.2, 0.3]), (2, [0.4]), (3, [0.5, 0.6]), (None, [0.7]), (4, None), (5, [])], "id long, nll array<double>")
    labelled = spark.createDataFrame([(1, [-100, 7, 8, 9, 10]), (2, [-100]), (None, [5, 5]), (4, [1, 2]), (5, [1, 2])], "id long, labels array<int>")
    found = AG.align_losses(losses, labelled, ["nll"], weights=F.transform("labels", lambda x: x / 2))
    got = sorted([tuple(r) for r in found.collect()], key=str)
    want = [(1, 0, 0.1, 7, 3.5), (1, 1, 0.2, 8, 4.0), (1, 2, 0.3, 9, 4.5), (2, 0, 0.4, -100, None), (3, 0, 0.5, -100, None), (3, 1, 0.6, -100, None),
            (None, 0, 0.7, -100, None)]
    assert found.columns == ["id", "pos", "nll", "label", "weight"] and got == sorted(want, key=str)
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert joined.index("Generate") < joined.index("Join")  # sequences are joined, not their tokens


def test_sequence_losses_are_the_token_losses(spark):
    from ravel.sources.fixtures import table

    rows = spark.createDataFrame([(5, [1, 2, 1000, 7]), (None, [1]), (6, []), (7, None)], "id long, input_ids array<int>")
    flat = table(spark, "", "token_losses", token_rows=rows).select("id", "pos", "nll", "neg_logprob_sum")
    whole = table(spark, "", "sequence_losses", token_rows=rows).select("id", F.posexplode(F.arrays_zip("nll", "neg_logprob_sum"))).select("id", "pos", "col.*")
    assert sorted(map(str, flat.collect())) == sorted(map(str, whole.collect())) and flat.count() == 5
