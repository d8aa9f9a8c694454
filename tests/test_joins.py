"""Join-backs whose hot keys are dealt over salts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from ravel.operators import rewards as RWD
from ravel.operators import split as SP
from ravel.operators.joins import join_per_key

OFF = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}


@pytest.fixture
def no_broadcast(spark):
    before = {k: spark.conf.get(k) for k in OFF}
    for k, v in OFF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def evenly(out):
    """No task of the join has more than three times the rows of the median one."""
    n = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert n[-1] <= 3 * n[len(n) // 2], n


def hot_rows(spark, n=30_000):
    """A third of all rows have key 7."""
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000 + 100).alias("k"))


def test_a_hot_key_is_dealt_out(spark, no_broadcast):
    rows = hot_rows(spark)
    per_key = rows.groupBy("k").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    out = join_per_key(rows, per_key, "k", "n", spread="id")
    evenly(out)
    want = {r.k: r.top for r in per_key.collect()}
    got = out.collect()
    assert out.columns == ["k", "id", "top"] and len(got) == 30_000 and len({r.id for r in got}) == 30_000
    assert all(r.top == want[r.k] for r in got)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_kinds_of_join(spark, how):
    rows = spark.createDataFrame([(i, None if i % 10 == 9 else i % 4) for i in range(200)], "id long, k long")
    per_key = spark.createDataFrame([(0, "zero", 45), (1, "one", 40), (77, "none", 1)], "k long, name string, n long")
    out = join_per_key(rows, per_key, "k", "n", how, spread="id")
    names = {0: "zero", 1: "one"}
    kept = [r for r in rows.collect() if {"left": True, "left_anti": r.k not in names}.get(how, r.k in names)]
    if how in ("inner", "left"):
        assert Counter((r.id, r.k, r.name) for r in out.collect()) == Counter((r.id, r.k, names.get(r.k)) for r in kept)
    else:
        assert Counter((r.id, r.k) for r in out.collect()) == Counter((r.id, r.k) for r in kept)


def test_repeated_rows_and_empty_sides(spark):
    rows = spark.createDataFrame([(1,)] * 500 + [(2,)], "k long")
    per_key = rows.groupBy("k").agg(F.count("*").alias("n"), F.lit("x").alias("v"))
    assert Counter(r.k for r in join_per_key(rows, per_key, "k", "n").collect()) == {1: 500, 2: 1}
    assert join_per_key(rows.limit(0), per_key, "k", "n").count() == 0
    assert join_per_key(rows, per_key.limit(0), "k", "n").count() == 0
    assert join_per_key(rows, per_key.limit(0), "k", "n", "left").count() == 501


def test_length_reward_of_a_hot_group(spark, no_broadcast):
    rows = hot_rows(spark, 6000).select(F.col("id").alias("completion_id"), F.col("k").alias("prompt_id"), F.expr("repeat('x', cast(id % 50 as int))").alias("content"), (F.col("id") % 2 == 0).alias("_correct"))
    out = RWD.reward_length(rows)
    evenly(out)
    size = {}
    for r in rows.collect():
        size.setdefault(r.prompt_id, []).append(len(r.content))
    for r in out.collect():
        lo, hi = min(size[r.prompt_id]), max(size[r.prompt_id])
        lam = 0.0 if lo == hi else 0.5 - (len(r.content) - lo) / (hi - lo)
        assert r.reward_length == pytest.approx(lam if r._correct or lo == hi else min(0.0, lam))


def test_hold_outs_with_a_hot_problem(spark, no_broadcast):
    rows = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, " The SAME problem").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("problem"))
    rows = rows.union(spark.createDataFrame([(-1, None)], "id long, problem string"))
    held = spark.createDataFrame([("the same Problem ",), ("p1",), ("other",), (None,)], "text string")
    inside, outside = SP.semijoin_holdout(rows, held), SP.antijoin_holdout(rows, held)
    evenly(inside)
    assert {r.id for r in inside.collect()} == {i for i in range(9000) if i % 3 == 0 or i == 1}
    assert {r.id for r in outside.collect()} == {i for i in range(9000) if i % 3 and i != 1} | {-1}
    assert SP.leakage(rows, held.withColumnRenamed("text", "problem")).count() == 3001
