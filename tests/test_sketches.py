"""Exact positions over ranges, and sketches that are merged, against plain sorting and counting."""

import math
import random
import statistics

from pyspark.sql import functions as F

from ravel.operators import aggregates as AG
from ravel.operators.dedup import estimated_problems, problem_sketches
from ravel.operators.ranking import running_total


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(v, rng.randrange(1, 50)) for v in range(2000)]
    rng.shuffle(rows)
    got = {r.v: (r.start, r.end) for r in running_total(spark.createDataFrame(rows, "v long, n long"), ["v"], "n").collect()}
    at = 0
    for v, n in sorted(rows):
        assert got[v] == (at, at + n)
        at += n
    assert running_total(spark.createDataFrame([], "v long, n long"), ["v"], "n").count() == 0


def test_length_profile_and_curve(spark):
    rng = random.Random(2)
    for n in (1, 2, 999, 1000):
        lengths = [int(rng.expovariate(0.001)) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in lengths], "len long")
        p = AG.length_profile(df, "len").first()
        assert (p.n, p.min_len, p.max_len, p.median_len) == (n, min(lengths), max(lengths), statistics.median(lengths))
        assert math.isclose(p.std_len, statistics.pstdev(lengths), abs_tol=1e-9)
        curve = [0] * n
        for r in AG.length_quantile_curve(df, "len").collect():
            curve[r.first_position : r.last_position + 1] = [r.length] * r.n
        assert curve == sorted(lengths)
    empty = spark.createDataFrame([], "len long")
    assert AG.length_profile(empty, "len").first().n == 0 and AG.length_quantile_curve(empty, "len").count() == 0


def test_no_window_over_all_lengths(spark):
    plan = AG.length_quantile_curve(spark.range(1000).select((F.col("id") % 97).alias("len")), "len")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_pid" in w or "_p#" in w for w in windows)  # within a range, or over one row per range


def test_length_sketches_merge(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 5}", int(rng.lognormvariate(6, 1))) for i in range(20_000)]
    df = spark.createDataFrame(rows, "src string, len long")
    sketches = AG.length_sketches(df, "len", ["src"])
    asked = [0.05, 0.5, 0.95]
    whole = AG.sketch_quantiles(AG.merged_sketch(sketches), asked)
    assert whole.columns == ["q_5", "q_50", "q_95"]
    every = sorted(x for _, x in rows)
    for q, x in zip(asked, whole.first()):
        below, upto = sum(y < x for y in every) / len(every), sum(y <= x for y in every) / len(every)
        assert below - 0.02 <= q <= upto + 0.02
    per = AG.sketch_quantiles(AG.merged_sketch(sketches, ["src"]), [0.5]).collect()
    for r in per:
        mine = sorted(x for s, x in rows if s == r.src)
        assert mine[int(len(mine) * 0.48)] <= r.q_50 <= mine[int(len(mine) * 0.52)]


def test_distinct_sketches_unite(spark):
    rows = [(f"s{i % 3}", f" Problem {i % 7000 if i % 3 else i % 50} ") for i in range(30_000)] + [("s0", None)]
    df = spark.createDataFrame(rows, "src string, problem string")
    sketches = problem_sketches(df, ["src"])
    exact = {}
    for s, p in rows:
        exact.setdefault(s, set()).update([p.strip().lower()] if p else [])
    for r in estimated_problems(sketches, ["src"]).collect():
        assert abs(r.n_unique - len(exact[r.src])) <= 0.05 * len(exact[r.src])
    all_of = set().union(*exact.values())
    assert abs(estimated_problems(sketches).first().n_unique - len(all_of)) <= 0.05 * len(all_of)
