"""Best checkpoint / best step / top-k rewards / running accuracy.

All rank filters are ``row_number() <= k`` so Spark plans a partial
per-task limit before the shuffle; a run holding a third of the log sends
at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravel.operators.joins import join_per_key
from ravel.operators.ranking import global_rank
from ravel.params import EVAL_BATCH_SIZE
from ravel.session import written

RANGE = 1000  # batches per range of a running sum


def best_checkpoint(df: DataFrame, group: list[str], name: str = "checkpoint", accuracy: str = "accuracy") -> DataFrame:
    """Highest accuracy per group; ties go to the first name in sorted order."""
    w = Window.partitionBy(*group).orderBy(F.col(accuracy).desc(), F.col(name).asc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def best_step(df: DataFrame, run: str = "run_id", step: str = "step", accuracy: str = "accuracy",
              tokens: str = "avg_tokens", eval_steps: int | None = None) -> DataFrame:
    """Best evaluated step per run: highest accuracy, then lowest mean tokens, then earliest.

    Only steps divisible by ``eval_steps`` (and not 0) are evaluated when it is given.
    """
    rows = df
    if eval_steps:
        rows = rows.filter((F.col(step) % eval_steps == 0) & (F.col(step) != 0))
    w = Window.partitionBy(run).orderBy(F.col(accuracy).desc(), F.col(tokens).asc(), F.col(step).asc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def topk_rewards(df: DataFrame, k: int, run: str = "run_id", step: str = "step", reward: str = "reward") -> DataFrame:
    """Rows the online top-k keeper holds at the end of each run's log.

    The keeper admits while not full, then only rewards strictly above its
    minimum, evicting the oldest among the minimum.  Closed form with v the
    k-th largest reward: all rows above v are kept; of the rows >= v taken
    in step order, the first k are candidates, and of the candidates equal
    to v the last (k - #above) are kept.  Runs with fewer than k rows keep
    every row.
    """
    logged = df.filter(F.col(reward).isNotNull())
    w_desc = Window.partitionBy(run).orderBy(F.col(reward).desc(), F.col(step).asc())
    top = written(logged.withColumn("_rd", F.row_number().over(w_desc)).filter(F.col("_rd") <= k).drop("_rd"), "topk")  # k rows a run at most
    rewards = F.array_sort(F.collect_list(reward))
    held = top.groupBy(run).agg(rewards.alias("_top")).select(
        run, F.get("_top", 0).alias("_v"), F.size("_top").alias("_ntop"), F.size(F.filter("_top", lambda x: x > F.array_min("_top"))).alias("_m"))
    above = top.join(held, run).filter((F.col("_ntop") < k) | (F.col(reward) > F.col("_v"))).select(*df.columns)
    # the rows of full runs that reach v, in step order: a hot run is dealt over salts before the per-task limit of the rank
    full = held.filter(F.col("_ntop") == k).join(logged.groupBy(run).agg(F.count(F.lit(1)).alias("_rows")), run)
    reach = join_per_key(logged, full, run, "_rows", spread=[step, reward]).filter(F.col(reward) >= F.col("_v"))
    w_step = Window.partitionBy(run).orderBy(F.col(step).asc())
    ties = reach.withColumn("_rs", F.row_number().over(w_step)).filter((F.col("_rs") <= k) & (F.col(reward) == F.col("_v")))
    w_late = Window.partitionBy(run).orderBy(F.col(step).desc())
    kept_ties = ties.withColumn("_rl", F.row_number().over(w_late)).filter(F.col("_rl") <= F.lit(k) - F.col("_m"))
    return above.unionByName(kept_ties.select(*df.columns))


def running_accuracy(details: DataFrame, group: list[str], order: str = "sample_id", correct: str = "is_correct",
                     batch_size: int = EVAL_BATCH_SIZE) -> DataFrame:
    """Cumulative accuracy (%) after each batch of ``batch_size`` samples per group.

    Positions come from a range-partitioned global rank minus the group's
    first rank, and running sums go by ranges of batches, so no task holds a whole group.
    """
    ranked = global_rank(details.select(*group, order, correct), [*group, order], "_g")
    first = ranked.groupBy(*group).agg(F.min("_g").alias("_g0"), F.count(F.lit(1)).alias("_rows"))
    per = join_per_key(ranked, first, group, "_rows", spread="_g").withColumn("batch", F.floor((F.col("_g") - F.col("_g0")) / batch_size).cast("long"))
    batches = per.groupBy(*group, "batch").agg(
        F.sum(F.col(correct).cast("long")).alias("_c"), F.count(F.lit(1)).alias("_n")
    )
    # running sums in two steps: ranges of RANGE batches, then the batches of each range on their own
    ranged = batches.withColumn("_r", F.floor(F.col("batch") / RANGE))
    earlier = Window.partitionBy(*group).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*group, "_r").agg(F.sum("_c").alias("_rc"), F.sum("_n").alias("_rn"))
    before = sums.select(*group, "_r", F.coalesce(F.sum("_rc").over(earlier), F.lit(0)).alias("_bc"),
                         F.coalesce(F.sum("_rn").over(earlier), F.lit(0)).alias("_bn"))
    w = Window.partitionBy(*group, "_r").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select(*group, "batch", "_r", F.sum("_c").over(w).alias("_ic"), F.sum("_n").over(w).alias("_in"))
    done = inside.join(before, [*group, "_r"]).select(
        *group, "batch", (F.col("_bc") + F.col("_ic")).alias("correct_so_far"), (F.col("_bn") + F.col("_in")).alias("seen_so_far"))
    return done.withColumn("accuracy_so_far", F.col("correct_so_far") / F.col("seen_so_far") * 100.0)
