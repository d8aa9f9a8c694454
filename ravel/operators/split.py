"""Leak-free train / val / test split in difficulty order.

1. Rows are ordered by think length (ties by row id) and the first row of
   each normalised problem is kept.
2. With U unique rows, K = int(U * (v + t)) rows sit at positions
   int(i * U / K) of that order; of these, the rows at positions
   int(j * K / n_val) (n_val = int(K * (v / (v + t)))) are val, the others
   test.  All arithmetic is IEEE double, as in the original.
3. Every other unique row is train.  A problem is in exactly one set.

Selection needs no join: a row with rank r is picked when some i < K has
int(i * step) == r, and the only candidates are i = floor(r / step) and its
neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravel.functions.rewrite import think_length
from ravel.functions.text import normalized_key
from ravel.operators.joins import join_per_key
from ravel.operators.ranking import global_rank
from ravel.params import TEST_RATIO, VAL_RATIO


def _on_grid(pos: Column, count: Column, step: Column) -> tuple[Column, Column]:
    """(is pos = int(i*step) for some 0 <= i < count, that i)."""
    base = F.floor(pos.cast("double") / step)
    hit = F.lit(False)
    which = F.lit(None).cast("long")
    for d in (1, 0, -1):
        i = base + d
        ok = (i >= 0) & (i < count) & (F.floor(i.cast("double") * step) == pos)
        hit = hit | F.coalesce(ok, F.lit(False))
        which = F.when(ok, i.cast("long")).otherwise(which)
    return hit, which


def split_sizes(n_unique: int, val_ratio: float = VAL_RATIO, test_ratio: float = TEST_RATIO) -> tuple[int, int]:
    both = val_ratio + test_ratio
    k = int(n_unique * both)
    n_val = int(k * (val_ratio / both)) if both > 0 else 0
    return k, n_val


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def unique_in_difficulty_order(df: DataFrame, problem: str = "problem", think: str = "think", row_id: str = "id") -> DataFrame:
    """``(row_id, think_len, rank, n_unique)`` of the first row of each normalised problem in (think length, row id) order.

    Only a digest of the problem, the length and the id are shuffled.  The first
    row of a problem is a minimum, which each task takes in part before the
    shuffle, so a problem with very many copies is no hot key.
    """
    slim = df.select(F.sha2(normalized_key(problem), 256).alias("_d"), F.struct(think_length(think).alias("l"), F.col(row_id).alias("i")).alias("_o"))
    first = slim.groupBy("_d").agg(F.min("_o").alias("_o")).select(F.col("_o.l").alias("think_len"), F.col("_o.i").alias(row_id))
    return global_rank(first, ["think_len", row_id], "rank", total_col="n_unique")


def _with_grid(ranked: DataFrame, val_ratio: float, test_ratio: float) -> DataFrame:
    both = val_ratio + test_ratio
    k = F.floor(F.col("n_unique") * F.lit(both))
    sized = ranked.withColumn("_k", k).withColumn("_nv", F.floor(F.col("_k") * F.lit(val_ratio / both if both > 0 else 0.0)))
    picked, i = _on_grid(F.col("rank"), F.col("_k"), _ratio(F.col("n_unique"), F.col("_k")))
    return sized.withColumn("_picked", picked).withColumn("grid_index", i)


def split_labels(df: DataFrame, problem: str = "problem", think: str = "think", row_id: str = "id",
                 val_ratio: float = VAL_RATIO, test_ratio: float = TEST_RATIO) -> DataFrame:
    """``(row_id, split)`` of the unique rows."""
    grid = _with_grid(unique_in_difficulty_order(df, problem, think, row_id), val_ratio, test_ratio)
    is_val, _ = _on_grid(F.col("grid_index"), F.col("_nv"), _ratio(F.col("_k"), F.col("_nv")))
    label = F.when(~F.col("_picked"), "train").when(is_val, "val").otherwise("test")
    return grid.select(row_id, label.alias("split"))


def split_train_val_test(df: DataFrame, problem: str = "problem", think: str = "think", row_id: str = "id",
                         val_ratio: float = VAL_RATIO, test_ratio: float = TEST_RATIO) -> DataFrame:
    """Unique rows with a ``split`` column in {train, val, test}; whole rows meet their label by row id."""
    return df.join(split_labels(df, problem, think, row_id, val_ratio, test_ratio), row_id).select(*df.columns, "split")


def even_spaced_rank(df: DataFrame, problem: str = "problem", think: str = "think", row_id: str = "id",
                     val_ratio: float = VAL_RATIO, test_ratio: float = TEST_RATIO) -> DataFrame:
    """Rank of each unique row in difficulty order and its index on the val/test grid (or null)."""
    grid = _with_grid(unique_in_difficulty_order(df, problem, think, row_id), val_ratio, test_ratio)
    return grid.select(F.col(row_id), "think_len", "rank", "grid_index")


def _by_holdout(df: DataFrame, holdout: DataFrame, problem: str, holdout_text: str, how: str, row_id: str) -> DataFrame:
    """Semi or anti join on digests of the normalised problems.

    Held-out digests are first reduced to those that ``df`` has, with the number of its
    rows, so that the rows of a hot problem can be dealt over salts.
    """
    key = F.sha2(normalized_key(problem), 256).alias("_k")
    held = holdout.select(F.sha2(normalized_key(holdout_text), 256).alias("_k")).distinct()
    counts = df.select(key).where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("_rows"))
    rows = df.withColumn("_k", key)
    spread = row_id if row_id in df.columns else None
    return join_per_key(rows, counts.join(held, "_k", "left_semi"), "_k", "_rows", how, spread).select(*df.columns)


def leakage(train: DataFrame, holdout: DataFrame, problem: str = "problem", row_id: str = "id") -> DataFrame:
    """Train rows whose normalised problem also occurs in the hold-out (should be empty)."""
    return _by_holdout(train, holdout, problem, problem, "left_semi", row_id)


def antijoin_holdout(df: DataFrame, holdout: DataFrame, problem: str = "problem", holdout_text: str = "text", row_id: str = "id") -> DataFrame:
    """Rows whose normalised problem is not in the hold-out texts."""
    return _by_holdout(df, holdout, problem, holdout_text, "left_anti", row_id)


def semijoin_holdout(df: DataFrame, holdout: DataFrame, problem: str = "problem", holdout_text: str = "text", row_id: str = "id") -> DataFrame:
    """Rows whose normalised problem is in the hold-out texts."""
    return _by_holdout(df, holdout, problem, holdout_text, "left_semi", row_id)
