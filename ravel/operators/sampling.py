"""Deterministic shuffles, caps, limits and weighted sampling.

Randomness is a function of ``(seed, row_id)`` through md5, so the same rows
are drawn on every run and on every engine; the exact permutation of the
original library is not reproduced (it depends on its RNG).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravel.functions.text import col_
from ravel.functions.tokens import unit_hash
from ravel.operators.ranking import take_first
from ravel.params import LENGTH_POWER, SHUFFLE_SEED


def shuffle_key(seed: int, row_id: Column | str) -> Column:
    """md5 of ``seed:row_id`` (hex string); ties impossible in practice, broken by row id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), col_(row_id).cast("string")))


def seeded_shuffle(df: DataFrame, seed: int = SHUFFLE_SEED, row_id: str = "id") -> DataFrame:
    return df.orderBy(shuffle_key(seed, row_id), F.col(row_id))


def take_n(df: DataFrame, n: int, row_id: str = "id") -> DataFrame:
    """First ``n`` rows in source order (row id order)."""
    return take_first(df, [F.col(row_id)], n)


def cap_per_group(df: DataFrame, group: str, max_per_group: int, order: list[Column | str]) -> DataFrame:
    """At most ``max_per_group`` rows per group value (null is a group), first in ``order``.

    ``row_number() <= N`` gets a partial per-task limit before the shuffle,
    so a hot group ships at most N rows per task.
    """
    w = Window.partitionBy(F.col(group)).orderBy(*[col_(o) for o in order])
    return df.withColumn("_gn", F.row_number().over(w)).filter(F.col("_gn") <= max_per_group).drop("_gn")


def sample_first_accepted(df: DataFrame, n_samples: int | None, max_candidates: int | None,
                          seed: int = SHUFFLE_SEED, row_id: str = "id") -> DataFrame:
    """First ``min(n, max_candidates)`` accepted rows in shuffle order."""
    caps = [c for c in (n_samples, max_candidates) if c is not None]
    if not caps:
        return df
    return take_first(df, [shuffle_key(seed, row_id), F.col(row_id)], min(caps))


def sample_by_length(df: DataFrame, length: str, n: int, power: float = LENGTH_POWER,
                     seed: int = SHUFFLE_SEED, row_id: str = "id") -> DataFrame:
    """Weighted sample without replacement, weight = length ** power (Efraimidis–Spirakis).

    Key ``-ln(u) / w`` with ``u`` from md5; the ``n`` smallest keys are the
    sample.  Weight 0 gives key +inf (drawn last).
    """
    u = F.greatest(unit_hash(F.lit(seed), F.col(row_id)), F.lit(1e-300))
    w = F.pow(F.col(length).cast("double"), F.lit(float(power)))
    key = F.when(w > 0, -F.log(u) / w).otherwise(F.lit(float("inf")))
    return take_first(df.withColumn("_es", key), [F.col("_es"), F.col(row_id)], n).drop("_es")
