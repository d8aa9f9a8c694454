"""Total order without a single-partition window.

``global_rank`` gives every row its 0-based position in a total order.  The
rows are range-partitioned on the order key (which must be unique, e.g.
``(think_len, row_id)``), so a value held by many rows is still split over
many tasks.  Within each partition ``monotonically_increasing_id`` numbers
rows in sorted order; the per-partition row counts (one row per partition,
a size known before the job) give the offsets, which are broadcast back.

The sorted, numbered rows are checkpointed to the shared checkpoint folder
first: both the counts and the final rows then read the same numbering,
and a lost executor re-reads it instead of recomputing a sort whose
partition boundaries could differ.  Callers therefore pass slim frames
(order key and row id) and join what they need by row id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravel.session import ensure_checkpoint_dir


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row (broadcast equi-join on a constant)."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def global_rank(df: DataFrame, order: list[Column | str], rank_col: str = "rank", num_partitions: int | None = None,
                total_col: str | None = None) -> DataFrame:
    """Add ``rank_col`` = 0-based position in ``order`` (the order key must be unique) and, if asked, the number of rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = _partitions(df, num_partitions)
    numbered = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    pid = F.shiftright(F.col("_mid"), 33)
    counts = numbered.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("_pid", F.sum("_n").over(before).alias("_off"), F.sum("_n").over(everything).alias("_all")).fillna(0, subset=["_off"])
    local = F.col("_mid") - F.shiftleft(pid, 33)
    ranked = numbered.join(F.broadcast(offsets), pid == F.col("_pid")).withColumn(rank_col, (F.col("_off") + local).cast("long"))
    if total_col:
        ranked = ranked.withColumn(total_col, F.col("_all"))
    return ranked.drop("_mid", "_pid", "_off", "_all")


def running_total(df: DataFrame, order: list[str], amount: str, start: str = "start", end: str = "end") -> DataFrame:
    """Add the sum of ``amount`` over the rows before each row in ``order`` (a unique key) and up to it.

    The rows are range-partitioned; each partition adds up its own, and the totals before it come
    from a table with one row per partition (broadcast).  No task sees more than its range.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ranged = df.repartitionByRange(_partitions(df, None), *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    inside = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col("_pid").alias("_p")).agg(F.sum(amount).alias("_t"))
    offsets = totals.select("_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    counted = ranged.withColumn("_in", F.sum(amount).over(inside)).join(F.broadcast(offsets), F.col("_pid") == F.col("_p"))
    upto = F.col("_before") + F.col("_in")
    return counted.withColumn(end, upto).withColumn(start, upto - F.col(amount)).drop("_pid", "_p", "_before", "_in")


def take_first(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """First ``n`` rows in ``order`` (a unique key), whatever ``n`` is.

    The order keys alone are ranked; the key at rank ``n - 1`` is the cutoff (one
    row), and the rows up to it pass a filter.  Whole rows are not shuffled.
    """
    if n <= 0:
        return df.limit(0)
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    key = F.struct(*[k.alias(f"o{i}") for i, k in enumerate(keys)])
    slim = df.select(key.alias("_key"))
    cut = global_rank(slim, ["_key"], "_rk").filter(F.col("_rk") == n - 1).agg(F.max("_key").alias("_cut"))
    return attach_one_row(df, cut).filter(F.col("_cut").isNull() | (key <= F.col("_cut"))).drop("_cut")


def sort_by_difficulty(df: DataFrame, think_len: str = "think_len", row_id: str = "id") -> DataFrame:
    return df.orderBy(F.col(think_len), F.col(row_id))
