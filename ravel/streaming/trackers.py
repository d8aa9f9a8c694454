"""Structured Streaming versions of the online trackers and of incremental curation.

* ``stream_topk`` and ``stream_best_step`` fold every micro-batch into a small
  keyed table (at most k rows per run, one row per run) in ``foreachBatch``: the rows
  held so far and the new ones go through the same DataFrame operator as in batch,
  so a run with very many new rows is reduced by Spark's grouped plans.
* ``stream_curate`` runs the row-wise curation of a source and a streaming
  ``dropDuplicates`` on a digest of the normalised problem; ``stream_dedup`` only the latter.

Sources are file directories read with a fixed schema.  Every stream takes a ``location``, a
folder that holds its checkpoint and its table: a query started again with the same
location, in whatever session, goes on after the last micro-batch that was committed.  Without one, a fresh
folder below the shared checkpoint folder is used once.

A version of a keyed table is written per micro-batch under the batch's number; a
batch that is run again overwrites its own version and reads the one before, so
the last two versions are kept and older ones removed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ravel.functions.text import normalized_key
from ravel.operators.dedup import key_digest
from ravel.operators.selection import topk_rewards
from ravel.params import SourceSpec
from ravel.plans.curate import curated_columns, shape_source
from ravel.session import folder_names, remove_folder, scratch_path

FILES_PER_BATCH = 8


def _read(spark: SparkSession, source_dir: str, schema: StructType, files_per_batch: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)


def _fold(src: DataFrame, name: str, reduce_rows: Callable[[DataFrame], DataFrame], location: str | None) -> DataFrame:
    """The keyed table after all available micro-batches: ``reduce_rows`` of the rows held and the new ones, batch by batch."""
    spark = src.sparkSession
    base = location or scratch_path(spark, name)
    state = f"{base}/state"

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch
        if number:
            rows = session.read.schema(src.schema).parquet(f"{state}/{number - 1}").unionByName(batch)
        reduce_rows(rows).write.mode("overwrite").parquet(f"{state}/{number}")
        for old in _versions(session, state):
            if old < number - 1:
                remove_folder(session, f"{state}/{old}")

    query = src.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    versions = _versions(spark, state)
    if not versions:
        return spark.createDataFrame([], src.schema)
    return spark.read.schema(src.schema).parquet(f"{state}/{max(versions)}")


def _versions(spark: SparkSession, state: str) -> list[int]:
    return [int(name) for name in folder_names(spark, state) if name.isdigit()]


def append_stream(rows: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """All rows that a stream has appended to the table of its ``location`` after all available micro-batches."""
    spark = rows.sparkSession
    base = location or scratch_path(spark, name)
    query = (rows.writeStream.outputMode("append").format("parquet").option("path", f"{base}/table")
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/table")


def stream_topk(spark: SparkSession, source_dir: str, schema: StructType, k: int, run: str = "run_id",
                step: str = "step", reward: str = "reward", files_per_batch: int = FILES_PER_BATCH, location: str | None = None) -> DataFrame:
    """Final top-k rows per run after all files of ``source_dir`` arrived (a run's batches in step order).

    Keeping on from the rows held is the same as keeping from the start, so the batch
    closed form over held and new rows gives the online keeper's state.
    """
    src = _read(spark, source_dir, schema, files_per_batch).select(
        F.col(run).alias("run_id"), F.col(step).alias("step"), F.col(reward).cast("double").alias("reward"))
    return _fold(src, "topk", lambda rows: topk_rewards(rows, k), location)


def stream_best_step(spark: SparkSession, source_dir: str, schema: StructType, eval_steps: int, run: str = "run_id",
                     step: str = "step", accuracy: str = "accuracy", tokens: str = "avg_tokens",
                     files_per_batch: int = FILES_PER_BATCH, location: str | None = None) -> DataFrame:
    """Best evaluated step per run: highest accuracy, then lowest tokens, then earliest step."""
    src = _read(spark, source_dir, schema, files_per_batch).select(
        F.col(run).alias("run_id"), F.col(step).alias("step"), F.col(accuracy).alias("accuracy"), F.col(tokens).alias("avg_tokens"))
    evaluated = src.filter((F.col("step") % eval_steps == 0) & (F.col("step") != 0))

    def best(rows: DataFrame) -> DataFrame:
        top = F.max(F.struct(F.col("accuracy").alias("a"), (-F.col("avg_tokens")).alias("t"), (-F.col("step")).alias("s"))).alias("b")
        return rows.groupBy("run_id").agg(top).select("run_id", (-F.col("b.s")).alias("step"), F.col("b.a").alias("accuracy"), (-F.col("b.t")).alias("avg_tokens"))

    return _fold(evaluated, "best-step", best, location)


def _first_arrivals(rows: DataFrame, problem: str, within: tuple[str, str] | None) -> DataFrame:
    keyed = rows.withColumn("_digest", key_digest(normalized_key(problem)))
    if within is None:
        return keyed.dropDuplicates(["_digest"]).drop("_digest")
    time_col, delay = within
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def stream_curate(spark: SparkSession, source_dir: str, schema: StructType, spec: SourceSpec,
                  within: tuple[str, str] | None = None, files_per_batch: int = FILES_PER_BATCH, location: str | None = None) -> DataFrame:
    """Row-wise curation of a source (no caps or samples, which need the whole source), then streaming dedup."""
    rows = curated_columns(shape_source(_read(spark, source_dir, schema, files_per_batch), spec), spec)
    return append_stream(_first_arrivals(rows, "problem", within), "curate", location)


def stream_dedup(spark: SparkSession, source_dir: str, schema: StructType, problem: str = "problem",
                 within: tuple[str, str] | None = None, files_per_batch: int = FILES_PER_BATCH, location: str | None = None) -> DataFrame:
    """Streaming keep-first dedup (the first arrival of a key is kept).

    The state holds a digest of every key seen; ``within`` = (time column, delay) bounds
    it to duplicates that arrive within the watermark's delay.
    """
    return append_stream(_first_arrivals(_read(spark, source_dir, schema, files_per_batch), problem, within), "dedup", location)


def write_in_arrival_order(df: DataFrame, path: str, order: str, parts: int, key: str | None = None) -> None:
    """Write ``df`` as ``parts`` successive appends in ``order`` ranges, so that a file source replays the log in order.

    Within a range the rows of a ``key`` stay in one file, sorted; rows without an order come last.
    """
    bounds = df.select(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10000).alias("b")).first()["b"] or []
    edges = [None, *bounds, None]
    for at, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (F.col(order) > lo)
        if hi is not None:
            cond = cond & (F.col(order) <= hi)
        if at == len(edges) - 2:
            cond = cond | F.col(order).isNull()
        rows = df.filter(cond)
        rows = rows.repartition(F.col(key)) if key else rows
        rows.sortWithinPartitions(order).write.mode("append").parquet(path)
