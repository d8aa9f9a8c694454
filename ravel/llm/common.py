"""Helpers shared by the operators of this subpackage.

Text work runs in Arrow batches (``mapInArrow``).  A batch is cut again by
bytes before Python objects are made of it, so a task's memory is bounded
by ``SLICE_BYTES`` and the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ravel.session import scratch_path

SLICE_BYTES = 4 << 20
READ_ROWS = 256
BATCH_BYTES, BATCH_ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
SHINGLE_WORDS = 5

U64 = np.uint64
_K = U64(0x9E3779B97F4A7C15)
_HASHES_KEPT = 200_000


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches holding about ``max_bytes`` of ``column`` (one row at least); then freed memory goes back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size + 64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)
    release_memory()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; a null text is empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def texts(column: pa.Array) -> list[str]:
    """Every text; a null text is empty."""
    return pc.fill_null(column, "").to_pylist()


def arrow_rows(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A batch of columns given as ``name: (values, type)``."""
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in columns.values()], names=list(columns))


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and stands beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHashes(dict):
    """64-bit hash of a word (bytes), kept for words seen lately; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _HASHES_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), U64, len(words))


def split_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return text.lower().split()


def shingle_hashes(text: bytes, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the n-word shingles in order of the text; a shorter text is one shingle, an empty one none."""
    words = split_words(text)
    if not words:
        return np.empty(0, U64)
    h = word_hashes(words)
    short = len(words) < n
    width = len(words) if short else n
    out = h[: len(h) - width + 1].copy()
    for i in range(1, width):
        out *= _K
        out += h[i : len(h) - width + 1 + i]
    return mix64(out + U64(width))


def bounded_batches(spark: SparkSession) -> None:
    """Texts are read in batches of ``READ_ROWS`` rows and go to Python workers in batches of ``SLICE_BYTES`` at most.

    An executor's JVM never gives back the buffers of larger ones.
    """
    spark.conf.set(BATCH_ROWS, str(READ_ROWS))
    spark.conf.set(BATCH_BYTES, f"{SLICE_BYTES}b")


def scratch_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node long, component long)`` for every node of ``edges``; the component is its smallest node.

    Alternating large-star and small-star steps; every round ends in a table in
    the shared folder.  A round moves links only, never a whole component, and
    the number of rounds grows with the logarithm of the longest chain.
    """
    pairs = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
    )

    def written(rows: DataFrame) -> tuple[DataFrame, dict]:
        """The links as a table, and their number and a sum of hashes taken while they are written."""
        seen = Observation()
        total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        return scratch_table(rows.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("h")), "links"), seen.get

    links, seen = written(pairs)
    while seen["n"]:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u hangs on u's smallest neighbour
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and its smaller neighbours hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links, now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if now == seen:
            break
        seen = now
    roots = links.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
