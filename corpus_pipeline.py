"""Training-corpus pipeline: quality, line dedup, near duplicates, decontamination, tokens.

``STAGES`` are applied in order by :func:`run`; every stage's result is written as
Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravel.llm import bpe, decontam, jaccard, lines, quality
from ravel.llm.common import BATCH_BYTES, bounded_batches, scratch_table  # noqa: F401
from ravel.llm.queries import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on this stage's documents and the labels."""
    bounded_batches(spark)
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, keep=True)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat across documents."""
    bounded_batches(spark)
    return lines.drop_repeated_lines(docs).select(*docs.columns)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    bounded_batches(spark)
    return jaccard.keep_one_of_each_group(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    bounded_batches(spark)
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of the documents, the token ids, and the text decoded from them in place of the text.

    The ids are written first: in one stage, the workers of both steps would stand beside each other in an executor's memory.
    """
    bounded_batches(spark)
    decoded = bpe.decode_documents(scratch_table(bpe.encode_documents(docs), "encoded"))
    return decoded.withColumn("text", F.decode("decoded", "UTF-8")).drop("decoded")


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", keep_one_copy),
    ("benchmark decontamination", drop_leaks),
    ("byte-level BPE", encode),
]

#: The classifier's network can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch_table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
