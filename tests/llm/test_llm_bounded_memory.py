"""Bounds on what an executor holds at once in the line dedup and in the pipeline's stages."""

import pytest

import corpus_pipeline
from ravel.llm import common, lines
from test_llm_operators import brute_lines

LONG = "A line that is long enough to have a key of its own, number"


@pytest.fixture
def unbounded(spark):
    names = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch")
    was = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.unset(n)
    yield names
    for n, v in zip(names, was, strict=True):
        spark.conf.set(n, v)


def bounded(spark, names):
    rows, size = (spark.conf.get(n) for n in names)
    return int(rows) <= 256 and int(size.rstrip("b")) <= common.SLICE_BYTES


def some_docs():
    texts = ["\n".join(f"{LONG} {k}" for k in range(i % 7)) for i in range(60)]
    return [(i, t) for i, t in enumerate(texts)] + [(60, None), (61, "")]


def test_line_dedup_reads_and_sends_bounded_batches(spark, unbounded):
    docs = spark.createDataFrame(some_docs(), "doc_id long, text string")
    assert not bounded(spark, unbounded)
    out = lines.line_digests(docs)
    assert bounded(spark, unbounded)
    assert lines.BLOCK_BYTES <= common.SLICE_BYTES  # a block's documents are one batch to a worker, and one of many in a task
    assert sorted(map(tuple, out.collect())) == sorted(brute_lines(some_docs()))


def test_line_dedup_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_BYTES", 300)
    docs = spark.createDataFrame(some_docs(), "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, lines.line_digests(docs).collect())) == sorted(brute_lines(some_docs()))


def test_pipeline_stages_read_bounded_batches(spark, unbounded):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string")
    dict(corpus_pipeline.STAGES)["byte-level BPE"](spark, docs, "")
    assert bounded(spark, unbounded)
