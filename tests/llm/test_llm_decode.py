"""Decoding by columns in bounded parts, and one worker per task in the pipeline's last stage."""

import numpy as np
import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from ravel.llm import bpe


def test_decoded_columns_are_the_rows_one_by_one(monkeypatch):
    coder = bpe.encoder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    rng = np.random.default_rng(2)
    rows = [None, [], *[rng.integers(0, 50_000, n).tolist() for n in (1, 7, 90, 0, 25, 3)], None]
    lists = pa.array(rows, pa.list_(pa.int32()))
    want = [coder.decode(r or ()) for r in rows]
    for most in (1, 30, 1 << 18):
        monkeypatch.setattr(bpe, "DECODED_AT_ONCE", most)
        parts = list(coder.decode_column(lists))
        assert [x for p in parts for x in p.to_pylist()] == want and {p.type for p in parts} == {pa.binary()}
        assert most > 30 or len(parts) > 2
        assert [x for p in coder.decode_column(lists.slice(3, 4)) for x in p.to_pylist()] == want[3:7]
    assert sum(map(len, coder.decode_column(lists[:0]))) == 0


def test_the_last_stage_runs_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string")
    was = spark.conf.get(corpus_pipeline.BATCH_BYTES)
    spark.conf.unset(corpus_pipeline.BATCH_BYTES)
    out = dict(corpus_pipeline.STAGES)["byte-level BPE"](spark, docs, "")
    assert int(spark.conf.get(corpus_pipeline.BATCH_BYTES).rstrip("b")) <= 4 << 20  # and rows reach it in bounded batches
    spark.conf.set(corpus_pipeline.BATCH_BYTES, was)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted((r.doc_id, r.text, len(r.ids) > 0) for r in out.collect()) == [(1, "ab cd", True), (2, "", False)]
