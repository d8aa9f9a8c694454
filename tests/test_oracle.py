"""A sample of registered queries against their DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from ravel.sources.fixtures import BASE_TABLES

SAMPLE = ["usable_topic_problems", "grade", "extract_boxed", "curate_source", "split_train_val_test", "topk_rewards",
          "reward_total", "length_histogram", "token_weights", "filter_topic", "build_corpus", "stream_topk", "stream_best_step",
          "stream_dedup", "prepare_sft", "weighted_token_loss", "alternate_question", "semijoin_holdout", "read_json_records", "flag_script",
          "strip_named_tags", "fix_choice_box", "stream_dataset"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r.asDict(recursive=True)[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


def test_entry_runs(spark):
    assert entry.entry(spark).count() >= 0
