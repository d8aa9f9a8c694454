"""Streams that stop and are started again in another session."""

import pytest
from pyspark.sql import functions as F

from ravel.sources import io as IO
from ravel.streaming import trackers as TR

LOG = "run_id long, step long, reward double, accuracy double, avg_tokens double"


def log_files(spark, path, at):
    """File ``at`` of a log: steps in order, many ties."""
    rows = [(run, s, float((s * 7 + run) % 5), float(s * 3 % 4), float(s % 6)) for run in range(4) for s in range(at * 20, at * 20 + 20)]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


STREAMS = {
    "topk": lambda spark, src, schema, where: TR.stream_topk(spark, src, schema, 3, files_per_batch=1, location=where),
    "best": lambda spark, src, schema, where: TR.stream_best_step(spark, src, schema, 5, files_per_batch=1, location=where),
}


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("name", STREAMS)
def test_keyed_tables_go_on_where_they_stopped(spark, tmp_path, name):
    run, schema = STREAMS[name], spark.createDataFrame([], LOG).schema
    whole, src, where = f"{tmp_path}/whole", f"{tmp_path}/src", f"{tmp_path}/where"
    for at in range(5):
        log_files(spark, whole, at)
    want = rows_of(run(spark, whole, schema, f"{tmp_path}/once"))
    for at in range(2):
        log_files(spark, src, at)
    run(spark, src, schema, where)  # two micro-batches, then the query ends
    for at in range(2, 5):
        log_files(spark, src, at)
    again = run(spark.newSession(), src, schema, where)
    assert rows_of(again) == want
    assert sorted(int(p.name) for p in (tmp_path / "where/state").iterdir() if p.name.isdigit()) == [3, 4]  # the last two versions
    assert rows_of(run(spark.newSession(), src, schema, where)) == want  # nothing new


def test_a_batch_that_failed_is_run_again(spark, tmp_path, monkeypatch):
    schema = spark.createDataFrame([], LOG).schema
    src, where = f"{tmp_path}/src", f"{tmp_path}/where"
    for at in range(4):
        log_files(spark, src, at)
    want = rows_of(STREAMS["topk"](spark, src, schema, f"{tmp_path}/once"))
    calls, good = [], TR.topk_rewards

    def lost(rows, k):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return good(rows, k)

    monkeypatch.setattr(TR, "topk_rewards", lost)
    with pytest.raises(Exception, match="lost"):
        STREAMS["topk"](spark, src, schema, where)
    monkeypatch.setattr(TR, "topk_rewards", good)
    assert rows_of(STREAMS["topk"](spark.newSession(), src, schema, where)) == want


def test_dedup_remembers_what_it_saw(spark, tmp_path):
    src, where = f"{tmp_path}/src", f"{tmp_path}/where"
    schema = "id long, problem string"

    def add(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    add([(1, "A"), (2, "b")])
    add([(3, " a "), (4, "c")])
    shape = spark.createDataFrame([], schema).schema
    assert sorted(r.problem.strip().lower() for r in TR.stream_dedup(spark, src, shape, files_per_batch=1, location=where).collect()) == ["a", "b", "c"]
    add([(5, "B"), (6, "d")])
    out = TR.stream_dedup(spark.newSession(), src, shape, files_per_batch=1, location=where)
    assert sorted(r.problem.strip().lower() for r in out.collect()) == ["a", "b", "c", "d"]
    assert 6 in {r.id for r in out.collect()} and 5 not in {r.id for r in out.collect()}


def test_streams_without_input(spark, tmp_path):
    (tmp_path / "src").mkdir()
    schema = spark.createDataFrame([], LOG).schema
    for name, run in STREAMS.items():
        assert run(spark, f"{tmp_path}/src", schema, f"{tmp_path}/{name}").count() == 0


def test_streamed_dataset_is_the_batch_dataset(spark, tmp_path):
    rows = spark.range(600).select("id", F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("subset"), F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"))
    rows.repartition(6).write.partitionBy("subset", "split").parquet(f"{tmp_path}/data")
    stream = IO.stream_dataset(spark, f"{tmp_path}/data", rows.schema, "en", "train", files_per_trigger=1)
    got = TR.append_stream(stream, "dataset", f"{tmp_path}/where")
    assert rows_of(got.select("id")) == rows_of(IO.read_dataset(spark, f"{tmp_path}/data", "en", "train").select("id"))
    rows.withColumn("id", F.col("id") + 1000).write.mode("append").partitionBy("subset", "split").parquet(f"{tmp_path}/data")
    more = TR.append_stream(IO.stream_dataset(spark.newSession(), f"{tmp_path}/data", rows.schema, "en", "train"), "dataset", f"{tmp_path}/where")
    assert more.count() == 200 and more.select("id").distinct().count() == 200


def test_written_datasets_files_grow_in_number_not_in_size(spark, tmp_path):
    rows = spark.range(400).select("id", F.expr("if(id % 9 = 0, null, repeat('x', 100))").alias("t"), F.lit("en").alias("subset"))
    for size, least, files in ((1 << 20, 4, 4), (1000, 4, 36)):
        path = f"{tmp_path}/data-{size}"
        IO.write_dataset(rows, path, ["subset"], "t", size, least)
        shares = [r.n for r in spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(shares) == files and sum(shares) == 400 and max(shares) <= 2 * 400 / files
    IO.write_dataset(rows.limit(0), f"{tmp_path}/none", ["subset"], "t")
