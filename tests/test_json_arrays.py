"""JSON arrays of bounded size, whatever the parts look like."""

from collections import Counter

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string"


def turns(n):
    """A long conversation of equal turns, turns without conversation, and others with signs that JSON escapes."""
    odd = ["a \"b\"\n\\ é ", "", None, "[1]"]
    return [(5, 0, "user", "same")] * n + [(None, i, "user", "lost") for i in range(n)] + [(i * 400, 1, None, odd[i % 4]) for i in range(200)]


def test_long_conversations_fill_more_files(spark, tmp_path):
    from ravel.sources import io

    rows = turns(25_000)
    df = spark.createDataFrame(rows, SCHEMA)
    io.write_json_arrays(df, f"{tmp_path}/out", F.floor(F.col("conv_id") / 1000))
    files = spark.read.schema(SCHEMA).json(f"{tmp_path}/out/part=*/block=*", multiLine=True).groupBy(F.input_file_name().alias("file")).count().collect()
    assert max(r["count"] for r in files) < 12_000
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["read_json_records"](spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(rows)


def test_long_texts_fill_more_files(spark, tmp_path):
    from ravel.sources import io

    rows = [(1, i, "user", "é" * 50_000) for i in range(60)]
    io.write_json_arrays(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/out", F.floor(F.col("conv_id") / 1000), size=1 << 20)
    files = list((tmp_path / "out").glob("part=0/block=*/part-*"))
    assert len(files) > 3 and max(f.stat().st_size for f in files) < 3 << 20
    back = io.read_json_records(spark, f"{tmp_path}/out/part=*/block=*", spark.createDataFrame([], SCHEMA).schema)
    assert Counter(map(tuple, back.collect())) == Counter(rows)


ODD = ['plain', 'a "quote" and \\ a backslash', 'braces } { in }} text', '\\', '"', '}"', 'é漢\n\t', '', 'ends with }', '{"not": "an object"}', '\\\\"}', '[,]']
NESTED = "id long, text string, deep struct<a: struct<b: string>, list: array<struct<c: string>>>, tags array<string>"


def array_file(path, n, indent=None):
    import json

    rows = [{"id": i, "text": ODD[i % 12], "deep": {"a": {"b": ODD[i * 5 % 12]}, "list": [{"c": ODD[(i + k) % 12]} for k in range(i % 4)]}, "tags": ODD[: i % 3]} for i in range(n)]
    path.write_text(json.dumps(rows, ensure_ascii=n % 2 == 1, indent=indent), encoding="utf-8")


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def to(size):
        for n, v in zip(names, (size, "0")):
            spark.conf.set(n, v)

    yield to
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", ["89b", "4001b"])
def test_an_array_is_read_by_many_tasks(spark, tmp_path, small_ranges, size):
    from ravel.sources import io

    (tmp_path / "in").mkdir()
    n = 24 if size == "89b" else 601
    array_file(tmp_path / "in/a.json", n)
    array_file(tmp_path / "in/b.json", 30, indent=2)
    (tmp_path / "in/c.json").write_text('{"id": -1, "text": "one object", "deep": null}')
    (tmp_path / "in/d.json").write_text(" [ ] \n")
    (tmp_path / "in/e.json").write_text("")
    shape = spark.createDataFrame([], NESTED).schema
    want = Counter(map(str, spark.read.schema(shape).json(f"{tmp_path}/in", multiLine=True).where("id is not null").collect()))
    small_ranges(size)
    assert spark.read.option("lineSep", "}").text(f"{tmp_path}/in").rdd.getNumPartitions() > 10
    got = io.read_json_records(spark, f"{tmp_path}/in", shape).collect()
    assert len(got) == n + 31 and Counter(map(str, got)) == want
