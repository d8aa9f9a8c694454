"""Readers and writers.

Writers produce directories of part files (one per task), which is what
lets them scale; single-file outputs of the original (a JSON array, one
CSV) are not reproduced.  Schemas are always given explicitly on read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ravel.operators.joins import join_per_key
from ravel.session import written


def read_json_records(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """The objects of JSON arrays (or single objects), one row each, with files of any size read by many tasks.

    A file is cut at every ``}``, which Spark's text source does range by range.  A backslash
    never stands before a ``}``, so a piece turns "inside a string" by the number of its unescaped quotes alone,
    and its braces are counted for both cases.  The pieces are written once; from then on only their slim
    columns are needed: quotes, then depths, then finished objects are added up within each range, and
    a table with one row per range carries the sums on from range to range of a file.  Pieces between two returns to depth 0 are
    an object, also across ranges, and only objects of several pieces are grouped.
    A malformed object gives a row of nulls.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))

    def braces(text: Column) -> Column:
        outside = F.regexp_replace(text, '(?s)"[^"]*("|\\z)', "")
        return F.length(outside) - F.length(F.replace(outside, F.lit("{"), F.lit("")))

    pieces = written(raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("seq"),
        "value", (quotes % 2).cast("int").alias("q"), braces(bare).alias("o0"), braces(F.concat(F.lit('"'), bare)).alias("o1")), "json-pieces")
    slim = pieces.select("file", "at", "seq", "q", "o0", "o1")
    inside = Window.partitionBy("file", "at").orderBy("seq")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, amount: str, name: str) -> DataFrame:
        """``name``: the sum of ``amount`` over all pieces of the file before this one."""
        ranges = rows.groupBy("file", "at").agg(F.sum(amount).alias("_s")).select("file", "at", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
        own = rows.withColumn("_own", F.coalesce(F.sum(amount).over(before), F.lit(0)))
        return own.join(ranges, ["file", "at"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_before", "_own")

    quoted = carried(slim, "q", "quotes").withColumn("s", F.col("quotes") % 2)
    opened = F.when(F.col("s") == 0, F.col("o0")).otherwise(F.col("o1"))
    closed = ((F.col("s") + F.col("q")) % 2 == 0).cast("int")
    deep = carried(quoted.select("file", "at", "seq", opened.alias("o"), closed.alias("c"), (opened - closed).alias("d")), "d", "depth")
    ends = ((F.col("c") == 1) & (F.col("depth") + F.col("d") == 0)).cast("int")
    numbered = carried(deep.select("file", "at", "seq", "o", "depth", ends.alias("e")), "e", "object")
    # what stands between objects and after the last one opens nothing at depth 0
    part = numbered.where((F.col("depth") > 0) | (F.col("o") > 0)).select("file", "at", "seq", "object", ((F.col("depth") == 0) & (F.col("e") == 1)).alias("alone"))
    texts = pieces.select("file", "at", "seq", "value").join(part, ["file", "at", "seq"])
    long = texts.where(~F.col("alone")).groupBy("file", "object").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "value"))).alias("p"))
    whole = texts.where("alone").select("value").union(long.select(F.array_join(F.col("p.value"), "}")))
    text = F.concat(F.regexp_replace("value", r"\A[^{]*", ""), F.lit("}"))
    return whole.select(F.from_json(text, schema).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One JSON object per line; splittable."""
    return spark.read.schema(schema).json(path)


def read_dataset(spark: SparkSession, path: str, subset: str | None = None, split: str | None = None) -> DataFrame:
    """A dataset stored as Parquet partitioned by ``subset``/``split``; filters prune partitions."""
    return _part_of(spark.read.parquet(path), subset, split)


def write_dataset(df: DataFrame, path: str, partitions: list[str], text: str, size: int = 64 << 20, least: int = 4) -> None:
    """``df`` as Parquet partitioned by ``partitions``, in as many tasks as leave about ``size`` bytes of ``text`` to each, at ``least`` so many.

    Rows are dealt in turn, so a task's share does not grow with the data, however much of it has one text.
    """
    total = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    df.repartition(max(least, -(-total // size))).write.partitionBy(*partitions).parquet(path)


def _part_of(df: DataFrame, subset: str | None, split: str | None) -> DataFrame:
    if subset is not None:
        df = df.filter(F.col("subset") == subset)
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df


def stream_dataset(spark: SparkSession, path: str, schema: StructType, subset: str | None = None, split: str | None = None,
                   files_per_trigger: int = 1000) -> DataFrame:
    """:func:`read_dataset` as a stream: files are read as they are asked for, ``files_per_trigger`` at a time.

    ``schema`` has the columns of the files and the partition columns; filters on the latter prune files here too.
    """
    return _part_of(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path), subset, split)


def read_text_blob(spark: SparkSession, path: str) -> DataFrame:
    """Each file as one string (``path``, ``value``)."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def write_text_blobs(texts: DataFrame, path: str, value: str = "value", size: int = 8 << 20) -> None:
    """One text per line, in as many files as leave about ``size`` bytes to each (one text at least), for :func:`read_text_blob`.

    A row goes to a file by a hash of its place, so equal texts are dealt as well.
    """
    lines = texts.select(F.coalesce(F.col(value), F.lit("")).alias("value"))
    total = lines.agg(F.sum(F.octet_length("value") + 1).alias("n")).first()["n"] or 0
    lines.repartition(max(1, -(-total // size)), F.xxhash64(F.monotonically_increasing_id())).write.text(path)


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """JSON Lines (non-ASCII kept as is) or Parquet."""
    w = df.write.mode(mode)
    if fmt == "json":
        w.option("ignoreNullFields", "false").json(path)
    else:
        w.parquet(path)


def write_json_arrays(df: DataFrame, path: str, part: Column, rows: int = 10_000, size: int = 8 << 20) -> None:
    """JSON arrays of objects, one in each file ``part=*/block=*/*``, for :func:`read_json_records`.

    A part is dealt over as many blocks as leave about ``rows`` rows and ``size``
    bytes to an array at most (one row at least), so the files of a large part, a
    null one or one of equal rows grow in number and not in size.
    """
    values = df.select(part.alias("part"), F.to_json(F.struct(*df.columns)).alias("value"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("dealt"))  # equal rows are dealt too
    keyed = values.withColumn("of", F.coalesce(F.concat(F.lit("="), F.col("part").cast("string")), F.lit("")))  # a null part is a key like any other
    needed = F.greatest(F.count(F.lit(1)) / rows, F.sum(F.octet_length("value")) / size)
    blocks = keyed.groupBy("of").agg(F.ceil(needed).alias("blocks"), F.count(F.lit(1)).alias("_rows"))
    dealt = join_per_key(keyed, blocks, "of", "_rows", spread="dealt").withColumn("block", F.expr("pmod(dealt, blocks)"))
    arrays = dealt.groupBy("part", "block").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("part", "block").text(path)


def write_with_rejects(df: DataFrame, path: str, decision: str = "decision", fmt: str = "parquet") -> None:
    """Kept and rejected rows in one pass: one sub-folder per decision value."""
    w = df.write.mode("overwrite").partitionBy(decision)
    w.json(path) if fmt == "json" else w.parquet(path)


def write_jsonl_with_summary(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """Rows as JSON Lines under ``path/rows`` and the one-row count record under ``path/summary``."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")


CSV_OPTIONS = {"header": "true", "quoteAll": "true", "escape": '"', "multiLine": "true"}


def write_eval_details(details: DataFrame, path: str) -> None:
    """CSV with header; every cell quoted so multi-line model outputs survive."""
    details.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_eval_details(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS).csv(path)


def two_decimals(number: Column | str) -> Column:
    """A double with two decimals as C prints it: the exact binary value is rounded, ties to even (0.125 is 0.12, 2.675 is 2.67)."""
    return F.call_function("format_number", F.col(number) if isinstance(number, str) else number, F.lit("0.00"))


def append_result(summary: DataFrame, path: str, model: str, dataset: str) -> DataFrame:
    """Append summary rows (timestamp, model, dataset, accuracy, avg tokens as 2-decimal strings).

    Every append adds part files with a header; readers read the folder
    with ``header=true``.  Returns the rows written.
    """
    rows = summary.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.lit(model).alias("model"),
        F.lit(dataset).alias("dataset"),
        two_decimals("accuracy").alias("accuracy"),
        two_decimals("avg_tokens").alias("avg_tokens_generated"),
    )
    rows.write.mode("append").options(header="true").csv(path)
    return rows
