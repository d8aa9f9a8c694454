"""Key joins replacing positional pairing (``zip``) and verdict look-ups.

No side is forced to broadcast: the verdict and solution tables grow with
the data, so Spark's own size estimate (and AQE at run time) decides.  AQE
splits a hot key only where both sides of a join come straight from a
shuffle; a table with one row per key (an aggregate) is joined back with
:func:`join_per_key`, which splits the hot keys itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.functions.answers import parse_topic_verdict, parse_verdict
from ravel.session import written


def join_predictions(samples: DataFrame, outputs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples paired with model outputs by key (inner)."""
    return samples.join(outputs, on=key, how="inner")


def join_solutions(completions: DataFrame, solutions: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Completions paired with the solution of their prompt (inner)."""
    return completions.join(solutions, on=key, how="inner")


def join_verdicts(df: DataFrame, verdicts: DataFrame, key: str = "id", verdict: str = "verdict_text",
                  kind: str = "equivalence") -> DataFrame:
    """Left join of parsed external verdicts: ``verdict`` true / false / null (no verdict or unparsed).

    ``kind='equivalence'`` parses ``boxed{TRUE|FALSE}``; ``kind='topic'``
    reads a classifier reply (topic word present).
    """
    parsed = parse_verdict(verdict) if kind == "equivalence" else parse_topic_verdict(verdict)
    v = verdicts.select(F.col(key), parsed.alias("verdict"))
    return df.join(v, on=key, how="left")


def join_per_key(rows: DataFrame, per_key: DataFrame, on: str | list[str], count: str, how: str = "inner",
                 spread: str | list[str] | None = None, pieces: int | None = None) -> DataFrame:
    """``rows`` joined with ``per_key``, which has one row per key and, in ``count``, how many of ``rows`` have that key.

    A key is heavy when it holds more than one in ``pieces`` of the rows; there are
    fewer than ``pieces`` such keys, so their list is broadcast whatever the size of the data.
    Rows of a heavy key are dealt by a hash of ``spread`` (all columns by default) over as
    many salts as the key has shares, and the key's own row is repeated for every salt; any
    other key has one salt.  So no task gets much more than its share, and what is
    repeated stays below twice ``pieces`` rows.  ``per_key`` is written once and ``count`` dropped.
    """
    keys = [on] if isinstance(on, str) else list(on)
    per_key = written(per_key, "per-key")
    pieces = pieces or 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max((per_key.agg(F.sum(count)).first()[0] or 0) // pieces, 1)
    heavy = per_key.where(F.col(count) > share).select(*keys, F.ceil(F.col(count) / share).cast("int").alias("_salts"))
    deal = [spread] if isinstance(spread, str) else list(spread or rows.columns)
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*deal), F.col("_salts"))).otherwise(0).cast("int")
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", salt).drop("_salts")
    salts = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    copies = per_key.drop(count).join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")
