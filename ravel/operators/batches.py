"""Batch padding (collator): left-pad ids and labels to the batch's longest row,
rounded up to a multiple of 8.  The batch maximum is a grouped aggregate
joined back by batch id (batches have a fixed small size, so no skew)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravel.functions.tokens import left_pad
from ravel.params import IGNORE_INDEX


def pad_batches(df: DataFrame, batch: str, order: list[str], ids: str = "input_ids", labels: str = "labels",
                pad_id: int = 0, multiple: int = 8, ignore: int = IGNORE_INDEX) -> DataFrame:
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_max"))
    target = (F.ceil(F.col("_max") / multiple) * multiple).cast("int")
    j = df.join(longest, batch)
    n_pad = F.greatest(target - F.size(ids), F.lit(0))
    return (
        j.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(0), n_pad), F.array_repeat(F.lit(1), F.size(ids))))
        .withColumn(ids, left_pad(ids, target, pad_id))
        .withColumn(labels, left_pad(labels, target, ignore))
        .drop("_max")
    )
