"""Padding of token lists to the longest of their batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from procspark.functions.arrays import IGNORE
from procspark.functions.ranking import with_range_position


def with_batch(df: DataFrame, row_id: str, size: int, out: str = "batch_id", bounds: Sequence | None = None) -> DataFrame:
    """Number the batches of ``size`` consecutive rows in the order of an id; ids may have gaps and need not be dense.

    ``bounds``: ids that cut the rows into ranges, where they are known more cheaply than from df.
    """
    placed = with_range_position(df, [F.col(row_id)], "_at", bounds=bounds)
    return placed.withColumn(out, F.floor(F.col("_at") / size).cast("bigint")).drop("_at")


def pad(values: Column, length: Column, fill: int, side: str = "right") -> Column:
    gap = F.array_repeat(F.lit(fill), length - F.size(values))
    return F.concat(gap, values) if side == "left" else F.concat(values, gap)


def pad_batches(df: DataFrame, pad_id: int, batch: str = "batch_id", ids: str = "input_ids",
                side: str = "left", labels: Sequence[str] = (), max_length: int | None = None) -> DataFrame:
    """``input_ids``, ``attention_mask`` and list-valued ``labels`` padded to one length per batch.

    Scalar labels need nothing and pass through. The window holds one batch, whose
    row count the batch size bounds.
    """
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    out = df.withColumn("padded_length", longest)
    if max_length is not None:
        out = out.withColumn("padded_length", F.lit(max_length))
    n, length = F.size(ids), F.col("padded_length")
    ones, zeros = F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), length - n)
    out = out.withColumn("attention_mask",
                         F.concat(zeros, ones) if side == "left" else F.concat(ones, zeros))
    for c in labels:
        out = out.withColumn(c, pad(F.col(c), length, IGNORE, side))
    return out.withColumn(ids, pad(F.col(ids), length, pad_id, side))


def pad_choice_batches(df: DataFrame, pad_id: int, batch: str = "batch_id", ids: str = "input_ids",
                       side: str = "right") -> DataFrame:
    """As ``pad_batches`` for a list of token lists per row (one per choice)."""
    width = F.array_max(F.transform(ids, F.size))
    out = df.withColumn("padded_length", F.max(width).over(Window.partitionBy(batch)))
    length = F.col("padded_length")

    def mask(v: Column) -> Column:
        ones, zeros = F.array_repeat(F.lit(1), F.size(v)), F.array_repeat(F.lit(0), length - F.size(v))
        return F.concat(zeros, ones) if side == "left" else F.concat(ones, zeros)

    return (out.withColumn("attention_mask", F.transform(ids, mask))
            .withColumn(ids, F.transform(ids, lambda v: pad(v, length, pad_id, side))))
