"""Text cleaning, tokenizing, and packing token lists into equal blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from procspark.functions.arrays import IGNORE
from procspark.functions.text import is_blank, strip
from procspark.functions.tokens import words
from procspark.operators.batches import with_batch

MAP_BATCH = 1000  # fixed value: rows that are packed together


def strip_texts(df: DataFrame, text: str, text_pair: str | None = None) -> DataFrame:
    out = df.withColumn(text, strip(F.col(text)))
    return out if text_pair is None else out.withColumn(text_pair, strip(F.col(text_pair)))


def drop_blank_lines(df: DataFrame, column: str) -> DataFrame:
    """Keep lines with some visible character; the text itself is not stripped."""
    return df.filter(~is_blank(F.col(column)))


def tokenize(df: DataFrame, text: str, out: str = "tokens", keep: Sequence[str] = ()) -> DataFrame:
    """Token column instead of the source columns, apart from ``keep``."""
    return df.select(*keep, words(F.col(text)).alias(out))


def pack_blocks(df: DataFrame, columns: Sequence[str], block: int = 512, row_id: str = "row_id",
                batch: Column | None = None, bounds: Sequence | None = None) -> DataFrame:
    """Join the lists of a batch end to end and cut them into blocks of ``block``.

    A batch is ``MAP_BATCH`` consecutive rows in the order of ``row_id`` (see ``with_batch``), or what ``batch`` says. The rest
    that fills no block is dropped. Each list is cut where blocks end, so
    what is regrouped is at most one piece per (row, block) and never single
    tokens; the second grouping reuses the partitioning by batch.
    """
    first = columns[0]
    w = Window.partitionBy("batch_id").orderBy(row_id).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(row_id, *columns, *([] if batch is None else [batch.alias("batch_id")]))
    placed = ((with_batch(rows, row_id, MAP_BATCH, bounds=bounds) if batch is None else rows)
              .withColumn("_n", F.size(first))
              .withColumn("_from", F.coalesce(F.sum("_n").over(w), F.lit(0)))
              .filter(F.col("_n") > 0))
    pieces = placed.withColumn("block_id", F.explode(F.sequence(
        F.floor(F.col("_from") / block), F.floor((F.col("_from") + F.col("_n") - 1) / block))))
    lo = F.greatest(F.col("block_id") * block - F.col("_from"), F.lit(0)).cast("int")
    hi = F.least((F.col("block_id") + 1) * block - F.col("_from"), F.col("_n")).cast("int")
    cut = pieces.select("batch_id", "block_id", row_id, *[
        F.slice(c, lo + 1, hi - lo).alias(c) for c in columns])
    grouped = cut.groupBy("batch_id", "block_id").agg(
        F.sort_array(F.collect_list(F.struct(row_id, *columns))).alias("_parts"))
    return (grouped.select("batch_id", "block_id", *[
                F.flatten(F.col(f"_parts.{c}")).alias(c) for c in columns])
            .filter(F.size(first) == block))


def scored_tokens(labels: Column) -> Column:
    """How many labels are not the ignore label."""
    return F.size(F.filter(labels, lambda x: x != IGNORE)).cast("bigint")
