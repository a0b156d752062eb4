"""Hidden states -> one vector per token or per sentence.

Input is a long table ``(row_id, layer, pos, vec, mask)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from procspark.functions.vectors import doubles, mean_vector, sum_vector


def pick_layers(states: DataFrame, layers: int | Sequence[int], n_total: int) -> DataFrame:
    """The last ``layers`` layers, or the listed ones; a negative number counts from the end."""
    wanted = (range(n_total - layers, n_total) if isinstance(layers, int)
              else [i % n_total for i in layers])
    return states.filter(F.col("layer").isin(list(wanted)))


def merge_layers(states: DataFrame, how: str = "mean", key: Sequence[str] = ("row_id", "pos")) -> DataFrame:
    """Element-wise mean or sum of a token's vectors over layers."""
    agg = {"mean": mean_vector, "sum": sum_vector}[how]
    return states.groupBy(*key).agg(F.max("mask").alias("mask"), agg(doubles(F.col("vec"))).alias("vec"))


def mean_pool(tokens: DataFrame, key: Sequence[str] = ("row_id",)) -> DataFrame:
    """Mean over tokens whose mask is positive (mask values count as 0 or 1).

    A vector aggregate with map-side combine, so a very long row is folded where
    it is read. A row without any such token gets a null vector.
    """
    live = F.col("mask") > 0
    vec = doubles(F.col("vec"))
    summed = tokens.groupBy(*key).agg(
        sum_vector(F.when(live, vec).otherwise(F.transform(vec, lambda x: F.lit(0.0)))).alias("_s"),
        F.count_if(live).alias("_n"))
    return summed.select(*key, F.when(F.col("_n") > 0, F.transform("_s", lambda x: x / F.col("_n"))).alias("vec"))


def first_pool(tokens: DataFrame, key: Sequence[str] = ("row_id",)) -> DataFrame:
    return tokens.filter(F.col("pos") == 0).select(*key, doubles(F.col("vec")).alias("vec"))


def embed(states: DataFrame, layers: int | Sequence[int] = 1, n_total: int = 1, how: str = "mean",
          pool: str | None = "mean") -> DataFrame:
    """Layer choice, merge and optional pooling in one call."""
    picked = pick_layers(states, layers, n_total)
    single = layers == 1 or (not isinstance(layers, int) and len(layers) == 1)
    merged = (picked.select("row_id", "pos", "mask", doubles(F.col("vec")).alias("vec")) if single
              else merge_layers(picked, how))
    if pool is None:
        return merged
    return {"mean": mean_pool, "cls": first_pool}[pool](merged)


def last_token(tokens: DataFrame, padding_side: str = "right") -> DataFrame:
    """State of the last real token: the highest position left-padded, else the highest unmasked one."""
    live = tokens if padding_side == "left" else tokens.filter(F.col("mask") > 0)
    return live.groupBy("row_id").agg(F.max_by(doubles(F.col("vec")), "pos").alias("vec"))
