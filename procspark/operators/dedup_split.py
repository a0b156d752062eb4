"""Keyed dedup, group-disjoint splits and seeded sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from procspark.functions.ranking import HASH_RANGE, MAX_RANGES, hash_order, top_n, with_range_position

DEDUP_BASE = ("revision_id", "model_id", "unique_activities")
DEDUP_OPTIONAL = ("trace", "eventually_follows", "prefix")
SPLIT_PARTS = 1000
TEST_PARTS, VAL_PARTS = 100, 180  # 10 % test, then 20 % of the rest for validation


def drop_copies(df: DataFrame, keys: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Keep the row with the smallest ``row_id`` of every key.

    A grouped min_by, not a ranking window: copies are folded before the shuffle,
    so a key with very many copies sends one row per map task.
    """
    rest = [c for c in df.columns if c not in keys and c != row_id]
    kept = [F.min_by(c, row_id).alias(c) for c in rest]
    return df.groupBy(*keys).agg(F.min(row_id).alias(row_id), *kept).select(*df.columns)


def remove_duplicates(df: DataFrame, row_id: str = "row_id", set_text: str | None = None) -> DataFrame:
    """Dedup on model, activity set and whichever of trace / pair / prefix exists.

    ``set_text`` names a column with the set as raw text to compare instead of
    the sorted array, so two spellings of one set are two keys.
    """
    base = [set_text if (set_text and c == "unique_activities") else c for c in DEDUP_BASE]
    return drop_copies(df, base + [c for c in DEDUP_OPTIONAL if c in df.columns], row_id)


def deduplicate_traces(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return drop_copies(df, ["model_id", "revision_id", "trace"], row_id)


def group_id(model_id: str = "model_id", revision_id: str = "revision_id") -> Column:
    return F.concat_ws("_", F.col(model_id).cast("string"), F.col(revision_id).cast("string"))


def keep_multi_activity(df: DataFrame, compat: str | None = None) -> DataFrame:
    """Drop models with fewer than two activities.

    ``compat="charlen"`` is for a set still kept as text: it counts characters,
    as a load that filters before parsing does.
    """
    size = F.length("unique_activities") if compat == "charlen" else F.size("unique_activities")
    return df.withColumn("num_unique_activities", size).filter(F.col("num_unique_activities") > 1)


def split_by_ids(df: DataFrame, id_split: DataFrame, compat: str | None = None) -> DataFrame:
    """Add ``id`` and ``split`` from an ``(id, split)`` table; ids in no list are dropped.

    No broadcast hint: Spark broadcasts the list when its size allows it and
    otherwise splits a hot id by its skew-join rule.
    """
    return keep_multi_activity(df.withColumn("id", group_id()), compat).join(
        id_split.select("id", "split"), "id")


def overlapping_ids(id_split: DataFrame) -> DataFrame:
    """Ids that stand in more than one list; empty when the split is sound."""
    return (id_split.groupBy("id").agg(F.countDistinct("split").alias("n_splits"))
            .filter(F.col("n_splits") > 1))


def hash_split(df: DataFrame, seed: int = 4, method: str = "xxhash64", id_col: str = "id",
               test_parts: int = TEST_PARTS, val_parts: int = VAL_PARTS) -> DataFrame:
    """Random split by group id without any shuffle: all rows of an id agree."""
    part = F.floor(hash_order(F.col(id_col), seed=seed, method=method) * SPLIT_PARTS / HASH_RANGE)
    return df.withColumn("split", F.when(part < test_parts, "test")
                         .when(part < test_parts + val_parts, "val").otherwise("train"))


def select_split(df: DataFrame, split: str, unknown: str = "test") -> DataFrame:
    """Rows of one split. An unknown name means test, or every row with ``unknown="all"``."""
    if split in ("train", "val"):
        return df.filter(F.col("split") == split)
    if split != "test" and unknown == "all":
        return df
    return df.filter(F.col("split") == "test")


def balanced_sample(df: DataFrame, label: str, n: int, by: Sequence[str] = ("split",), seed: int = 4,
                    row_id: str = "row_id", method: str = "xxhash64") -> DataFrame:
    """Up to ``n`` rows of each class of each split, in seeded order."""
    marked = df.withColumn("_h", hash_order(F.col(row_id), seed=seed, method=method))
    return top_n(marked, [*by, label], F.col("_h"), F.col(row_id), n).drop("_h")


def few_shot(df: DataFrame, shots: int, seed: int = 0, row_id: str = "row_id",
             method: str = "xxhash64") -> DataFrame:
    """Seeded shuffle, then the first ``shots`` rows."""
    return df.orderBy(hash_order(F.col(row_id), seed=seed, method=method), F.col(row_id)).limit(shots)


def head(df: DataFrame, n: int = 16, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(row_id).limit(n)


def epoch_key(epoch: int, seed: int = 0, row_id: str = "row_id", method: str = "xxhash64") -> Column:
    """What an epoch sorts its rows by, before the row id."""
    return hash_order(F.col(row_id), F.lit(epoch), seed=seed, method=method)


def epoch_shuffle(df: DataFrame, epoch: int, seed: int = 0, row_id: str = "row_id",
                  method: str = "xxhash64") -> DataFrame:
    """Training order of one epoch: a range-partitioned sort on a seeded hash."""
    return df.orderBy(epoch_key(epoch, seed, row_id, method), F.col(row_id))


def epoch_positions(df: DataFrame, epoch: int, seed: int = 0, row_id: str = "row_id", method: str = "xxhash64",
                    out: str = "position") -> DataFrame:
    """The place of each row in the order of ``epoch_shuffle``; a hash needs no sampled bounds."""
    key = df.withColumn("_h", epoch_key(epoch, seed, row_id, method))
    n = min(MAX_RANGES, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = [HASH_RANGE * i // n for i in range(1, n)]
    return with_range_position(key, [F.col("_h"), F.col(row_id)], out, bounds=bounds).drop("_h")


def task_batches(df: DataFrame, batch_size: int, task: str = "task", row_id: str = "row_id",
                 bounds: Sequence | None = None) -> DataFrame:
    """``batch_id`` per task; batches of all tasks with one id form a training step.

    ``bounds``: keys that cut the row ids into ranges, where they are known without computing df twice.
    """
    return (with_range_position(df, [F.col(row_id)], "_pos", [task], bounds=bounds)
            .withColumn("batch_id", F.floor(F.col("_pos") / batch_size).cast("bigint")).drop("_pos"))
