"""Hash order, exact positions and exact top-n that never put a group in one task."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

HASH_RANGE = 1 << 32
BUCKETS = 4096
RANGE_ROWS = 1 << 16   # rows of a sampled range
MAX_RANGES = 4096      # ranges of a table, however large: their sizes are read on the driver
RANGE_SAMPLES = 32     # sampled keys for each range
FAN = 64               # bounds that one row is held against at a time
SMALL_TOP_N = 1000  # Spark prunes row_number() <= n before the shuffle up to this n


def hash_order(*cols: Column, seed: int = 0, method: str = "xxhash64") -> Column:
    """Repeatable pseudo-random integer in [0, 2**32) for a seeded shuffle.

    ``md5`` gives the same value in any engine; ``xxhash64`` is faster.
    """
    if method == "md5":
        text = F.concat_ws(":", *[c.cast("string") for c in cols], F.lit(str(seed)))
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(HASH_RANGE))


def hash_bucket(order: Column, buckets: int = BUCKETS) -> Column:
    """Coarse bucket of a ``hash_order`` value that keeps its order."""
    return F.floor(order * buckets / HASH_RANGE).cast("bigint")


def _bucket_starts(df: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Rows before each bucket. One row per (keys, bucket), so its window is small."""
    part = [F.col(k) for k in keys] or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("bigint"))
            .select(*[F.col(k).alias(f"_k_{k}") for k in keys],
                    F.col(bucket).alias("_b"), "_before"))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                  out: str = "position", below: int | None = None) -> DataFrame:
    """0-based position of each row inside its group, in ``order``.

    ``bucket`` must not decrease along ``order``. Rows are ranked inside
    ``(keys, bucket)`` and shifted by the size of the buckets before, so a group
    of any size is spread over its buckets. With ``below`` only rows with a
    smaller position are kept, and buckets past it never reach the sort.
    """
    marked = df.withColumn("_bucket", bucket)
    starts = _bucket_starts(marked, keys, "_bucket")
    if below is not None:
        starts = starts.filter(F.col("_before") < below)
    cond = F.col("_bucket").eqNullSafe(F.col("_b"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    w = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = (marked.join(starts, cond)
              .withColumn(out, F.col("_before") + F.row_number().over(w) - 1)
              .drop("_bucket", "_b", "_before", *[f"_k_{k}" for k in keys]))
    return ranked if below is None else ranked.filter(F.col(out) < below)


def range_bounds(df: DataFrame, key: Column, rows: int = RANGE_ROWS, n: int | None = None, seed: int = 11) -> list:
    """Ascending keys that cut df into ranges of about ``rows`` rows, however its keys are spread.

    Quantiles of a sample of ``RANGE_SAMPLES`` keys for each range; there are at least twice as many ranges
    as cores, as many as shuffle partitions, and at most ``MAX_RANGES``, so the sample is bounded. One job counts, unless ``n`` is known, and
    one samples; they read the key only.
    """
    keys = df.select(key.alias("k")).where("k is not null")
    n = keys.count() if n is None else n
    spark = df.sparkSession
    ranges = min(MAX_RANGES, max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // rows)))
    drawn = keys if n <= ranges * RANGE_SAMPLES else keys.sample(ranges * RANGE_SAMPLES / n, seed)
    found = sorted(drawn.toArrow().column(0).to_pylist())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def range_number(key: Column, bounds: Sequence, kind: str = "bigint") -> Column:
    """How many of the ascending ``bounds`` (of the SQL type ``kind``) are at most ``key``, plus 1; 0 for a null key.

    Up to ``FAN`` bounds are compared at once; more are looked up in two steps. They are one folded literal.
    """
    def fixed(values: list, depth: int = 1) -> Column:
        kinds = ["array<" * depth + k + ">" * depth for k in ("string", kind)]
        return F.from_json(F.lit(json.dumps(values, default=str)), kinds[0]).cast(kinds[1])

    below = lambda some: F.size(F.filter(some, lambda b: b <= key))
    if len(bounds) <= FAN:
        number = below(fixed(list(bounds)))
    else:
        parts = [list(bounds[i:i + FAN]) for i in range(0, len(bounds), FAN)]
        part = below(fixed([p[0] for p in parts[1:]]))
        number = part * FAN + below(F.get(fixed(parts, 2), part))
    return F.when(key.isNull(), 0).otherwise(number + 1)


def with_range_position(df: DataFrame, order: Sequence[Column], out: str = "position", keys: Sequence[str] = (),
                        rows: int = RANGE_ROWS, bounds: Sequence | None = None, total: str | None = None) -> DataFrame:
    """0-based position of each row in ``order``, inside its ``keys`` if there are any; ``total`` names a column for their number.

    The first column of ``order`` (ascending, nulls first, any orderable type) is cut into ranges by ``bounds``,
    sampled from df if not given, so gaps, negative and hashed values cost nothing. Rows are shuffled once by
    range; the sizes of the ranges come from that same shuffle and are added up per key, or without keys (at
    most ``MAX_RANGES`` + 1 numbers) in one array. Rows with equal first columns share a range; rows
    equal in all of ``order`` take their positions in any order.
    """
    bounds = range_bounds(df, order[0], rows) if bounds is None else bounds
    kind = df.select(order[0]).schema[0].dataType.simpleString()
    dealt = df.withColumn("_range", range_number(order[0], bounds, kind)).repartition(*keys, "_range")
    # the sizes read all columns, so that Spark sees the same shuffle below both and runs it once
    whole = F.max(F.xxhash64(*[f.name for f in df.schema if f.dataType.typeName() != "map"]))
    sizes = dealt.groupBy(*keys, "_range").agg(F.when(whole.isNull(), 0).otherwise(F.count(F.lit(1))).alias("_n"))
    w = Window.partitionBy(*keys, "_range").orderBy(*order)
    ranked = dealt.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    if keys:
        ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"),
                              F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"),
                              *([F.sum("_n").over(Window.partitionBy(*keys)).alias(total)] if total else []))
        same = F.col("_range") == F.col("_r")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return ranked.join(starts, same).withColumn(out, F.col(out) + F.col("_before")).select(*df.columns, out, *([total] if total else []))
    by_range = F.map_from_entries(F.collect_list(F.struct("_range", "_n")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(len(bounds) + 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    running = F.aggregate(filled, F.array(F.lit(0).cast("bigint")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    starts = sizes.agg(by_range.alias("m")).select(running.alias("starts")).scalar()
    if total:
        ranked = ranked.withColumn(total, F.element_at(starts, -1))
    return ranked.withColumn(out, F.col(out) + F.get(starts, F.col("_range"))).select(*df.columns, out, *([total] if total else []))


def top_n(df: DataFrame, keys: Sequence[str], order: Column, tie: Column, n: int,
          bucket: Column | None = None) -> DataFrame:
    """First ``n`` rows of every group by (order, tie), all groups at once."""
    if n <= SMALL_TOP_N:
        w = Window.partitionBy(*keys).orderBy(order, tie)
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    bucket = hash_bucket(order) if bucket is None else bucket
    return with_position(df, keys, [order, tie], bucket, "_pos", below=n).drop("_pos")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a source of fewer splits than cores over all cores, before heavy per-row work.

    A source with enough splits is returned as it is, so nothing is shuffled at scale.
    Only the planned number of splits is looked at; nothing runs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
