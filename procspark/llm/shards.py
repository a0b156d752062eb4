"""Shards of near equal size by sampled splitters.

Keys are sampled in proportion to the size of their rows, quantiles of the sample cut the key order into ranges, and
ranges that turn out overfull are sampled again and cut. Running sums within a range and the exact sizes of the
ranges before it then give every row its place in the whole order, and with it its shard and slot.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from procspark.functions.ranking import MAX_RANGES, RANGE_ROWS, range_number
from procspark.llm.store import stash

#: Ranges for each shard at least; sampled keys for each range; a range is overfull from so many times its share on.
RANGES_A_SHARD, SAMPLES, OVERFULL = 16, 16, 2
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def sort_key(df: DataFrame, id_col: str, *more: Column) -> Column:
    """A string that sorts as the id (null first) and then as the given non-negative longs."""
    c = F.col(id_col)
    whole = isinstance(df.schema[id_col].dataType, IntegralType)
    text = F.lpad(F.hex(c.cast("bigint").bitwiseXOR(F.lit(-2**63))), 16, "0") if whole else c.cast("string")
    return F.concat(F.coalesce(F.concat(F.lit("v"), text), F.lit("")), F.lit("\0"),
                    *[F.lpad(F.hex(m), 16, "0") for m in more])


def drawn(df: DataFrame, rate: float, seed: int) -> list[tuple[str, float]]:
    """(key, weight) of a sample, ascending: a row is drawn with the chance size * rate and stands for 1 / rate bytes,
    or for its own size where that is more."""
    chance = F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    rows = df.where(chance < F.col("size") * F.lit(rate)).select("_key", F.greatest("size", F.lit(1 / rate)).alias("w")).toArrow()
    return sorted(zip(rows["_key"].to_pylist(), rows["w"].to_pylist()))


def quantiles(sample: Sequence[tuple[str, float]], pieces: int) -> list[str]:
    """Keys that cut the sample into pieces of near equal weight."""
    total, sums, out, at = sum(w for _, w in sample), 0.0, [], 1
    for key, w in sample:
        while at < pieces and sums + w > total * at / pieces:
            out.append(key)
            at += 1
        sums += w
    return sorted(set(out))


def splitters(rows: DataFrame, total: int, ranges: int, seed: int = 3) -> tuple[list[str], list[tuple[int, int]]]:
    """Bounds of the ranges, and (bytes, rows) before each range by its number.

    rows: ``_key`` (unique), ``size``. Overfull ranges (more than ``OVERFULL`` shares besides their largest row) are
    sampled again at twice the rate, inside them only, until there is none; a cut takes its last key off at least,
    so this ends. At most about ``SAMPLES * ranges`` keys and one line a range reach the driver.
    """
    share = max(total / ranges, 1.0)
    rate = SAMPLES / share
    bounds = quantiles(drawn(rows, rate, seed), ranges)
    while True:
        dealt = rows.withColumn("_range", range_number(F.col("_key"), bounds, "string"))
        found = {r["_range"]: r for r in dealt.groupBy("_range").agg(
            F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("size").alias("top"),
            F.min("_key").alias("lo"), F.max("_key").alias("hi")).collect()}
        over = [r for r in found.values() if r.b - r.top > OVERFULL * share and r.lo < r.hi]
        if not over:
            last = max(found, default=0)
            before = accumulate((found[i][1:3] if i in found else (0, 0) for i in range(last + 1)),
                                lambda a, b: (a[0] + b[0], a[1] + b[1]), initial=(0, 0))
            return bounds, list(before)
        seed, rate = seed + 1, rate * 2
        sample = drawn(dealt.where(F.col("_range").isin([r["_range"] for r in over])), rate, seed)
        for r in over:
            inside = [x for x in sample if r.lo < x[0] <= r.hi]
            bounds = sorted({*bounds, *(quantiles(inside, -(-r.b // int(share))) or [r.hi])})


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text",
                    keep: Sequence[str] = ()) -> DataFrame:
    """(id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, keep...) of every row.

    A row's size is its text's UTF-8 bytes plus 1. Rows go by id, size and checksum; the shard is that in which the
    middle of the row lies when all sizes are laid end to end, so the law ``bytes`` holds: a shard is off its equal
    part by one row's size at most. Slots number a shard's rows from 0. Null texts have size 1 and checksum 0, null ids come first;
    equal rows are told apart and may change places with each other only. Columns of ``keep`` named as a result are
    left out. An empty table gives no rows, and with few rows some shards stay empty.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col), (F.octet_length(data) + 1).cast("bigint").alias("size"), F.crc32(data).alias("text_crc32"),
                       F.struct(F.lit(0).alias("_"), *keep).alias("_kept"), F.monotonically_increasing_id().alias("_at"))
    rows = stash(slim.select("*", sort_key(docs, id_col, F.col("size"), F.col("text_crc32"), F.col("_at")).alias("_key")).drop("_at"), "rows")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    ranges = min(MAX_RANGES, max(shards * RANGES_A_SHARD, n // RANGE_ROWS))
    bounds, before = splitters(rows.select("_key", "size"), total, ranges)

    def start(i: int) -> Column:
        numbers = F.from_json(F.lit(json.dumps([b[i] for b in before])), "array<bigint>")
        return F.get(numbers, F.col("_range"))

    w = Window.partitionBy("_range").orderBy("_key")
    ahead = F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("_range", range_number(F.col("_key"), bounds, "string")).select(
        "*", ahead.alias("_ahead"), (F.row_number().over(w) - 1).alias("_nth"))
    middle = ((start(0) + F.col("_ahead")) * 2 + F.col("size")) * shards
    placed = stash(placed.withColumn("_middle", middle).select(
        id_col, "size", "text_crc32", "_kept", F.expr(f"int(least(_middle div {max(2 * total, 1)}L, {shards - 1}L))").alias("shard"),
        (start(1) + F.col("_nth")).alias("_place")), "placed")
    first = dict(placed.groupBy("shard").agg(F.min("_place")).collect())
    starts = F.from_json(F.lit(json.dumps([first.get(i, 0) for i in range(shards)])), "array<bigint>")
    return placed.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         (F.col("_place") - F.get(starts, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                         *[F.col("_kept")[c].alias(c) for c in keep if c not in (*RESULT, id_col)])


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text: str = "text",
                 rows_a_file: int = 1_000_000) -> None:
    """Write docs as Parquet, one folder a shard, its files in slot order and none over ``rows_a_file`` rows."""
    found = shard_documents(docs, shards, id_col, text, [c for c in docs.columns if c != id_col])
    part = F.floor(F.col("slot") / rows_a_file)
    dealt = found.drop("law", "grown_shard").withColumn("_part", part).repartition("shard", "_part").sortWithinPartitions("shard", "slot")
    dealt.drop("_part").write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)
