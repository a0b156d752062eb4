"""Tiles of two sides that must meet row by row: bounded co-groups of hashed blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Shape = tuple[int, int, int]

TILE_BYTES = 64 << 20    # vectors per side of a tile, as doubles
MIN_BLOCK = 1024         # smaller blocks are not worth a task
TILES_PER_CORE = 4
CHUNK_CELLS = 1_000_000  # scores in memory at once


def blocks(n_rows: int, per_block: int) -> int:
    return max(1, -(-n_rows // per_block))


def per_block_rows(n_rows: int, dims: int, wanted: int) -> int:
    """Rows per block for about ``wanted`` blocks, inside the byte bound."""
    return min(max(1, TILE_BYTES // (8 * max(dims, 1))), max(MIN_BLOCK, blocks(n_rows, wanted)))


def grid(spark: SparkSession, n_x: int, n_y: int, dims: int, per_block: int | None,
          wide_y: bool = False) -> tuple[int, int]:
    """Blocks per side: a few tiles per core, each within the byte bound.

    ``wide_y`` makes the y blocks as large as the bound allows and splits x instead.
    """
    if per_block:
        return blocks(n_x, per_block), blocks(n_y, per_block)
    tiles = TILES_PER_CORE * spark.sparkContext.defaultParallelism
    square = math.isqrt(tiles) + 1
    gy = blocks(n_y, per_block_rows(n_y, dims, 1 if wide_y else square))
    gx = blocks(n_x, per_block_rows(n_x, dims, blocks(tiles, gy) if wide_y else square))
    return gx, gy


def shape_of(x: DataFrame, y: DataFrame, n: Column, dims: Column) -> Shape:
    """Rows (or tokens) of both sides and vector length: three numbers from one job."""
    side = lambda df, i: df.select(F.lit(i).alias("i"), n.alias("n"), dims.alias("d"))
    got = side(x, 0).unionByName(side(y, 1)).agg(
        *[F.sum(F.when(F.col("i") == i, F.col("n"))).alias(f"n{i}") for i in (0, 1)], F.max("d").alias("d")).first()
    return got.n0 or 0, got.n1 or 0, got.d or 1


def chunk_rows(width: int) -> int:
    return max(1, CHUNK_CELLS // max(width, 1))


def _tiled(x: DataFrame, y: DataFrame, x_key: str, y_key: str, gx: int, gy: int) -> tuple[DataFrame, DataFrame]:
    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    return (x.withColumn("_bx", block(x_key, gx)).withColumn("_by", every(gy)),
            y.withColumn("_by", block(y_key, gy)).withColumn("_bx", every(gx)))


def tiles(x: DataFrame, y: DataFrame, x_key: str, y_key: str, gx: int, gy: int):
    """Co-groups (x block, y block); each side is repeated once per block of the other."""
    xs, ys = _tiled(x, y, x_key, y_key, gx, gy)
    return xs.groupBy("_bx", "_by").cogroup(ys.groupBy("_bx", "_by"))


def tile_rows_of(x: DataFrame, y: DataFrame, x_key: str, y_key: str, gx: int, gy: int):
    """As ``tiles``, but the rows of both sides in one group, with ``id`` for the key and ``is_y``; the sides have the same other columns.

    A function of batches may give the rows of such a group bit by bit, which that of a co-group can't.
    """
    xs, ys = _tiled(x, y, x_key, y_key, gx, gy)
    xs = xs.withColumnRenamed(x_key, "id").withColumn("is_y", F.lit(False))
    return xs.unionByName(ys.withColumnRenamed(y_key, "id").withColumn("is_y", F.lit(True))).groupBy("_bx", "_by")
