"""Connected components of a link table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from procspark.llm.store import stash


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the smallest node reachable; nodes without a link are not listed.

    Every round points each node to the smallest neighbour of its neighbourhood (large star, then
    small star) until no link changes. A node's links are only ever reduced to a minimum, with
    map-side combine, so a node with very many links costs one row per map task. Null ends and
    self links are ignored; an empty table gives an empty one.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges, seen = stash(edges, "edges"), None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        to = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.join(to, "u").select(F.explode(F.array(*pair)).alias("e")).select("e.*").where("u <> v")
        edges = stash(small.distinct(), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
                edges.select(F.col("v"), F.col("v")).distinct())
        seen = now
