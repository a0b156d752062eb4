"""Merkle manifest of a dataset from concatenated level strings.

The leaves of a source stand in blocks of ``RUN ** LEVELS`` places. A block keeps each of its levels as one string of
hex digests: fixed-width substrings of a level are hashed to the next one, and the substrings that flank a node are
its siblings. The blocks' roots are the leaves of the next round, and the sources' roots those of the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from procspark.functions.ranking import with_range_position
from procspark.llm.store import stash

#: Fixed value: nodes hashed together. Levels in a block, which bounds its strings to 64 * RUN ** LEVELS characters.
RUN, LEVELS = 3, 5
WIDTH = 64
FLANKS = "array<struct<l:string,r:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _next_level(level: Column) -> Column:
    last = F.floor((F.length(level) - 1) / (RUN * WIDTH)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda j: F.sha2(
        F.substring(level, j * (RUN * WIDTH) + 1, F.lit(RUN * WIDTH)).cast("binary"), 256)), "")


def _siblings(levels: Column, used: Column, place: Column) -> Column:
    """(left, right) flanks of the node above ``place`` on each used level of a block, bottom first."""
    size = F.array(*[F.lit(RUN**i) for i in range(LEVELS)])

    def flanks(i: Column) -> Column:
        level, node = F.get(levels, i), F.floor(place / F.get(size, i)).cast("int")
        nth = node % RUN
        return F.struct(F.substring(level, (node - nth) * WIDTH + 1, nth * WIDTH).alias("l"),
                        F.substring(level, (node + 1) * WIDTH + 1, (RUN - 1 - nth) * WIDTH).alias("r"))

    return F.when(used > 0, F.transform(F.sequence(F.lit(0), used - 1), flanks)).otherwise(F.array().cast(FLANKS))


def own_roots(tops: DataFrame) -> DataFrame:
    return tops.select("tree", F.array().cast(FLANKS).alias("up"), F.col("hash").alias("root"), F.col("hash").alias("whole"))


def climb(nodes: DataFrame, above: Callable[[DataFrame], DataFrame] = own_roots) -> DataFrame:
    """The blocks of nodes, with ``up``, the flanks from a block's top to the whole, ``root`` of its tree, and ``whole``.

    nodes: ``tree`` (not null), ``pos`` from 0 without gaps in each tree, ``size``, the tree's nodes, ``hash``, ``payload``.
    above: gives (tree, up, root, whole) of the trees' (tree, hash). Each round groups at most ``RUN ** LEVELS`` nodes by tree and
    block, never by tree, and leaves one in so many, so the rounds grow with the logarithm of the
    largest tree only. Levels are made again where they are read, and not stored.
    """
    block = F.floor(F.col("pos") / RUN**LEVELS).cast("bigint").alias("block")
    grouped = nodes.select("tree", block, "size", F.struct("pos", "hash", "payload").alias("n")).groupBy("tree", "block").agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list("n")).alias("nodes"))
    grouped = stash(grouped, "blocks")
    deep = sum(((F.col("size") > RUN**i).cast("int") for i in range(LEVELS)), F.lit(0))  # levels until one node is left
    blocks = grouped.withColumn("used", deep).withColumn("l0", F.array_join("nodes.hash", ""))
    for i in range(LEVELS):
        blocks = blocks.withColumn(f"l{i + 1}", F.when(F.col("used") > i, _next_level(F.col(f"l{i}"))).otherwise(F.col(f"l{i}")))
    tops = blocks.select("tree", "block", "size", F.col(f"l{LEVELS}").alias("hash"))
    blocks = blocks.select("tree", "block", "nodes", "used", F.array(*[F.col(f"l{i}") for i in range(LEVELS)]).alias("levels"))
    if not grouped.where("block > 0").take(1):
        return blocks.join(above(tops.select("tree", "hash")), "tree")
    nodes = tops.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / RUN**LEVELS).cast("bigint").alias("size"), "hash",
                        F.lit(None).cast("int").alias("payload"))
    over = nodes_of(climb(nodes, above)).select("tree", F.col("pos").alias("block"), F.col("path").alias("up"), "root", "whole")
    return blocks.join(over, ["tree", "block"])


def nodes_of(blocks: DataFrame) -> DataFrame:
    """One row a node: tree, pos, hash, payload, ``path`` with the flanks up to the whole, root, whole."""
    inner = F.transform("nodes", lambda n: F.struct(
        n["pos"].alias("pos"), n["hash"].alias("hash"), n["payload"].alias("payload"),
        _siblings(F.col("levels"), F.col("used"), (n["pos"] % RUN**LEVELS).cast("int")).alias("own")))
    rows = blocks.select("tree", "up", "root", "whole", F.inline(inner))
    return rows.select("tree", "pos", "hash", "payload", F.concat("own", "up").alias("path"), "root", "whole")


def source_roots(tops: DataFrame) -> DataFrame:
    """The sources as leaves of one tree: (tree, up, root, whole) of each."""
    ranked = with_range_position(stash(tops, "sources"), [F.col("tree")], "pos", total="size")
    top = nodes_of(climb(ranked.select(F.lit("").alias("tree"), "pos", "size", "hash", F.struct(F.col("tree").alias("of")).alias("payload"))))
    return top.select(F.col("payload.of").alias("tree"), F.col("path").alias("up"), F.col("hash").alias("root"), "whole")


def merkle_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, source root, root and proof of every row of docs (``FIELDS``), and the root folded from the ``tampered`` text.

    A row whose ``tampered`` text is not null is folded from the leaf with that text, others from their own
    leaf, each with the original siblings; ``verified`` tells whether the fold gives the root. Nulls are written as ``-``,
    the null source comes first and apart from an empty one; equal rows take neighbouring leaves, and rows of one id go by their leaf. Other
    columns are left out. An empty table gives no rows.
    """
    other = F.lit(None).cast("string") if tampered is None else tampered
    head = F.concat(*[field(F.col(c)) for c in FIELDS[:-1]])
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))
    rows = stash(docs.select("doc_id", tree.alias("tree"), digest(head, field(F.col("text"))).alias("hash"),
                             F.when(other.isNotNull(), digest(head, field(other))).alias("tampered")), "leaves")
    placed = with_range_position(rows, [F.col("doc_id"), F.col("hash")], "pos", ["tree"], total="size")
    leaves = nodes_of(climb(placed.select("tree", "pos", "size", "hash", F.struct("doc_id", "tampered").alias("payload")), source_roots))
    folded = F.aggregate("path", F.coalesce("payload.tampered", "hash"), lambda h, s: F.sha2(F.concat(s["l"], h, s["r"]).cast("binary"), 256))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "")
    return leaves.select(F.col("payload.doc_id").alias("doc_id"), F.col("hash").alias("leaf"), F.col("root").alias("subroot"),
                         F.col("whole").alias("root"), digest(proof).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def without_newlines() -> Column:
    """The tampered text of rows whose id has an even checksum: their text without line ends; null for the others."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
