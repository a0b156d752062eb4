"""N-gram Jaccard self-join by parity sketches.

A set of shingle hashes is cut by hash range into groups; the XOR of a group's hashes is its
parity word. One differing shingle changes one group, so sets that differ in at most D shingles
share all but D of their groups, and of the first D + 1 filled groups in any fixed order at
least one is shared. Texts meet on those groups within a size band (sizes up to a power of
two). What meets is tested on parity bit sketches, whose Hamming distance never exceeds the
symmetric difference, and then on the shingle sets themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from procspark.llm.bytescan import BLANK_SPLIT, U64, Chunk, Words, as_long, columns, mix, scan, with_fields
from procspark.llm.graph import components
from procspark.llm.store import row_key, stash

SHINGLE = 5
THRESHOLD = 75  # per cent
SKETCH_WORDS = 16
#: Texts whose shingles are counted to see which are frequent, and the count from which one is; this only orders
#: groups and never changes a result.
SAMPLE, FREQUENT, MOST_FREQUENT = 8000, 3, 200_000
#: Pivots that a text meets in a round, and the share of open members above which rounds have done what they can.
PIVOTS, SETTLED = 8, 0.7
_COUNT_BITS = 8


def shingle_set(words: Words, doc: int, k: int, runs: np.ndarray) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles of a text; a shorter text is one shingle."""
    a, b = int(words.bounds[doc]), int(words.bounds[doc + 1])
    if b - a >= k:
        return np.unique(runs[a:b - k + 1])
    if b == a:
        return np.zeros(0, U64)
    h = words.hashes[a:b]
    odd = np.arange(1, 2 * (b - a), 2).astype(U64) * U64(0x9E3779B97F4A7C15) | U64(1)
    return mix(np.array([np.sum(h * odd) + U64(b - a)], U64))


def set_node(s: np.ndarray) -> int:
    """One hash for a set: equal sets, and in practice only those, have equal nodes."""
    both = np.array([np.sum(mix(s)), np.bitwise_xor.reduce(s), U64(len(s))], U64)
    return int(mix(both[:1] + mix(both[1:2] + both[2:]))[0])


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits: bit i is the parity of the number of hashes that fall on it."""
    bits = np.bincount((s % U64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def most_differing(a: int, b: int, threshold: int) -> int:
    """Largest symmetric difference of sets of sizes a and b that link."""
    # i >= t u / 100 and a + b = u + i give u - i <= (100 - t) (a + b) / (100 + t)
    return (100 - threshold) * (a + b) // (100 + threshold)


def groups_in_band(top: int, threshold: int) -> int:
    """Groups for sets of up to ``top`` shingles: a few more than can differ, many for tiny sets."""
    full = most_differing(top, top, threshold)
    return max(full * 115 // 100 + 3, min(2 * top + 8, 40))


def band_keys(s: np.ndarray, threshold: int, frequent: np.ndarray | None = None) -> list[np.ndarray]:
    """Join keys of a set: for its own size band, and for the next if a partner can lie there."""
    n = len(s)
    level = (n - 1).bit_length()
    biggest = 100 * n // threshold
    rare = np.ones(n, bool)
    if frequent is not None and len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s
    out = [_keys(s, rare, level, most_differing(n, min(1 << level, biggest), threshold), threshold)]
    if biggest > 1 << level:
        out.append(_keys(s, rare, level + 1, most_differing(n, biggest, threshold), threshold))
    return out


def _keys(s: np.ndarray, rare: np.ndarray, level: int, differ: int, threshold: int) -> np.ndarray:
    k = groups_in_band(1 << level, threshold)
    group = ((s >> U64(32)) * U64(k)) >> U64(32)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    count = np.diff(np.append(first, len(s)))
    parity = np.bitwise_xor.reduceat(mix(s), first)
    key = mix(parity + mix(group[first] * U64(64) + U64(level + 1)))
    if len(key) <= differ:  # all filled groups may differ: such sets also meet on their band
        return np.append(key, mix(np.array([level], U64) + U64(1 << 40)))
    # groups with rare shingles first, of those the ones with more: they are met by chance least
    weight = np.minimum(np.add.reduceat(rare.astype(np.int64), first), 15) * 16 + np.minimum(count, 15)
    order = (U64(255) - weight.astype(U64) << U64(64 - _COUNT_BITS)) | (key >> U64(_COUNT_BITS))
    return key[np.argpartition(order, differ)[: differ + 1]] if len(key) > differ + 1 else key


def shingle_table(docs: DataFrame, k: int) -> DataFrame:
    """The columns of docs without ``text``, with n_shingles, node (null without words) and the sketch words s0, s1 ..."""
    rest = [c for c in docs.columns if c != "text"]

    def work(chunk: Chunk) -> dict:
        words = chunk.words(BLANK_SPLIT)
        runs, n, node = words.runs(k), np.zeros(chunk.n, np.int64), np.zeros(chunk.n, U64)
        bits = np.zeros((chunk.n, SKETCH_WORDS), np.int64)
        for d in np.flatnonzero(words.counts):
            s = shingle_set(words, d, k, runs)
            n[d], node[d], bits[d] = len(s), set_node(s), sketch(s)
        held = columns(chunk)
        return {c: held[c] for c in rest} | {"n_shingles": n, "node": pa.array(as_long(node), mask=n == 0)} | {
            f"s{i}": bits[:, i].copy() for i in range(SKETCH_WORDS)}

    return scan(docs, work, with_fields(docs.select(*rest), "n_shingles long, node long" + "".join(
        f", s{i} long" for i in range(SKETCH_WORDS))))


def frequent_shingles(docs: DataFrame, table: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that several texts of a bounded sample have."""
    some = table.select("node", "_row").orderBy(F.xxhash64("node"), "_row").limit(SAMPLE).select("_row")
    texts = docs.join(F.broadcast(some), "_row", "left_semi")  # at most SAMPLE longs

    def work(chunk: Chunk) -> dict:
        words = chunk.words(BLANK_SPLIT)
        runs = words.runs(k)
        sets = [shingle_set(words, d, k, runs) for d in np.flatnonzero(words.counts)]
        return {"shingle": as_long(np.concatenate([*sets, np.zeros(0, U64)]))}

    counts = scan(texts.select("text"), work, "shingle long").groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r.shingle for r in top], np.int64).view(U64))


def key_table(docs: DataFrame, k: int, threshold: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(key, node) of every text; copies within a chunk are folded."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT longs

    def work(chunk: Chunk) -> dict | None:
        words = chunk.words(BLANK_SPLIT)
        runs, keys, nodes, seen = words.runs(k), [], [], set()
        for d in np.flatnonzero(words.counts):
            s = shingle_set(words, d, k, runs)
            node = set_node(s)
            if node not in seen:
                seen.add(node)
                for x in band_keys(s, threshold, held.value):
                    keys.append(x)
                    nodes.append(np.full(len(x), node, U64))
        if not keys:
            return None
        return {"key": as_long(np.concatenate(keys)), "node": as_long(np.concatenate(nodes))}

    return scan(docs, work, "key long, node long")


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """(node, raw): the shingle sets of texts as bytes."""
    def work(chunk: Chunk) -> dict | None:
        words = chunk.words(BLANK_SPLIT)
        runs = words.runs(k)
        sets = [shingle_set(words, d, k, runs) for d in np.flatnonzero(words.counts)]
        if not sets:
            return None
        return {"node": as_long(np.array([set_node(s) for s in sets], U64)), "raw": [s.tobytes() for s in sets]}

    return scan(docs, work, "node long, raw binary")


def _near(a: str, b: str, threshold: int) -> Column:
    """Sizes and sketches allow a link; a and b are structs of (n, s0, s1 ...)."""
    x, y = F.col(f"{a}.n"), F.col(f"{b}.n")
    far = F.lit(0)
    for i in range(SKETCH_WORDS):
        far += F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")))
    return (F.least(x, y) * 100 >= F.greatest(x, y) * threshold) & (far * (100 + threshold) <= (x + y) * (100 - threshold))


def likely(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches allow; nodes has (node, sk)."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("sk").alias(f"sk_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_near("sk_a", "sk_b", threshold)).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose sets link; sets has (node, raw)."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("raw").alias(f"raw_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "raw_a", "raw_b")

    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U64) for c in ("raw_a", "raw_b"))
                shared = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
                keep[i] = 100 * shared >= threshold * (len(x) + len(y) - shared)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def node_links(docs: DataFrame, table: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(node, comp) of the sets that link with another. docs has (_row, text), table that of `shingle_table`.

    Members of a key meet one of them, its pivot, and what links is contracted; a key whose members are one component
    is settled. Rounds with other pivots follow while they settle a good part of what is open. In the keys that
    are left each member outside the pivot's component meets all members of other components, so no link between
    components is lost and no group is paired with itself. That join tests the sketches as it goes and makes only
    the pairs that pass.
    """
    nodes = stash(table.select("node", "_row", F.struct(F.col("n_shingles").alias("n"), *[
        f"s{i}" for i in range(SKETCH_WORDS)]).alias("sk")).dropDuplicates(["node"]), "nodes")
    keys = key_table(docs.select("text"), k, threshold, frequent_shingles(docs, nodes, k))
    first = F.first("node").over(Window.partitionBy("key").orderBy("node").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))  # streams through one sort
    met = stash(keys.withColumn("pivot", first).where("node <> pivot").dropDuplicates(["key", "node"]), "met")
    near = met.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links, sets = _links(likely(near, nodes, threshold), docs, nodes, None, k, threshold)
    comps = components(links)
    members = met.select("key", "node").union(met.select("key", F.col("pivot").alias("node")).distinct())
    members, outside = _open(members, comps, 0)
    last = None
    while True:
        now = outside.count()
        if not now:
            return comps
        if last is not None and now > SETTLED * last:
            break
        last = now
        near = outside.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
        found, sets = _links(likely(near, nodes, threshold), docs, nodes, sets, k, threshold)
        links = links.union(found)
        comps = components(links)
        members, outside = _open(members.select("key", "node"), comps, now)

    sketches = nodes.select("node", "sk")
    a = outside.join(sketches, "node").select("key", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("sk").alias("sk_a"))
    b = members.join(sketches, "node").select(
        F.col("key").alias("key_b"), F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("sk").alias("sk_b"))
    rest = a.join(b, (F.col("key") == F.col("key_b")) & (F.col("ca") != F.col("cb")) & _near("sk_a", "sk_b", threshold))
    rest = rest.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    found, _ = _links(rest, docs, nodes, sets, k, threshold)
    return components(links.union(found))


def _open(members: DataFrame, comps: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, node, comp, pivot, home) of keys with several components, and those outside the pivot's one.

    The pivot of a key is a random node of its largest component within the key, by a hash that few keys share.
    """
    placed = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min(
        F.struct(F.xxhash64("node", F.lit(seed), F.pmod("key", F.lit(PIVOTS))), "node")).alias("p"))
    best = sizes.groupBy("key").agg(F.max(F.struct("n", "comp", F.col("p.node").alias("pivot"))).alias("t"), F.count("*").alias("c"))
    best = best.where("c > 1").select("key", F.col("t.comp").alias("home"), F.col("t.pivot").alias("pivot"))
    both = stash(placed.join(best, "key"), "open")
    return both, both.where("comp <> home")


def _links(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, sets: DataFrame | None, k: int,
           threshold: int) -> tuple[DataFrame, DataFrame]:
    """The pairs that link, and the sets known so far. Only texts of these pairs are fetched, and each once."""
    close = stash(pairs, "close")
    needed = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if sets is not None:
        needed = needed.join(sets.select("node"), "node", "left_anti")
    rows = stash(nodes.join(needed, "node", "left_semi").select("_row"), "rows")
    new = stash(set_table(docs.join(rows, "_row", "left_semi").select("text"), k).dropDuplicates(["node"]), "sets")
    sets = new if sets is None else sets.union(new)
    return stash(verified(close, sets, threshold), "links"), sets


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SHINGLE,
                       threshold: int = THRESHOLD) -> DataFrame:
    """(id, _row, n_shingles, component_id), a row for each row of docs; ``_row`` is `store.row_key`.

    Words are lower-cased (A-Z) and split at space and 0x09-0x0D. Two texts link when 100 * |A and B| >=
    threshold * |A or B| for their sets of k-word shingles, a shorter text being one shingle; component_id is
    the smallest id reachable. Null, empty and blank texts have no shingles, link with nothing and keep their
    own id. Repeated rows link like any equal texts. Rows with a null id take part; a component that has no
    other id has a null component_id. Other columns of docs are neither read nor returned.
    """
    docs = docs.select(F.col(id_col), row_key(id_col, text), F.col(text).alias("text"))
    table = stash(shingle_table(docs, k), "table")
    comps = node_links(docs.select("_row", "text"), table.where("node is not null"), k, threshold)
    placed = table.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = placed.where("comp is not null").groupBy("comp").agg(F.min(id_col).alias("component_id"))
    return (placed.join(ids, "comp", "left").withColumn("component_id", F.when(
        F.col("comp").isNull(), F.col(id_col)).otherwise(F.col("component_id")))
        .select(id_col, "_row", "n_shingles", "component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one row of each component: the smallest id's. Texts without words all stay; of rows with equal
    id and text one stays."""
    found = jaccard_components(docs, id_col, text, **how)
    first = found.where("n_shingles > 0").groupBy("component_id").agg(
        F.min_by("_row", F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("_row"))).alias("_row"))
    keep = first.select("_row").union(found.where("n_shingles = 0").select("_row")).distinct()
    return (docs.withColumn("_row", row_key(id_col, text)).join(keep, "_row", "left_semi")
            .dropDuplicates(["_row"]).drop("_row"))
