"""All-against-all scoring, reduced where it is computed.

Every x must meet every y. Both sides are hashed into blocks and each (x block,
y block) tile is one bounded co-group: scores exist only inside a tile's numpy
arrays, and what leaves it is one row per x (rank parts, best match, sum) or the
k best per x. The n * n score matrix is never a table. A tile of neighbour lists
gives its rows a block of scores at a time, as k lists can be more than its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from procspark.functions.tiles import CHUNK_CELLS, Shape, chunk_rows, grid, shape_of, tile_rows_of, tiles
from procspark.functions.vectors import cosine, doubles, matrix, mean_vector, unit_rows

TIE_DIGITS = 10          # scores equal to this many digits are ties

PART_SCHEMA = ("x_id bigint, true_score double, n_ahead bigint, best_score double, best_id bigint, "
               "score_sum double, n bigint")
TOP_SCHEMA = "x_id bigint, y_ids array<bigint>, scores array<double>, labels array<int>"


def _part_rows(ids, true_scores, y_ids, scores) -> pa.Table:
    """Reduce one score block (x rows * y rows, y in id order) to one row per x."""
    s = np.round(scores, TIE_DIGITS)
    t = np.round(true_scores, TIE_DIGITS)[:, None]
    before = y_ids[None, :] < ids[:, None]
    ahead = ((s > t) | ((s == t) & before)) & (y_ids[None, :] != ids[:, None])
    best = np.argmax(s, axis=1)
    return pa.table({
        "x_id": ids, "true_score": true_scores, "n_ahead": ahead.sum(axis=1).astype("int64"),
        "best_score": s[np.arange(len(ids)), best], "best_id": y_ids[best], "score_sum": scores.sum(axis=1),
        "n": np.full(len(ids), len(y_ids), dtype="int64")})


def _fold_parts(parts: DataFrame) -> DataFrame:
    best = F.max(F.struct("best_score", (-F.col("best_id")).alias("neg_id")))
    return (parts.groupBy("x_id")
            .agg(F.max("true_score").alias("true_score"), (F.sum("n_ahead") + 1).alias("true_rank"),
                 best.alias("b"), F.sum("score_sum").alias("score_sum"), F.sum("n").alias("n"))
            .select("x_id", "true_score", "true_rank", F.col("b.best_score").alias("best_score"),
                    (-F.col("b.neg_id")).alias("best_id"), "score_sum", "n"))


def cosine_ranks(x: DataFrame, y: DataFrame, tile_rows: int | None = None, shape: Shape | None = None) -> DataFrame:
    """Cosine of every x against every y, folded to one row per x.

    Inputs: ``(pair_id, vec)`` per side; equal ``pair_id`` is the true match. Output:
    ``x_id, true_score, true_rank, best_score, best_id, score_sum, n``. The tiles are sized by
    ``shape`` (rows of x, rows of y, dimensions), which is counted first if not given.
    """
    n_x, n_y, dims = shape or shape_of(x, y, F.lit(1), F.size("vec"))
    gx, gy = grid(x.sparkSession, n_x, n_y, dims, tile_rows)
    ys = y.select("pair_id", doubles(F.col("vec")).alias("vec"))
    pairs = x.select("pair_id", doubles(F.col("vec")).alias("vec")).join(
        ys.select("pair_id", F.col("vec").alias("true_vec")), "pair_id")
    xs = pairs.select("pair_id", "vec", cosine(F.col("vec"), F.col("true_vec")).alias("own"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _empty(PART_SCHEMA)
        right = right.sort_by("pair_id")
        ids, y_ids = left["pair_id"].to_numpy(), right["pair_id"].to_numpy()
        a, b = (unit_rows(matrix(c)) for c in (left["vec"], right["vec"]))
        own = left["own"].to_numpy()
        step = chunk_rows(len(y_ids))
        return pa.concat_tables([_part_rows(ids[i:i + step], own[i:i + step], y_ids, a[i:i + step] @ b.T)
                                 for i in range(0, len(ids), step)])

    return _fold_parts(tiles(xs, ys, "pair_id", "pair_id", gx, gy).applyInArrow(score, PART_SCHEMA))


def _empty(ddl: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    return pa.schema([pa.field(n, kinds[t]) for n, t in fields]).empty_table()


def _token_matrix(col) -> tuple[np.ndarray, np.ndarray]:
    """Column of token-vector lists -> stacked unit vectors and first row of each sentence."""
    arr = col.combine_chunks()
    sizes = arr.value_lengths().to_numpy(zero_copy_only=False)
    return unit_rows(matrix(arr.flatten())), np.concatenate([[0], np.cumsum(sizes)])


def _bert_block(a, a_at, b, b_at) -> np.ndarray:
    """BERTScore F of each x sentence with each y sentence (both as stacked tokens)."""
    s = a @ b.T
    best_y = np.maximum.reduceat(s, b_at[:-1], axis=1)                  # x token * y sentence
    x_score = np.add.reduceat(best_y, a_at[:-1], axis=0) / np.diff(a_at)[:, None]
    best_x = np.maximum.reduceat(s, a_at[:-1], axis=0)                  # x sentence * y token
    y_score = np.add.reduceat(best_x, b_at[:-1], axis=1) / np.diff(b_at)[None, :]
    both = x_score + y_score
    return np.divide(2 * x_score * y_score, both, out=np.zeros_like(both), where=both != 0)


def sentences(tokens: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, vecs): the unmasked token vectors of a sentence in order."""
    return (tokens.filter(F.col("mask") > 0).groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("pos", doubles(F.col("vec")).alias("vec")))).alias("_t"))
            .select(key, F.col("_t.vec").alias("vecs")))


def _padded(m: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, token, dimension) of some sentences and which of the tokens are there."""
    size = at[rows + 1] - at[rows]
    there = np.arange(size.max(initial=1)) < size[:, None]
    return m[np.where(there, at[rows][:, None] + np.arange(there.shape[1]), at[rows][:, None])], there


def _pair_scores(a, a_at, b, b_at) -> np.ndarray:
    """BERTScore F of sentence k of a with sentence k of b, for sentences of like lengths at a time."""
    n, out = len(a_at) - 1, np.zeros(len(a_at) - 1)
    longest = np.maximum(np.diff(a_at), np.diff(b_at))
    order = np.argsort(longest, kind="stable")
    i = 0
    while i < n:
        j = i + 1  # sentences of up to twice the length of the first, within the cells
        top = int(np.searchsorted(longest[order], 2 * longest[order[i]], side="right"))
        width = int(longest[order[top - 1]])
        j = min(top, max(i + 1, i + CHUNK_CELLS // max(1, width * max(width, a.shape[1]))))
        rows = order[i:j]
        (x, in_x), (y, in_y) = _padded(a, a_at, rows), _padded(b, b_at, rows)
        s = np.where(in_x[:, :, None] & in_y[:, None, :], x @ y.transpose(0, 2, 1), -np.inf)
        best_y, best_x = np.where(in_x, s.max(2), 0).sum(1) / in_x.sum(1), np.where(in_y, s.max(1), 0).sum(1) / in_y.sum(1)
        both = best_y + best_x
        out[rows] = np.divide(2 * best_y * best_x, both, out=np.zeros_like(both), where=both != 0)
        i = j
    return out


def bert_score_ranks(x: DataFrame, y: DataFrame, tile_tokens: int | None = None, shape: Shape | None = None) -> DataFrame:
    """As ``cosine_ranks`` with token-level BERTScore F as the score.

    Inputs: ``(pair_id, vecs)`` with at least one token per sentence; ``shape`` counts tokens.
    """
    n_x, n_y, dims = shape or shape_of(x, y, F.size("vecs"), F.size(F.get("vecs", F.lit(0))))
    gx, gy = grid(x.sparkSession, n_x, n_y, dims, tile_tokens)
    ys = y.select("pair_id", "vecs")
    pairs = x.select("pair_id", F.col("vecs").alias("x_vecs")).join(ys.select("pair_id", F.col("vecs").alias("y_vecs")), "pair_id")
    xs = bert_score_pairs(pairs, keep_x=True).select("pair_id", F.col("x_vecs").alias("vecs"), F.col("bert_score").alias("own"))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _empty(PART_SCHEMA)
        right = right.sort_by("pair_id")
        ids, y_ids = left["pair_id"].to_numpy(), right["pair_id"].to_numpy()
        (a, a_at), (b, b_at) = (_token_matrix(c) for c in (left["vecs"], right["vecs"]))
        own = left["own"].to_numpy()
        out, i, step = [], 0, chunk_rows(len(b))
        while i < len(ids):  # whole sentences, about ``step`` tokens at a time
            j = max(i + 1, int(np.searchsorted(a_at, a_at[i] + step, side="right")) - 1)
            block = _bert_block(a[a_at[i]:a_at[j]], a_at[i:j + 1] - a_at[i], b, b_at)
            out.append(_part_rows(ids[i:j], own[i:j], y_ids, block))
            i = j
        return pa.concat_tables(out)

    return _fold_parts(tiles(xs, ys, "pair_id", "pair_id", gx, gy).applyInArrow(score, PART_SCHEMA))


def bert_score_pairs(pairs: DataFrame, x: str = "x_vecs", y: str = "y_vecs", keep_x: bool = False) -> DataFrame:
    """BERTScore F of the two sentences in each row, which have at least one token each."""
    ids = [c for c in pairs.columns if c != y and (keep_x or c != x)]

    def score(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            (a, a_at), (b, b_at) = _token_matrix(table[x]), _token_matrix(table[y])
            f = _pair_scores(a, a_at, b, b_at)
            yield from table.select(ids).append_column("bert_score", pa.array(f)).to_batches()

    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in ids)
    return pairs.mapInArrow(score, f"{schema}, bert_score double")


def _mrr() -> Column:
    return F.avg(1.0 / F.col("true_rank")).alias("mrr")


def _acc() -> Column:
    return F.avg((F.col("best_id") == F.col("x_id")).cast("double")).alias("acc")


def _mean() -> Column:
    return F.try_divide(F.sum("score_sum"), F.sum("n")).alias("mean_score")


def mean_reciprocal_rank(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranks.groupBy(*by).agg(_mrr())


def retrieval_accuracy(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ranks.groupBy(*by).agg(_acc())


def mean_score(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the whole score matrix."""
    return ranks.groupBy(*by).agg(_mean())


def retrieval_report(ranks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``mrr``, ``acc`` and ``mean_score`` from one pass over the ranks."""
    return ranks.groupBy(*by).agg(_mrr(), _acc(), _mean())


def mean_cosine(x: DataFrame, y: DataFrame) -> DataFrame:
    """Cosine of the two side means, both from one aggregate over the stacked sides; 0 where a mean is zero."""
    def side(df: DataFrame, wx: float) -> DataFrame:
        return df.select(doubles(F.col("vec")).alias("vec"), F.lit(wx).alias("wx"), F.lit(1.0 - wx).alias("wy"))

    means = side(x, 1.0).unionByName(side(y, 0.0)).agg(
        mean_vector(F.col("vec"), F.col("wx")).alias("a"), mean_vector(F.col("vec"), F.col("wy")).alias("b"))
    return means.select(cosine(F.col("a"), F.col("b")).alias("mean_cosine"))


def _k_largest(s: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k largest per row; of equal scores at the edge the leftmost ones."""
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    above, equal = s > edge, s == edge
    room = k - above.sum(axis=1, keepdims=True)
    return above | (equal & (np.cumsum(equal, axis=1, dtype="int32") <= room))


def _lists(ids, sizes: np.ndarray, y_ids, scores, labels) -> pa.Table:
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("int32"))
    return pa.table({"x_id": ids, **{n: pa.ListArray.from_arrays(at, pa.array(v)) for n, v in (
        ("y_ids", y_ids), ("scores", scores), ("labels", labels))}})


MERGED = 128  # targets whose lists are merged at a time


def _merged(k: int):
    """Several sorted lists of a target to its k best, lower ids first among ties; a batch of targets at a time."""
    def run(batches):
        for batch in (whole.slice(i, MERGED) for whole in batches for i in range(0, whole.num_rows, MERGED)):
            outer = batch.column(1)
            parts = outer.flatten()
            each = np.repeat(np.arange(len(outer)), outer.value_lengths().to_numpy(zero_copy_only=False))
            y, s, lab = (parts.field(i) for i in range(3))
            row = np.repeat(each, y.value_lengths().to_numpy(zero_copy_only=False))
            y, s, lab = (c.flatten().to_numpy(zero_copy_only=False) for c in (y, s, lab))
            order = np.lexsort((y, -s, row))
            row = row[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            keep = order[nth < k]
            sizes = np.bincount(row[nth < k], minlength=len(outer))
            yield from _lists(batch.column(0), sizes, y[keep], s[keep], lab[keep].astype("int32")).to_batches()

    return run


def neighbour_lists(targets: DataFrame, sources: DataFrame, k: int, tile_rows: int | None = None,
                    shape: Shape | None = None) -> DataFrame:
    """(x_id, y_ids, scores, labels): the ``k`` sources closest to each target as sorted lists.

    ``targets``: ``(x_id, vec)``; ``sources``: ``(y_id, vec, label)``. Each tile gives one row a target with its exact k
    best, lower ids first among ties. Source blocks are wide, so mostly there is one; the lists of several are merged by
    target, one row for each (target, block) in that shuffle.
    """
    n_x, n_y, dims = shape or shape_of(targets, sources, F.lit(1), F.size("vec"))
    gx, gy = grid(targets.sparkSession, n_x, n_y, dims, tile_rows, wide_y=True)
    xs = targets.select("x_id", doubles(F.col("vec")).alias("vec"), F.lit(None).cast("int").alias("label"))
    ys = sources.select("y_id", doubles(F.col("vec")).alias("vec"), F.col("label").cast("int").alias("label"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for batch in batches:
            of_y = batch.column("is_y").to_numpy(zero_copy_only=False)
            for side, mask in ((left, ~of_y), (right, of_y)):
                if mask.any():
                    part = batch.filter(pa.array(mask))
                    side.append((part.column("id").to_numpy(), unit_rows(matrix(part.column("vec"))), part.column("label").to_numpy(zero_copy_only=False)))
        if not left or not right:
            return
        y_ids = np.concatenate([part[0] for part in right])
        labels = np.concatenate([part[2] for part in right])
        order = np.argsort(y_ids, kind="stable")
        y_ids, labels = y_ids[order], labels[order].astype("int32")
        place, b, at = np.argsort(order, kind="stable"), np.empty((len(order), right[0][1].shape[1])), 0
        while right:
            part = right.pop(0)[1]
            b[place[at:at + len(part)]] = part
            at += len(part)
        m, step = min(k, len(y_ids)), chunk_rows(len(y_ids))
        for ids, a, _ in left:
            for i in range(0, len(ids), step):
                s = a[i:i + step] @ b.T
                np.round(s, TIE_DIGITS, out=s)
                col = np.nonzero(_k_largest(s, m))[1].reshape(len(s), m)
                score = np.take_along_axis(s, col, 1)
                best = np.argsort(-score, axis=1, kind="stable")
                col, score = (np.take_along_axis(v, best, 1).ravel() for v in (col, score))
                yield from _lists(ids[i:i + step], np.full(len(s), m), y_ids[col], score, labels[col]).to_batches()

    found = tile_rows_of(xs, ys, "x_id", "y_id", gx, gy).applyInArrow(nearest, TOP_SCHEMA)
    if gy == 1:
        return found
    lists = found.groupBy("x_id").agg(F.collect_list(F.struct("y_ids", "scores", "labels")).alias("parts"))
    return lists.mapInArrow(_merged(k), TOP_SCHEMA)


def top_sources(targets: DataFrame, sources: DataFrame, k: int, tile_rows: int | None = None,
                shape: Shape | None = None) -> DataFrame:
    """As ``neighbour_lists``, one row for each neighbour: (x_id, y_id, score, label, rank)."""
    lists = neighbour_lists(targets, sources, k, tile_rows, shape)
    rows = lists.select("x_id", F.posexplode(F.arrays_zip("y_ids", "scores", "labels")).alias("_at", "n"))
    return rows.select("x_id", F.col("n.y_ids").alias("y_id"), F.col("n.scores").alias("score"), F.col("n.labels").alias("label"),
                       (F.col("_at") + 1).alias("rank"))


KNN_SIZES = (1, 3, 10, 25, 50, 100, 250, 500, 1000)  # fixed values
VOTE_CELLS = 4_000_000  # counts (target, label) in memory at once
VOTE_LABELS = 500_000   # labels of lists walked at a time, or one longer list


def _bounded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists (the second column) have about ``VOTE_LABELS`` entries."""
    ends, at = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False), dtype="int64"), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + VOTE_LABELS, side="right")))
        yield batch.slice(at, to - at)
        at = to


def knn_vote(neighbours: DataFrame, ks: Sequence[int] = KNN_SIZES) -> DataFrame:
    """(x_id, k, pred): most frequent label of the k nearest, the lowest on ties.

    ``neighbours`` as ``neighbour_lists`` gives them, or rows of ``top_sources``, which are put in lists first. All k
    are counted in one walk along the list. A k past the number of sources uses all.
    """
    if "labels" not in neighbours.columns:
        neighbours = neighbours.groupBy("x_id").agg(F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("n")).select(
            "x_id", F.col("n.label").alias("labels"))
    sizes = sorted(set(ks))

    def votes(flat: np.ndarray, length: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """(target, k) winners; flat holds class numbers."""
        row = np.repeat(np.arange(len(length)), length)
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
        counts, out, at = np.zeros(len(length) * len(classes), int), [], 0
        for k in sizes:
            new = (nth >= at) & (nth < k)
            counts += np.bincount(row[new] * len(classes) + flat[new], minlength=len(counts))
            out.append(classes[counts.reshape(len(length), -1).argmax(1)])
            at = k
        return np.stack(out, 1)

    def run(batches):
        for batch in (part for whole in batches for part in _bounded(whole)):
            lists = batch.column(1)
            length = lists.value_lengths().to_numpy(zero_copy_only=False)
            classes, flat = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            ends = np.concatenate([[0], np.cumsum(length)])
            step = max(1, VOTE_CELLS // max(1, len(classes)))
            won = np.concatenate([votes(flat[ends[i]:ends[min(i + step, len(length))]], length[i:i + step], classes)
                                  for i in range(0, len(length), step)])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(np.arange(len(length)), len(sizes)))),
                pa.array(np.tile(np.array(sizes, "int32"), len(length))), pa.array(won.ravel().astype("int32"))], ["x_id", "k", "pred"])

    kind = neighbours.schema["x_id"].dataType.simpleString()
    return neighbours.select("x_id", "labels").where(F.size("labels") > 0).mapInArrow(run, f"x_id {kind}, k int, pred int")


def scatter(positions: DataFrame, preds: DataFrame, keys: Sequence[str], fill: int) -> DataFrame:
    """Predictions back at all positions; those without one get ``fill``."""
    return positions.join(preds, list(keys), "left").withColumn("pred", F.coalesce("pred", F.lit(fill)))
