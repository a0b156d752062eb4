"""Kernel alignment (linear CKA) from partial Gram matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from procspark.functions.vectors import dot, doubles, list_array, matrix, mean_vector, sum_vector


def gram_rows(df: DataFrame, side: str = "side", vec: str = "vec") -> DataFrame:
    """(side, d, row): uncentred moment matrix of ``[v, 1]`` per side, row by row.

    Each task multiplies its own rows and emits one small matrix; the matrices are
    then added up, so the rows themselves are never shuffled. Row and column
    ``d = dims`` hold the plain sums and the count.
    """
    def partial(batches):
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            sides = batch.column(0).to_numpy(zero_copy_only=False)
            v = matrix(batch.column(1))
            for s in np.unique(sides):
                a = v[sides == s]
                a = np.hstack([a, np.ones((len(a), 1))])
                acc[int(s)] = acc.get(int(s), 0) + a.T @ a
        for s, g in acc.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(g), s, dtype="int32")), pa.array(np.arange(len(g), dtype="int32")),
                 list_array(g)], ["side", "d", "row"])

    parts = df.select(F.col(side).cast("int").alias("side"), doubles(F.col(vec)).alias("vec")).mapInArrow(
        partial, "side int, d int, row array<double>")
    return parts.groupBy("side", "d").agg(sum_vector(F.col("row")).alias("row"))


def cka(df: DataFrame, side: str = "side", vec: str = "vec", centre: bool = True) -> DataFrame:
    """CKA of side 0 against side 1, each centred by its own mean.

    Uses ``|Xc Yc'|^2 = <Xc'Xc, Yc'Yc>``, so only dims * dims matrices meet, never
    rows with rows. A side of one row is not centred. Both sides need equal dims. Where a side
    is constant or zero there is no alignment, and the value is null.
    """
    g = gram_rows(df, side, vec)
    dims = F.size("row") - 1
    last = g.filter(F.col("d") == dims).select("side", F.col("row").alias("sums"))
    n = F.get("sums", dims)
    own = F.get("row", dims)  # plain sum of dimension d
    shift = F.when((n > 1) & F.lit(centre), own / n).otherwise(0.0)
    rows = (g.filter(F.col("d") < dims).join(last, "side")
            .select("side", "d", F.slice(F.zip_with("row", "sums", lambda a, s: a - shift * s), F.lit(1), dims)
                    .alias("g")))
    # one value per (side, d): both sides side by side without reading the rows twice
    paired = rows.groupBy("d").agg(*[
        F.max(F.when(F.col("side") == i, F.col("g"))).alias(c) for i, c in ((0, "gx"), (1, "gy"))])
    return (paired
            .agg(F.sum(dot(F.col("gx"), F.col("gy"))).alias("xy"), F.sum(dot(F.col("gx"), F.col("gx"))).alias("xx"),
                 F.sum(dot(F.col("gy"), F.col("gy"))).alias("yy"))
            .select(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("cka")))


def cka_grouped(pairs: DataFrame, group: str = "a", pos: str = "b", x: str = "x", y: str = "y",
                reduction: str | None = "mean") -> DataFrame:
    """CKA inside each group of aligned rows, centred per position over the groups.

    ``|X'Y|^2 / (|X'X| |Y'Y|)`` per ``group``; null where a side of a group is zero. ``reduction`` is mean, sum, max or
    min over groups, or None for one row per group. Rows of a group that come together in a task and are more
    than their dimensions are folded to moment matrices before the shuffle, so a group of any size sends what
    its tasks can make of it, and it is never in memory as a whole.
    """
    src = pairs.select(group, pos, doubles(F.col(x)).alias("_x"), doubles(F.col(y)).alias("_y"))
    means = src.groupBy(pos).agg(mean_vector(F.col("_x")).alias("_mx"), mean_vector(F.col("_y")).alias("_my"),
                                 F.count(F.lit(1)).alias("_n"))
    rows = src.join(means, pos).select(group, *[
        F.when(F.col("_n") > 1, F.zip_with(v, m, lambda p, q: p - q)).otherwise(F.col(v)).alias(v)
        for v, m in (("_x", "_mx"), ("_y", "_my"))])
    kind = rows.schema[group].dataType.simpleString()
    folded = rows.mapInArrow(_fold_groups, f"`{group}` {kind}, n int, _x array<double>, _y array<double>, moments array<double>")
    per_group = (folded.repartition(group).sortWithinPartitions(group)
                 .mapInArrow(_align_groups, f"`{group}` {kind}, cka double"))
    if reduction is None:
        return per_group
    return per_group.agg({"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[reduction]("cka").alias("cka"))


def _moments(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a.T @ b, a.T @ a, b.T @ b])


def _fold_groups(batches):
    """(group, n, x, y, moments): the rows of a batch by group, as rows end to end or, if they are many, as moments."""
    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode(null_encoding="encode")
        code = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        a, b = (matrix(batch.column(i))[order] for i in (1, 2))
        ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))])
        out: list[list] = [[], [], [], []]
        for s, e in zip(ends[:-1], ends[1:]):
            many = e - s > a.shape[1]
            for to, v in zip(out, (e - s, None if many else a[s:e].ravel(), None if many else b[s:e].ravel(),
                                   _moments(a[s:e], b[s:e]).ravel() if many else None)):
                to.append(v)
        lists = [pa.array(v, pa.list_(pa.float64())) for v in out[1:]]
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(out[0], pa.int32()), *lists],
                                         [batch.schema.names[0], "n", "_x", "_y", "moments"])


def _align_groups(batches):
    """(group, cka) from rows in the order of the group; only the group at hand is held, as moments."""
    last, total, name, kind = None, None, None, None

    def done(keys: list, values: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(values, pa.float64())], [name, "cka"])

    def value(m: np.ndarray) -> float | None:
        xy, xx, yy = (np.linalg.norm(v) for v in m)
        return float(xy**2 / (xx * yy)) if xx * yy > 0 else None

    for batch in batches:
        name, kind = batch.schema.names[0], batch.column(0).type
        keys, values = [], []
        groups = batch.column(0).to_pylist()
        sizes = batch.column(1).to_numpy()
        for i, g in enumerate(groups):
            if batch.column(4).is_valid()[i].as_py():
                flat = batch.column(4)[i].values.to_numpy()
                part = flat.reshape(3, int((len(flat) // 3) ** 0.5), -1)
            else:
                part = _moments(*(batch.column(c)[i].values.to_numpy().reshape(sizes[i], -1) for c in (2, 3)))
            if total is not None and g == last:
                total = total + part
                continue
            if total is not None:
                keys.append(last)
                values.append(value(total))
            last, total = g, part
        if keys:
            yield done(keys, values)
    if total is not None:
        yield done([last], [value(total)])
