"""Linear class heads over stored vectors."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from procspark.functions.tiles import chunk_rows, grid, shape_of, tiles
from procspark.functions.vectors import doubles, matrix, mean_vector

HEAD_BYTES = 8_000_000  # class vectors that every task may hold


def class_means(df: DataFrame, label: str = "label", vec: str = "vec", task: str = "task") -> DataFrame:
    """(task, class_idx, vec): the mean vector of each class."""
    return df.groupBy(task, F.col(label).alias("class_idx")).agg(mean_vector(doubles(F.col(vec))).alias("vec"))


def head_logits(df: DataFrame, heads: DataFrame, vec: str = "vec", task: str = "task",
                row_id: str = "row_id", max_bytes: int = HEAD_BYTES, tile_rows: int | None = None) -> DataFrame:
    """Add ``logits``: the row's vector times the class vectors of its task, in class order.

    ``vec`` becomes doubles; rows of a task without head, or without vector, get null. The size of ``heads`` is
    looked up once. Up to ``max_bytes`` its vectors go to the tasks as one matrix per task. Beyond that rows and classes
    meet in tiles and each row's slices of logits are put together, which shuffles what it returns; where metrics are
    asked only, ``head_stats`` does not. Both ways give the same rows. Row ids may repeat across tasks.
    """
    slim = heads.select(task, "class_idx", doubles(F.col("vec")).alias("w"))
    src = df.withColumn(vec, doubles(F.col(vec)))
    size = slim.agg(F.coalesce(F.sum(F.size("w") * 8 + 16), F.lit(0))).first()[0]
    if size > max_bytes:
        slices = _in_tiles(src, slim, vec, task, row_id, None, tile_rows, _slices, "classes array<int>, logits array<double>")
        part = F.arrays_zip(F.col("classes").alias("c"), F.col("logits").alias("l"))
        whole = slices.groupBy(*_keys(task, row_id)).agg(F.sort_array(F.flatten(F.collect_list(part))).alias("_l"))
        return _joined(src, whole.select(*_keys(task, row_id), F.col("_l.l").alias("logits")), vec, task, row_id)
    by_task: dict = {}
    for r in sorted(slim.collect(), key=lambda r: r["class_idx"]):
        by_task.setdefault(r[task], []).append(r["w"])
    weights = {t: np.array(w) for t, w in by_task.items()}

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(batch.schema.get_field_index(vec))
            size = np.zeros(batch.num_rows, int)
            found = []
            for t, at in _rows_by_task(batch.column(batch.schema.get_field_index(task)), col):
                if t in weights:
                    size[at] = len(weights[t])
                    found.append((at, matrix(col.take(pa.array(at))) @ weights[t].T))
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = np.empty(ends[-1])
            for at, x in found:
                flat[ends[at][:, None] + np.arange(x.shape[1])] = x
            lists = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(flat), mask=pa.array(size == 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "logits"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema)
    return src.mapInArrow(score, f"{schema}, logits array<double>")


def head_stats(df: DataFrame, heads: DataFrame, vec: str = "vec", task: str = "task", row_id: str = "row_id",
               labels: str = "labels", tile_rows: int | None = None) -> DataFrame:
    """Add ``preds`` (class with the largest logit, the lowest on ties), ``max_logit`` and ``loss`` (cross-entropy of ``labels``).

    Rows and classes of any number meet in tiles, hashed by row and by class and never by task. A tile gives each of its
    rows one line: its best class, the logit of its label and its log-sum-exp; lines of a row merge to one, so
    logits are never shuffled. A row without vector or head gets nulls, one whose label has no class a null loss.
    """
    slim = heads.select(task, "class_idx", doubles(F.col("vec")).alias("w"))
    src = df.withColumn(vec, doubles(F.col(vec)))
    parts = _in_tiles(src, slim, vec, task, row_id, labels, tile_rows, _summaries, "top double, best int, lse double, own double")
    best = F.max(F.struct("top", (-F.col("best")).alias("neg")))
    merged = parts.groupBy(*_keys(task, row_id, "_label")).agg(best.alias("_b"), F.collect_list("lse").alias("_s"), F.max("own").alias("_own"))
    high = F.array_max("_s")
    total = high + F.log(F.aggregate("_s", F.lit(0.0), lambda a, x: a + F.exp(x - high)))
    return _joined(src.withColumn("_label", F.col(labels).cast("int")), merged.select(
        *_keys(task, row_id, "_label"), (-F.col("_b.neg")).alias("preds"), F.col("_b.top").alias("max_logit"),
        (total - F.col("_own")).alias("loss")), vec, task, row_id, ["_label"]).drop("_label")


def _rows_by_task(names: pa.Array, vecs: pa.Array):
    """(task, places) of the rows that have a vector."""
    coded = names.dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    there = vecs.is_valid().to_numpy(zero_copy_only=False)
    for i, t in enumerate(coded.dictionary.to_pylist()):
        at = np.flatnonzero((code == i) & there)
        if len(at):
            yield t, at


def _keys(task: str, row_id: str, *more: str) -> list[str]:
    return [task, row_id, "_vec", *more]


def _in_tiles(df: DataFrame, heads: DataFrame, vec: str, task: str, row_id: str, labels: str | None, tile_rows: int | None,
              work, schema: str) -> DataFrame:
    """``work`` on the logits (rows, classes) of each task in each tile; rows are told apart by task, id and vector."""
    label = [] if labels is None else [F.col(labels).cast("int").alias("_label")]
    rows = (df.where(F.col(vec).isNotNull() & F.col(task).isNotNull())
            .select(task, row_id, F.xxhash64(vec).alias("_vec"), *label, F.col(vec).alias("_x")))
    keys = _keys(task, row_id, *(["_label"] if label else []))
    rows = rows.dropDuplicates(keys).withColumn("_key", F.xxhash64(*keys))
    classes = heads.select(F.col(task).alias("_task"), "class_idx", "w", F.xxhash64(task, "class_idx").alias("_key"))
    n_x, n_y, dims = shape_of(rows, classes.withColumnRenamed("w", "_x"), F.lit(1), F.size("_x"))
    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys]
    names = [*keys, *[f.split()[0] for f in schema.split(", ")]]
    out = StructType.fromDDL(f"{', '.join(kinds)}, {schema}")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for t, at in _rows_by_task(left[task].combine_chunks(), left["_x"].combine_chunks()):
            mine = right.filter(pc.equal(right["_task"], pa.scalar(t, right["_task"].type))).sort_by("class_idx")
            if not mine.num_rows:
                continue
            w, idx = matrix(mine["w"]), mine["class_idx"].to_numpy().astype("int32")
            step = chunk_rows(len(idx))
            for i in range(0, len(at), step):
                own = left.take(pa.array(at[i:i + step])).select([*keys, "_x"])
                found.append(pa.table([*[own[c] for c in keys], *work(matrix(own["_x"]) @ w.T, idx, own)], names=names))
        return pa.concat_tables(found) if found else to_arrow_schema(out).empty_table()

    gx, gy = grid(df.sparkSession, n_x, n_y, dims, tile_rows)
    return tiles(rows, classes, "_key", "_key", gx, gy).applyInArrow(tile, out)


def _slices(x: np.ndarray, idx: np.ndarray, rows: pa.Table) -> list[pa.Array]:
    at = pa.array(np.arange(0, x.size + 1, len(idx), dtype="int32"))
    return [pa.ListArray.from_arrays(at, pa.array(v)) for v in (np.tile(idx, len(x)), np.ascontiguousarray(x).ravel())]


def _summaries(x: np.ndarray, idx: np.ndarray, rows: pa.Table) -> list[pa.Array]:
    best = x.argmax(1)
    top = x[np.arange(len(x)), best]
    label = rows["_label"].to_numpy().astype(float)  # null: nan
    place = np.minimum(np.searchsorted(idx, label), len(idx) - 1)
    own = x[np.arange(len(x)), place]
    return [pa.array(top), pa.array(idx[best]), pa.array(top + np.log(np.exp(x - top[:, None]).sum(1))),
            pa.array(own, mask=idx[place] != label)]


def _joined(df: DataFrame, found: DataFrame, vec: str, task: str, row_id: str, more: Sequence[str] = ()) -> DataFrame:
    keys = _keys(task, row_id, *more)
    got = found.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[c for c in found.columns if c not in keys])
    same = F.lit(True)
    for i, c in enumerate(keys):
        same &= F.col(c).eqNullSafe(F.col(f"_k{i}"))
    new = [c for c in found.columns if c not in keys]
    return df.withColumn("_vec", F.xxhash64(vec)).join(got, same, "left").select(*df.columns, *new)
