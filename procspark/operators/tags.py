"""Token tags: remapping, alignment to sub-tokens, entity spans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from procspark.functions.arrays import IGNORE, argmax, let

# Tag names in class order.
NER_TAGS = ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"]
NER_TAGS_WITH_DATES = NER_TAGS + ["B-DATE", "I-DATE"]
POS_TAGS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON",
            "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]

SPAN = "struct<type:string,start:int,end:int>"


def remap_tags(tags: Column, n_classes: int = len(NER_TAGS)) -> Column:
    """Tags past the last class become 0."""
    return F.transform(tags, lambda t: F.when(t < n_classes, t).otherwise(F.lit(0).cast("int")))


def label_ids(names: Column, label2id: Mapping[str, int]) -> Column:
    table = F.create_map(*[x for k, v in label2id.items() for x in (F.lit(k), F.lit(v))])
    return F.transform(names, lambda n: F.element_at(table, n))


def align_labels(word_ids: Column, labels: Column, label_all: bool = True,
                 ignore: int = IGNORE) -> Column:
    """Word labels -> sub-token labels; a null word id is ignored, as are later
    pieces of a word unless ``label_all``."""
    def one(words: Column):
        def label(w: Column, i: Column) -> Column:
            new = ~w.eqNullSafe(F.get(words, i - 1)) | (i == 0)
            return (F.when(w.isNull(), ignore)
                    .when(new | F.lit(label_all), F.get(labels, w)).otherwise(ignore))
        return F.transform(words, label)
    return let(word_ids, one)


def align_table(df: DataFrame, column_names: Mapping[str, str], label_all: bool = True,
                word_ids: str = "word_ids", label2id: Mapping[str, int] | None = None) -> DataFrame:
    """``labels`` column from the word-level columns named in ``column_names``."""
    if not {"text", "label"} <= set(column_names):
        raise ValueError("column_names needs the keys 'text' and 'label'")
    source = F.col(column_names["label"])
    if label2id is not None and df.schema[column_names["label"]].dataType.elementType.typeName() == "string":
        source = label_ids(source, label2id)
    return df.withColumn("labels", align_labels(F.col(word_ids), source, label_all))


class ChunkRules:
    """Where entity chunks begin and end in a batch of tag sequences.

    A chunk starts at B/S, at a type change, or at I/E after an outside tag; tags
    without a prefix count as chunks of equal neighbours. This runs on whole Arrow
    batches: as nested array expressions it measured twenty times slower.
    """

    def __init__(self, names: Sequence[str]):
        self.names = list(names)
        split = [(n[:1], n[1:].split("-", 1)[-1] or "_") for n in names] + [("O", "_")]
        self.kind = np.array([k for k, _ in split])
        self.types = sorted({t for _, t in split})
        self.type = np.array([self.types.index(t) for _, t in split])

    def find(self, ids: np.ndarray, sizes: np.ndarray):
        """Per position of every sequence plus one closing outside tag: does a chunk
        end just before it, of which type, and where that chunk began."""
        first = np.cumsum(sizes + 1) - (sizes + 1)
        seq = np.insert(ids, np.cumsum(sizes), len(self.names))
        kind, typ = self.kind[seq], self.type[seq]
        before_kind, before_type = np.roll(kind, 1), np.roll(typ, 1)
        before_kind[first], before_type[first] = "O", -1
        differs = before_type != typ
        ends = (np.isin(before_kind, ["E", "S"])
                | (np.isin(before_kind, ["B", "I"]) & np.isin(kind, ["B", "S", "O"]))
                | (~np.isin(before_kind, ["O", "."]) & differs))
        starts = (np.isin(kind, ["B", "S"])
                  | (np.isin(before_kind, ["E", "S", "O"]) & np.isin(kind, ["E", "I"]))
                  | (~np.isin(kind, ["O", "."]) & differs))
        row_start = np.repeat(first, sizes + 1)
        latest = np.maximum.accumulate(np.where(starts, np.arange(len(seq)), -1))
        begin = np.maximum(np.roll(latest, 1), row_start)
        begin[first] = first
        return ends, before_type, begin - row_start, np.arange(len(seq)) - row_start - 1


def _scored(ids: pa.Array, labels: pa.Array):
    """Flat ids and labels without ignored positions, and how many each row keeps.

    Rows are paired position by position up to the shorter of their lists; a null list is empty.
    """
    kept = []
    n_ids, n_labels = (a.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for a in (ids, labels))
    n = np.minimum(n_ids, n_labels)
    for a, own in ((ids, n_ids), (labels, n_labels)):
        first = np.concatenate([[0], np.cumsum(own)[:-1]])
        at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        kept.append(a.drop_null().flatten().to_numpy(zero_copy_only=False)[at] if n.sum() else np.zeros(0, np.int64))
    p, y = kept
    row = np.repeat(np.arange(len(n)), n)
    keep = y != IGNORE
    return p[keep], y[keep], np.bincount(row[keep], minlength=len(n))


def entity_spans(ids: Column, labels: Column, names: Sequence[str]) -> Column:
    """Chunks of ``ids`` as array<struct<type, start, end>>, end inclusive; positions
    whose label is ignored do not count."""
    rules = ChunkRules(names)

    def spans(i: pa.Array, y: pa.Array) -> pa.Array:
        kept, _, sizes = _scored(i, y)
        ends, typ, begin, last = rules.find(kept, sizes)
        per_row = np.bincount(np.repeat(np.arange(len(sizes)), sizes + 1)[ends], minlength=len(sizes))
        items = pa.StructArray.from_arrays(
            [pa.array(np.array(rules.types, dtype=object)[typ[ends]], pa.string()),
             pa.array(begin[ends].astype("int32")), pa.array(last[ends].astype("int32"))],
            ["type", "start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype("int32")), items)

    return F.arrow_udf(spans, f"array<{SPAN}>")(ids, labels)


def entity_counts(preds: Column, labels: Column, names: Sequence[str]) -> Column:
    """struct<tp, pred, gold> of one row: chunks that agree in type and both ends."""
    rules = ChunkRules(names)

    def counts(i: pa.Array, y: pa.Array) -> pa.Array:
        p, g, sizes = _scored(i, y)
        p_ends, p_type, p_begin, _ = rules.find(p, sizes)
        g_ends, g_type, g_begin, _ = rules.find(g, sizes)
        rows = np.repeat(np.arange(len(sizes)), sizes + 1)
        both = p_ends & g_ends & (p_type == g_type) & (p_begin == g_begin)
        return pa.StructArray.from_arrays(
            [pa.array(np.bincount(rows[m], minlength=len(sizes)).astype("int64")) for m in (both, p_ends, g_ends)],
            ["tp", "pred", "gold"])

    return F.arrow_udf(counts, "struct<tp:bigint,pred:bigint,gold:bigint>")(preds, labels)


def entity_f1(df: DataFrame, preds: str, labels: str, names: Sequence[str],
              by: Sequence[str] = ()) -> DataFrame:
    """Micro F1 over entity chunks; ``preds`` holds class ids or one logit list per token."""
    pred_type = df.schema[preds].dataType.elementType.typeName()
    ids = F.transform(preds, argmax) if pred_type == "array" else F.col(preds)
    counts = df.select(*by, entity_counts(ids, F.col(labels), names).alias("c"))
    total = counts.groupBy(*by).agg(*[F.coalesce(F.sum(f"c.{x}"), F.lit(0)).alias(x)
                                      for x in ("tp", "pred", "gold")])
    return total.withColumn("f1", F.coalesce(
        F.try_divide(2.0 * F.col("tp"), (F.col("pred") + F.col("gold")).cast("double")), F.lit(0.0)))
