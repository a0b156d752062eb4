"""Built-in word tokenizer: a word keeps the white space before it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

WORD = r"\s*\S+"             # fixed value
SPACE = " \t\n\x0b\f\r"      # fixed value: what \s matches above

OFFSETS_TYPE = "array<struct<start:int,end:int>>"
SPAN_TOKENS = 1 << 16        # tokens whose spans are worked out at a time, or one longer list


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def truncate(tokens: Column, limit: int) -> Column:
    return F.slice(tokens, 1, limit)


def offsets(tokens: Column) -> Column:
    """Character span of every token; the white space before it is not part of it.

    A running sum over an array has no built-in, and folding one with
    ``aggregate`` measured twice as slow as this Arrow pass over the batch.
    """
    return F.arrow_udf(_token_spans, OFFSETS_TYPE)(tokens)


def _token_spans(tokens: pa.Array) -> pa.Array:
    """The spans of a batch, a few lists at a time, so that what is in memory besides the batch and its spans is bounded."""
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype="int64")])
    starts, ends = np.empty(bounds[-1], "int32"), np.empty(bounds[-1], "int32")
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SPAN_TOKENS, side="right")) - 1)
        flat = tokens.slice(at, to - at).flatten()
        part = slice(bounds[at], bounds[to])
        end = np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False), dtype="int64")
        before = np.concatenate([[0], end])[bounds[at:to] - bounds[at]]
        end -= np.repeat(before, sizes[at:to])
        ends[part] = end
        starts[part] = end - pc.utf8_length(pc.utf8_ltrim(flat, SPACE)).to_numpy(zero_copy_only=False)
        at = to
    spans = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends)], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype("int32")), spans)


def attention_mask(n: Column, length: Column) -> Column:
    """1 for the first ``n`` of ``length`` positions, then 0."""
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), length - 1),
                                          lambda p: (p < n).cast("int"))
                  ).otherwise(F.expr("cast(array() as array<int>)"))
