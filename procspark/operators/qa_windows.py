"""Extractive QA inputs: overlapping context windows and answer positions.

A feature is ``[CLS] question [SEP] context-window [SEP]``; with ``context_first``
the context window comes before the question. Positions count from [CLS] = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from procspark.functions.arrays import let
from procspark.functions.text import lstrip
from procspark.functions.tokens import OFFSETS_TYPE, offsets, words

SPECIALS = 3
CLS = 0


def _window_starts(n: Column, width: Column, stride: int) -> Column:
    """First context token of each window; the last window is the first to reach the end. Null without a question."""
    step = width - stride
    checked = F.when(step > 0, step).otherwise(F.raise_error(
        F.lit("question leaves no room for context beyond the stride")).cast("int"))
    last = F.when(n > width, F.ceil((n - width) / checked) * checked).otherwise(F.lit(0))
    return F.when(width.isNotNull(), F.sequence(F.lit(0), last.cast("int"), checked))


def qa_features(df: DataFrame, question: str = "question", context: str = "context",
                example_id: str = "id", max_length: int = 384, stride: int = 128,
                specials: int = SPECIALS, context_first: bool = False) -> DataFrame:
    """One row per window.

    Columns: ``example_id, window_no, context_start, n_context, question_tokens,
    context_tokens, spans`` (character spans of the window's tokens),
    ``context_pos`` (feature position of its first context token), ``n_positions``;
    other columns pass through. The context is cut inside the row: no shuffle.
    """
    keep = [c for c in df.columns if c not in (question, context, example_id)]
    tokens = df.select(F.col(example_id).alias("example_id"), *keep,
                       words(lstrip(F.col(question))).alias("question_tokens"),
                       words(F.col(context)).alias("_words"))
    spanned = (tokens.withColumn("_spans", offsets(F.col("_words")))
               .withColumn("_width", F.lit(max_length - specials) - F.size("question_tokens")))
    windows = spanned.select("*", F.posexplode(_window_starts(
        F.size("_words"), F.col("_width"), stride)).alias("window_no", "context_start"))
    first = F.col("context_start") + 1
    return (windows
            .withColumn("context_tokens", F.slice("_words", first, F.col("_width")))
            .withColumn("spans", F.slice("_spans", first, F.col("_width")))
            .withColumn("n_context", F.size("context_tokens"))
            .withColumn("context_pos", F.lit(1) if context_first else F.size("question_tokens") + 2)
            .withColumn("n_positions", F.size("question_tokens") + F.size("context_tokens") + specials)
            .drop("_words", "_spans", "_width"))


def eval_offsets() -> Column:
    """Offsets per feature position, null where the position is not context."""
    null_at = F.lit(None).cast("struct<start:int,end:int>")
    return F.concat(F.array_repeat(null_at, F.col("context_pos")), F.col("spans"),
                    F.array_repeat(null_at, F.col("n_positions") - F.col("context_pos") - F.col("n_context"))
                    ).cast(OFFSETS_TYPE)


def eval_features(df: DataFrame, **kwargs) -> DataFrame:
    """Windows for scoring: ``offset_mapping`` and ``feature_id`` (example, window)."""
    return (qa_features(df, **kwargs).withColumn("offset_mapping", eval_offsets())
            .withColumn("feature_id", F.concat_ws("#", F.col("example_id").cast("string"),
                                                  F.col("window_no").cast("string"))))


def span_labels(features: DataFrame, answers: str = "answers", compat: bool = False,
                padded_length: int | None = None) -> DataFrame:
    """``start_position`` and ``end_position`` of the first answer in each window.

    No answer, or one not fully inside the window, gives the [CLS] position for
    both. ``compat``: when the answer begins in the window's last context token
    the start runs on to the last position of the feature, padding included.
    """
    spans, pos = F.col("spans"), F.col("context_pos")
    begin = F.get(F.col(f"{answers}.answer_start"), F.lit(0))
    finish = begin + F.length(F.get(F.col(f"{answers}.text"), F.lit(0)))
    inside = ((F.size(spans) > 0) & (F.get(spans, F.lit(0))["start"] <= begin)
              & (F.element_at(spans, -1)["end"] >= finish))

    def count(cond) -> Column:
        return let(F.struct(begin.alias("b"), finish.alias("f")), lambda a: F.size(
            F.filter(spans, lambda s: cond(s, a))))

    n_begun = count(lambda s, a: s["start"] <= a["b"])
    n_short = count(lambda s, a: s["end"] < a["f"])
    start = pos + n_begun - 1
    if compat:
        end_of_feature = (F.col("n_positions") if padded_length is None else F.lit(padded_length)) - 1
        start = F.when(n_begun == F.col("n_context"), end_of_feature).otherwise(start)
    return (features
            .withColumn("start_position", F.when(inside, start).otherwise(CLS).cast("int"))
            .withColumn("end_position", F.when(inside, pos + n_short).otherwise(CLS).cast("int")))
