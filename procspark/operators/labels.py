"""Targets: validity flags, next-activity classes, loss masks, label tokens."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from procspark.functions.arrays import IGNORE
from procspark.operators.eventlog import END

# Answer tokens of each task, in class order.
LABEL_TOKENS = {
    "trace": ["False", "True"],
    "activity": ["0"] + [chr(c) for c in range(ord("A"), ord("Z") + 1)],
}


def pair_is_valid(out_of_order: str = "out_of_order") -> Column:
    return ~F.col(out_of_order)


def trace_is_valid(anomalies: str = "label") -> Column:
    return F.size(anomalies) == 0


def next_class(nxt: str = "next", activities: str = "unique_activities", strict: bool = False) -> Column:
    """0 for the end, else 1 + index in the activity list; unknown is null (or an error)."""
    at = F.array_position(activities, F.col(nxt)).cast("int")
    unknown = (F.raise_error(F.concat(F.lit("activity not in list: "), F.col(nxt)))
               if strict else F.lit(None))
    return F.when(F.col(nxt) == END, 0).when(at > 0, at).otherwise(unknown.cast("int"))


def drop_end(df: DataFrame, nxt: str = "next") -> DataFrame:
    return df.filter(F.col(nxt) != END)


def loss_mask(input_ids: str, prompt_ids: str, bos: Column | int | None = None,
              mask_bos: bool = True, compat: bool = False) -> Column:
    """Token ids with the prompt part set to the ignore label.

    Without a leading BOS the prompt starts at position 0, with one at position 1;
    anything else is an error. ``compat`` masks one target token too many when no
    BOS leads, and ``mask_bos=False`` leaves the BOS itself unmasked.
    """
    ids, prompt = F.col(input_ids), F.col(prompt_ids)
    n = F.size(prompt)
    first, second, want = F.get(ids, F.lit(0)), F.get(ids, F.lit(1)), F.get(prompt, F.lit(0))

    def masked(start: int, stop: Column) -> Column:
        return F.transform(ids, lambda t, i: F.when((i >= start) & (i < stop), IGNORE).otherwise(t))

    bare = masked(0, n + (1 if compat else 0))
    led = masked(1, n + 1)
    if mask_bos:
        lead = F.get(led, F.lit(0))
        hide = F.lit(True) if bos is None else lead == bos
        led = F.transform(led, lambda t, i: F.when((i == 0) & hide, IGNORE).otherwise(t))
    return (F.when(first == want, bare).when(second == want, led)
            .otherwise(F.raise_error(F.lit("prompt is not at the start of the input"))))


def last_token_label(length: Column, label: Column, vocab: Mapping[str, int]) -> Column:
    """Ignore everywhere but the last position, which holds the token of ``label + 1``."""
    table = F.create_map(*[x for k, v in vocab.items() for x in (F.lit(k), F.lit(v))])
    token = F.element_at(table, (label + 1).cast("string"))
    return F.concat(F.array_repeat(F.lit(IGNORE), length - 1), F.array(token))


def choice_label(label: Column) -> Column:
    """``"1".."n"`` as text -> 0-based class."""
    return label.cast("int") - 1


def label_dimension(spark: SparkSession,
                    tokens: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(task, class_idx, token), one row per answer token."""
    rows = [(task, i, tok) for task, toks in (tokens or LABEL_TOKENS).items()
            for i, tok in enumerate(toks)]
    return spark.createDataFrame(rows, "task string, class_idx int, token string")


def with_label_token(df: DataFrame, label: str, dimension: DataFrame, task: str = "task") -> DataFrame:
    dim = dimension.select(F.col("task").alias(task), F.col("class_idx").alias(label), "token")
    return df.join(dim, [task, label], "left")
