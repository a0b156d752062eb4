"""Multiple-choice rows: one row per choice, and back to lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def expand_choices(df: DataFrame, context: str, question: str, choices: Sequence[str],
                   row_id: str = "row_id") -> DataFrame:
    """(row_id, choice_pos, text, text_pair): ``context question`` against each choice."""
    keep = [c for c in df.columns if c not in {row_id, context, question, *choices}]
    return df.select(
        row_id, *keep, F.concat(context, F.lit(" "), question).alias("text"),
        F.posexplode(F.array(*choices)).alias("choice_pos", "text_pair"))


def regroup_choices(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Lists per row again, in choice order; a row has as many entries as choices."""
    parts = F.sort_array(F.collect_list(F.struct("choice_pos", *columns)))
    return (df.groupBy(row_id).agg(parts.alias("_p"))
            .select(row_id, *[F.col(f"_p.{c}").alias(c) for c in columns]))


def stack_columns(df: DataFrame, source: str, target: str, pair_id: str, out: str = "sentence") -> DataFrame:
    """All sources and all targets as one column; (side, pair_id) replaces the position."""
    return df.select(pair_id, F.posexplode(F.array(source, target)).alias("side", out))
