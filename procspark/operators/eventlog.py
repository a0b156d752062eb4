"""Event log -> traces, activity sets, prefixes and order relations.

A log row has the case columns, ``ts``, ``event_id`` and ``activity``. A trace is
one row with an array; the relations that do not need a whole trace in a row are
computed from log rows, so one very long case does not end in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from procspark.functions.ranking import range_bounds, range_number

END = "[END]"  # fixed value: what follows the last event
MODEL = ("model_id", "revision_id")


def _event() -> Column:
    return F.struct("ts", "event_id", "activity")


def traces(log: DataFrame, case: Sequence[str], carry: Sequence[str] = MODEL) -> DataFrame:
    """One row per case with ``trace`` in time order; ``row_id`` is its first event id."""
    extra = [c for c in carry if c not in case]
    return (log.groupBy(*case)
            .agg(*[F.min(c).alias(c) for c in extra], F.min("event_id").alias("row_id"),
                 F.transform(F.sort_array(F.collect_list(_event())),
                             lambda e: e["activity"]).alias("trace")))


def activity_sets(log: DataFrame, model: Sequence[str] = MODEL) -> DataFrame:
    """Sorted distinct activities per model."""
    return (log.select(*model, "activity").distinct()
            .groupBy(*model).agg(F.sort_array(F.collect_list("activity")).alias("unique_activities")))


def with_activity_sets(df: DataFrame, log: DataFrame, model: Sequence[str] = MODEL) -> DataFrame:
    return df.join(activity_sets(log, model), list(model))


def prefixes(traces_df: DataFrame) -> DataFrame:
    """One row per event: the trace up to it and the activity after it."""
    return (traces_df
            .withColumn("prefix_len", F.explode(F.sequence(F.lit(1), F.size("trace"))))
            .withColumn("prefix", F.slice("trace", F.lit(1), F.col("prefix_len")))
            .withColumn("next", F.coalesce(F.get("trace", F.col("prefix_len")), F.lit(END))))


def eventually_follows(log: DataFrame, case: Sequence[str], carry: Sequence[str] = MODEL) -> DataFrame:
    """Distinct ordered activity pairs (src somewhere before dst) of every case.

    An activity is before another one iff its first event is before the other's
    last event, so only first and last events meet, not all events. Both are
    folded per (case, activity) before a case comes together.
    """
    extra = [c for c in carry if c not in case]
    at = F.struct("ts", "event_id")
    span = log.groupBy(*case, *extra, "activity").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    acts = span.groupBy(*case, *extra).agg(F.collect_list(F.struct("activity", "first", "last")).alias("_acts"))
    src = acts.select(*case, *extra, "_acts", F.explode("_acts").alias("_a"))
    later = F.filter("_acts", lambda b: F.col("_a.first") < b["last"])
    return (src.select(*case, *extra, F.col("_a.activity").alias("src"), F.explode(later).alias("_b"))
            .select(*case, *extra, F.struct("src", F.col("_b.activity").alias("dst")).alias("eventually_follows")))


def follow_edges(log: DataFrame, case: Sequence[str], model: Sequence[str] = MODEL,
                 bucket: Column | None = None) -> DataFrame:
    """Each pair of neighbouring events in a case as (model, src, dst), with repeats.

    ``bucket`` (it must not decrease with time) cuts a case into pieces that sort on their own, so no case has to
    fit one task; by default ranges of time with about equal numbers of events, from a sample of the log, so a busy hour is many
    pieces. Only the first and last event of a piece are then lined up per case, for the pairs over the cuts.
    """
    if bucket is None:
        bucket = range_number(F.col("ts"), range_bounds(log, F.col("ts")), log.schema["ts"].dataType.simpleString())
    cut = log.withColumn("_bucket", bucket)
    piece = Window.partitionBy(*case, "_bucket").orderBy("ts", "event_id")
    marked = (cut.withColumn("dst", F.lead("activity").over(piece))
              .withColumn("_head", F.row_number().over(piece) == 1))
    inner = marked.filter(F.col("dst").isNotNull())
    whole = Window.partitionBy(*case).orderBy("ts", "event_id")
    over_cut = (marked.filter(F.col("dst").isNull() | F.col("_head"))
                .withColumn("_next", F.lead("activity").over(whole))
                .filter(F.col("dst").isNull() & F.col("_next").isNotNull())
                .withColumn("dst", F.col("_next")))
    parts = [
        d.select(*model, F.col("activity").alias("src"), "dst") for d in (inner, over_cut)]
    return parts[0].unionByName(parts[1])


def directly_follows(log: DataFrame, case: Sequence[str], model: Sequence[str] = MODEL,
                     bucket: Column | None = None) -> DataFrame:
    """Sorted distinct neighbour pairs per model, as ``dfg``."""
    return (follow_edges(log, case, model, bucket).distinct()
            .groupBy(*model).agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("dfg")))
