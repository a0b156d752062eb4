"""Queries over the event log: traces, splits, labels, prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from procspark.functions.ranking import range_bounds
from procspark.functions.text import parse_pairs, parse_set, py_list_repr
from procspark.operators import dedup_split as ds, eventlog as ev, labels as lb, metrics as mt, prompts as pr
from procspark.plans import views as v
from procspark.plans.views import joined, rounded

EOS = "</s>"


def trace_build(spark, sf):
    return v.traces(spark, sf).select("model_id", "revision_id", "case_id", "row_id", joined(F.col("trace"), "|").alias("trace"),
                                      joined(F.col("unique_activities"), "|").alias("activities"))


def activity_sets(spark, sf):
    return ev.activity_sets(v.log(spark, sf)).select(
        "model_id", "revision_id", joined(F.col("unique_activities"), "|").alias("activities"))


def trace_dedup(spark, sf):
    return ds.remove_duplicates(v.traces(spark, sf)).select(
        "row_id", "case_id", joined(F.col("trace"), "|").alias("trace"), F.size("label").alias("n_anomalies"))


def trace_only_dedup(spark, sf):
    return ds.deduplicate_traces(v.traces(spark, sf)).select("row_id", "model_id", joined(F.col("trace"), "|").alias("trace"))


def group_split(spark, sf):
    return ds.split_by_ids(ds.remove_duplicates(v.traces(spark, sf)), v.id_list(spark, sf)).select(
        "row_id", "id", "split", "num_unique_activities")


def hash_group_split(spark, sf):
    return ds.hash_split(v.clean_traces(spark, sf), method="md5").select("row_id", "id", "split")


def split_dispatch(spark, sf):
    """Rows asked for by split name; a name that is none means test."""
    d = hash_group_split(spark, sf)
    parts = [ds.select_split(d, name).select(F.lit(name).alias("asked"), "row_id", "split") for name in ("train", "val", "dev")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def trace_validity_prompt(spark, sf):
    d = ds.hash_split(v.clean_traces(spark, sf), method="md5")
    return d.select("row_id", "split", lb.trace_is_valid().cast("int").alias("labels"),
                    pr.trace_prompt(F.col("unique_activities"), F.col("trace")).alias("prompt"))


def trace_classifier_text(spark, sf):
    return v.clean_traces(spark, sf).select(
        "row_id", lb.trace_is_valid().cast("int").alias("labels"),
        pr.trace_prompt(F.col("unique_activities"), F.col("trace"), tail=False).alias("text"))


def _pairs(spark, sf):
    events = v.log(spark, sf)
    pairs = ev.with_activity_sets(ev.eventually_follows(events, v.CASE), events)
    pair = F.col("eventually_follows")
    pairs = pairs.withColumn("out_of_order", pair["src"] > pair["dst"])
    first = events.groupBy("case_id").agg(F.min("event_id").alias("row_id"))
    return ds.keep_multi_activity(ds.remove_duplicates(pairs.join(first, "case_id")))


def pair_validity_prompt(spark, sf):
    return _pairs(spark, sf).select(
        "model_id", "revision_id", "row_id", lb.pair_is_valid().cast("int").alias("labels"),
        pr.pair_prompt(F.col("unique_activities"), F.col("eventually_follows")).alias("prompt"))


def pair_classifier_text(spark, sf):
    return _pairs(spark, sf).select(
        "model_id", "revision_id", lb.pair_is_valid().cast("int").alias("labels"),
        pr.pair_prompt(F.col("unique_activities"), F.col("eventually_follows"), tail=False).alias("text"))


def _next(spark, sf):
    """Copies of a trace are dropped before its prefixes are built: the rows that
    stay are the ones a dedup of all prefixes would keep."""
    return lb.drop_end(ev.prefixes(v.clean_traces(spark, sf)).withColumn("labels", lb.next_class()))


def prefix_next(spark, sf):
    return v.prefixes(spark, sf).select("row_id", "prefix_len", joined(F.col("prefix"), "|").alias("prefix"), "next",
                                        lb.next_class().alias("labels"))


def next_activity_prompt(spark, sf):
    return _next(spark, sf).select("row_id", "prefix_len", "labels", pr.next_activity_prompt(
        F.col("unique_activities"), F.col("prefix")).alias("prompt"))


def next_activity_menu(spark, sf):
    return _next(spark, sf).select("row_id", "prefix_len", "labels", pr.next_activity_menu(
        F.col("unique_activities"), F.col("prefix")).alias("text"))


def label_tokens(spark, sf):
    d = _next(spark, sf).withColumn("task", F.lit("activity"))
    return lb.with_label_token(d, "labels", lb.label_dimension(spark)).groupBy("labels", "token").agg(
        F.count(F.lit(1)).alias("n"))


def dfg_pairs(spark, sf):
    return ev.directly_follows(v.log(spark, sf), v.CASE).select("model_id", "revision_id", F.array_join(
        F.transform("dfg", lambda p: F.concat(p["src"], F.lit(">"), p["dst"])), "|").alias("dfg"))


def dfg_prompt(spark, sf):
    return pr.dfg_prompt(v.models(spark, sf), EOS).select("model_id", "revision_id", "prompt", "target", "text")


def dfg_prompt_eval(spark, sf):
    return pr.dfg_prompt(v.models(spark, sf), EOS, train=False).select(
        "model_id", "revision_id", "text", F.col("target").alias("label_strings"))


def tree_prompt(spark, sf):
    return pr.tree_prompt(v.models(spark, sf), EOS).select("model_id", "revision_id", "target", "text")


def tree_prompt_head16(spark, sf):
    d = v.models(spark, sf).join(v.log(spark, sf).groupBy("model_id", "revision_id").agg(
        F.min("event_id").alias("row_id")), ["model_id", "revision_id"])
    return pr.tree_prompt(ds.head(d), EOS, train=False).select(
        "row_id", "text", F.col("target").alias("label_strings"))


def parse_set_text(spark, sf):
    text = v.models(spark, sf).select("model_id", "revision_id", "unique_activities", F.concat(
        F.lit("{"), F.substr(py_list_repr(F.col("unique_activities")), F.lit(2)), F.lit("}")).alias("t"))
    text = text.withColumn("t", F.regexp_replace("t", r"\]\}$", "}"))
    return text.select("model_id", "revision_id", joined(parse_set(F.col("t")), "|").alias("activities"))


def parse_pair_text(spark, sf):
    one = F.transform("dfg", lambda p: F.concat(F.lit("('"), p["src"], F.lit("', '"), p["dst"], F.lit("')")))
    text = v.models(spark, sf).select("model_id", "revision_id", F.concat(
        F.lit("["), F.array_join(one, ", "), F.lit("]")).alias("t"))
    return text.select("model_id", "revision_id", F.array_join(F.transform(
        parse_pairs(F.col("t")), lambda p: F.concat(p["src"], F.lit(">"), p["dst"])), "|").alias("dfg"))


def activity_size_share(spark, sf):
    d = ds.hash_split(v.clean_traces(spark, sf), method="md5")
    return mt.size_share(d).select("split", "n_activities", "n", rounded(F.col("share")).alias("share"),
                                   rounded(F.col("cum_share")).alias("cum_share"))


def balanced_sample(spark, sf):
    d = ds.hash_split(v.clean_traces(spark, sf), method="md5").withColumn("labels", lb.trace_is_valid().cast("int"))
    return ds.balanced_sample(d, "labels", 50, method="md5").select("row_id", "split", "labels")


def few_shot(spark, sf):
    return ds.few_shot(v.clean_traces(spark, sf), 32, seed=7, method="md5").select("row_id", "id")


def epoch_order(spark, sf):
    """Position of each trace in the shuffled order of epoch 3."""
    return ds.epoch_positions(v.clean_traces(spark, sf).select("row_id"), 3, seed=1, method="md5")


def task_batches(spark, sf):
    t = v.clean_traces(spark, sf).select("row_id", F.lit("trace").alias("task"))
    e = v.log(spark, sf).select(F.col("event_id").alias("row_id"), F.lit("activity").alias("task"))
    return ds.task_batches(t.unionByName(e), 32, bounds=range_bounds(e, F.col("row_id")))


QUERIES = {f.__name__: f for f in (
    trace_build, activity_sets, trace_dedup, trace_only_dedup, group_split, hash_group_split, split_dispatch,
    trace_validity_prompt, trace_classifier_text, pair_validity_prompt, pair_classifier_text, prefix_next,
    next_activity_prompt, next_activity_menu, label_tokens, dfg_pairs, dfg_prompt, dfg_prompt_eval, tree_prompt,
    tree_prompt_head16, parse_set_text, parse_pair_text, activity_size_share, balanced_sample, few_shot,
    epoch_order, task_batches)}
