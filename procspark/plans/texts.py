"""Queries over documents and conversations: tokens, blocks, tags, choices, batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window, functions as F

from procspark.functions.arrays import IGNORE
from procspark.functions.ranking import range_bounds
from procspark.functions.tokens import attention_mask, truncate, words
from procspark.operators import batches as bt, choices as ch, labels as lb, metrics as mt, packing as pk, prompts as pr, tags as tg
from procspark.plans import views as v
from procspark.plans.views import joined, rounded
from procspark.sources import catalogue as cat
from procspark.sources.tables import INPUTS


def strip_truncate(spark, sf):
    d = pk.strip_texts(v.documents(spark, sf, "doc_id", "text"), "text")
    t = truncate(words(F.col("text")), 128)
    return d.select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, "").alias("text"))


def strip_pairs(spark, sf):
    """Both columns of a text pair without white space at their ends."""
    d = v.turn_pairs(spark, sf).select("conv_id", "turn", F.concat(F.lit(" \t"), "user", F.lit("\n")).alias("premise"),
                                       F.concat("assistant", F.lit("  ")).alias("hypothesis"))
    return pk.strip_texts(d, "premise", "hypothesis")


def corpus_tokenize(spark, sf):
    """Token lists instead of the source columns."""
    return pk.tokenize(v.documents(spark, sf, "doc_id", "lang", "text"), "text", keep=["doc_id"]).select(
        "doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", "|").alias("tokens"))


def paired_metrics(spark, sf):
    """Predictions beside labels by id, then metrics per language."""
    rows = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    preds = rows.select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("preds"))
    gold = rows.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("labels"), F.col("lang").alias("dataset_name"))
    return mt.evaluate(mt.paired(preds, gold), ["acc"], ["dataset_name"]).select("dataset_name", "metric", rounded(F.col("value")).alias("value"))


def unpaired_ids(spark, sf):
    """Documents without a label, or labels without a document."""
    ids = lambda t: v.table(spark, sf, t).select(F.col("doc_id").alias("row_id"))
    return mt.unpaired(ids("documents"), ids("labels"))


def evaluation_hooks(spark, sf):
    """Hooks before the metrics: predictions from scores, a kept column, and one more filter on the outputs."""
    d = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return mt.run_evaluation(
        d, prepare_batch=lambda x: x.withColumn("score", F.col("n_chars") % 10),
        prepare_outputs=lambda x: x.withColumn("preds", (F.col("score") < 8).cast("int")).withColumn("labels", F.col("quality").cast("int")),
        keep=["preds", "labels", "score"], prepare_step_outputs=lambda x: x.filter("score <> 5"), metrics=("acc",), by=("lang",)).select(
        "lang", "metric", rounded(F.col("value")).alias("value"))


def blank_line_filter(spark, sf):
    lines = v.documents(spark, sf, "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return pk.drop_blank_lines(lines, "line").select("doc_id", "line_no", "line")


def _doc_bounds(spark, sf):
    return range_bounds(v.table(spark, sf, "documents"), F.col("doc_id"))


def pack_blocks(spark, sf):
    d = v.doc_words(spark, sf).withColumn("lens", F.transform("tokens", F.length))
    return pk.pack_blocks(d, ["tokens", "lens"], 512, "doc_id", bounds=_doc_bounds(spark, sf)).select(
        "batch_id", "block_id", F.array_join("tokens", "").alias("text"),
        F.aggregate("lens", F.lit(0), lambda a, x: a + x).alias("n_chars"))


def _losses(spark, sf):
    labels = F.transform("tokens", lambda t: F.when(F.length(t) % 7 == 0, IGNORE).otherwise(F.length(t)))
    return v.doc_words(spark, sf).select(
        "doc_id", "lang", "source", pk.scored_tokens(labels).alias("num_tokens"),
        ((F.col("doc_id") * 37 % 100) / 25.0).alias("loss"))


def scored_tokens(spark, sf):
    return _losses(spark, sf).select("doc_id", "num_tokens")


def perplexity_by_lang(spark, sf):
    return mt.perplexity(_losses(spark, sf), ["lang"]).select("lang", rounded(F.col("value")).alias("perplexity"))


def tag_remap(spark, sf):
    tags = F.transform("tokens", lambda t, i: ((F.col("doc_id") + i) % 9).cast("int"))
    return v.doc_words(spark, sf).select("doc_id", joined(tg.remap_tags(tags)).alias("tags"))


def _sub_tokens(spark, sf):
    """Words in pieces of four characters between two special positions."""
    pieces = F.flatten(F.transform("tokens", lambda t, i: F.array_repeat(i, F.ceil(F.length(t) / 4).cast("int"))))
    special = F.array(F.lit(None).cast("int"))
    return v.doc_words(spark, sf).select(
        "doc_id", "tokens", F.transform("tokens", lambda t, i: ((F.col("doc_id") + i) % 7).cast("int")).alias("ner_tags"),
        F.concat(special, pieces, special).alias("word_ids"))


def tag_align(spark, sf):
    names = {"text": "tokens", "label": "ner_tags"}
    every = tg.align_table(_sub_tokens(spark, sf), names).withColumnRenamed("labels", "all_pieces")
    return tg.align_table(every, names, label_all=False).select(
        "doc_id", joined(F.col("all_pieces")).alias("all_pieces"), joined(F.col("labels")).alias("first_piece"))


def entity_f1(spark, sf):
    return tg.entity_f1(v.tagged(spark, sf), "preds", "labels", tg.NER_TAGS, ["lang"]).select(
        "lang", "tp", "pred", "gold", rounded(F.col("f1")).alias("f1"))


def pos_chunk_f1(spark, sf):
    """The same score on tags without chunk prefixes."""
    return tg.entity_f1(v.tagged(spark, sf), "preds", "labels", tg.POS_TAGS[:7], ["lang"]).select(
        "lang", "tp", "pred", "gold", rounded(F.col("f1")).alias("f1"))


def choice_expand(spark, sf):
    d = v.turn_pairs(spark, sf).withColumn("row_id", F.col("conv_id") * 1000 + F.col("turn")).withColumn(
        "c2", F.reverse("assistant")).withColumn("q", F.lit("what next?"))
    return ch.expand_choices(d.select("row_id", "user", "q", "assistant", "c2"), "user", "q", ["assistant", "c2"]).select(
        "row_id", "choice_pos", "text", "text_pair")


def choice_regroup(spark, sf):
    rows = choice_expand(spark, sf).withColumn("n", F.size(words(F.col("text_pair"))))
    return ch.regroup_choices(rows, ["n"]).select("row_id", joined(F.col("n")).alias("n_words"))


def choice_prompts(spark, sf):
    cols = (F.col("user"), F.lit("what next?"), F.col("assistant"), F.reverse("assistant"))
    label = lb.choice_label((F.col("turn") % 2 + 1).cast("string"))
    return v.turn_pairs(spark, sf).select("conv_id", "turn", label.alias("label"), pr.two_choice_prompt(*cols).alias("prompt"),
                                          pr.two_choice_prompt(*cols, shift=False).alias("cls_prompt"))


def stack_pairs(spark, sf):
    d = v.turn_pairs(spark, sf).withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))
    return ch.stack_columns(d, "user", "assistant", "pair_id")


def _ids(spark, sf):
    """Word lengths as token ids: prompt = user turn, target = assistant turn."""
    n = lambda c: F.transform(words(F.col(c)), F.length)
    d = v.turn_pairs(spark, sf).select("conv_id", "turn", n("user").alias("prompt_ids"), n("assistant").alias("target_ids"))
    bos = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit(-1))).otherwise(F.slice("prompt_ids", 1, 0))
    return d.withColumn("input_ids", F.concat(bos, "prompt_ids", "target_ids"))


def loss_mask(spark, sf):
    return _ids(spark, sf).select(
        "conv_id", "turn", joined(lb.loss_mask("input_ids", "prompt_ids", -1)).alias("labels"),
        joined(lb.loss_mask("input_ids", "prompt_ids", -1, mask_bos=False, compat=True)).alias("compat_labels"))


def last_token_label(spark, sf):
    vocab = {"1": 11, "2": 12, "3": 13}
    return _ids(spark, sf).select("conv_id", "turn", joined(lb.last_token_label(
        F.size("input_ids"), (F.col("turn") % 3).cast("int"), vocab)).alias("labels"))


def strip_generation(spark, sf):
    mark = (F.when(F.col("turn") % 3 == 0, pr.PAIRS_MARK).when(F.col("turn") % 3 == 1, pr.TREE_MARK).otherwise(""))
    d = v.turn_pairs(spark, sf).withColumn("generated", F.concat("user", F.lit("\n"), mark, "assistant"))
    return d.select("conv_id", "turn", pr.strip_prompt(F.col("generated")).alias("preds"),
                    pr.strip_prompt(F.col("generated"), compat=True).alias("compat_preds"))


def pad_batches(spark, sf):
    d = v.doc_words(spark, sf).select("doc_id", F.transform("tokens", F.length).alias("input_ids"))
    d = bt.with_batch(d.withColumn("labels", F.transform("input_ids", lambda x: x * 2)), "doc_id", 32, bounds=_doc_bounds(spark, sf))
    return bt.pad_batches(d, 0, labels=["labels"]).select(
        "doc_id", "batch_id", "padded_length", joined(F.col("input_ids")).alias("input_ids"),
        joined(F.col("attention_mask")).alias("attention_mask"), joined(F.col("labels")).alias("labels"))


def pad_scalar_batches(spark, sf):
    """The first 64 words of labelled documents, sixteen a batch, padded on the right; the label is one number."""
    d = v.doc_words(spark, sf).join(v.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    d = d.select("doc_id", "label", F.transform(truncate(F.col("tokens"), 64), F.length).alias("input_ids"))
    bounds = range_bounds(v.table(spark, sf, "labels"), F.col("doc_id"))
    return bt.pad_batches(bt.with_batch(d, "doc_id", 16, bounds=bounds), 0, side="right").select(
        "doc_id", "batch_id", "label", joined(F.col("input_ids")).alias("input_ids"), joined(F.col("attention_mask")).alias("attention_mask"))


def pad_choice_batches(spark, sf):
    """Every turn and its reverse as two choices, eight turns a batch."""
    n = lambda c: F.transform(words(c), F.length)
    d = v.turns(spark, sf).select("conv_id", "turn", "turn_id", F.array(n(F.col("text")), n(F.reverse("text"))).alias("input_ids"))
    flat = lambda c: F.array_join(F.transform(c, lambda x: joined(x)), "|")
    return bt.pad_choice_batches(bt.with_batch(d, "turn_id", 8), 0).select(
        "conv_id", "turn", "padded_length", flat("input_ids").alias("input_ids"), flat("attention_mask").alias("attention_mask"))


def length_mask(spark, sf):
    """Every turn against the longest of the same eight turns."""
    d = v.turns(spark, sf).select("conv_id", "turn", "turn_id", words(F.col("text")).alias("input_ids"))
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    return bt.with_batch(d, "turn_id", 8).withColumn("longest", longest).select(
        "conv_id", "turn", joined(attention_mask(F.size("input_ids"), F.col("longest"))).alias("mask"))


def dataset_union_metrics(spark, sf):
    """Label agreement per language and source, as one metrics table."""
    d = v.table(spark, sf, "labels").join(v.table(spark, sf, "documents").select("doc_id", "lang", "source"), "doc_id").select(
        F.col("lang").alias("dataset_name"), F.col("source").alias("split"), F.col("toxic").alias("preds"),
        F.col("quality").alias("labels"))
    return mt.evaluate(d).select("dataset_name", "split", "metric", rounded(F.col("value")).alias("value"))


def named_union(spark, sf):
    """Four tables as named datasets, each under its columns' logical names, in one table."""
    def some(name, role, logical):
        e = cat.Entry(f"{role}_{name}", role, "text", f"{name}.parquet", "", "", None)
        return cat.to_logical(cat.read_entries(spark, sf, [e], INPUTS[name]), logical).select(F.col("id").cast("bigint").alias("id"), "text", "dataset_name", "split")

    parts = [some("documents", "train", {"id": "doc_id"}), some("pages", "train", {"id": "page_id", "text": "html"}),
             some("benchmark", "test", {"id": "item_id"}), some("conversations", "validation", {"id": "conv_id"})]
    return reduce(lambda a, b: a.unionByName(b), parts).select("id", "dataset_name", "split", F.length("text").alias("n"))


QUERIES = {f.__name__: f for f in (
    strip_truncate, strip_pairs, corpus_tokenize, paired_metrics, unpaired_ids, evaluation_hooks, blank_line_filter, pack_blocks, scored_tokens, perplexity_by_lang, tag_remap, tag_align, entity_f1,
    pos_chunk_f1, choice_expand, choice_regroup, choice_prompts, stack_pairs, loss_mask, last_token_label, strip_generation,
    pad_batches, pad_scalar_batches, pad_choice_batches, length_mask, dataset_union_metrics, named_union)}
