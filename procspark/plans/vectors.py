"""Queries over embeddings: pooling, retrieval, neighbours, alignment, class heads."""

from __future__ import annotations

from pyspark.sql import functions as F

from procspark.functions.vectors import cosine
from procspark.operators import alignment as al, heads as hd, metrics as mt, pooling as pl, retrieval as rt, tags as tg
from procspark.plans import views as v
from procspark.plans.views import rounded


def _flat(df, *keys):
    return df.select(*keys, F.posexplode("vec").alias("dim", "x")).select(*keys, "dim", rounded(F.col("x")).alias("x"))


def layer_mean(spark, sf):
    """Mean over the last two layers, per token."""
    return _flat(pl.embed(v.hidden_states(spark, sf), 2, 4, pool=None), "row_id", "pos")


def pool_mean(spark, sf):
    return _flat(pl.embed(v.hidden_states(spark, sf), 1, 4), "row_id")


def pool_first(spark, sf):
    return _flat(pl.embed(v.hidden_states(spark, sf), [0, 2], 4, how="sum", pool="cls"), "row_id")


def last_state(spark, sf):
    return _flat(pl.last_token(pl.pick_layers(v.hidden_states(spark, sf), 1, 4)), "row_id")


def cosine_ranks(spark, sf):
    x, y, shape = v.halves(spark, sf)
    r = rt.cosine_ranks(x, y, shape=shape)
    return r.select("x_id", rounded(F.col("true_score")).alias("true_score"), "true_rank",
                    rounded(F.col("best_score")).alias("best_score"), "best_id",
                    rounded(F.col("score_sum")).alias("score_sum"), "n")


def true_cosine(spark, sf):
    """Cosine of the true pairs only."""
    x, y, _ = v.halves(spark, sf)
    pairs = x.select("pair_id", F.col("vec").alias("a")).join(y.select("pair_id", F.col("vec").alias("b")), "pair_id")
    return pairs.select("pair_id", rounded(cosine(F.col("a"), F.col("b"))).alias("cosine"))


def mrr_acc(spark, sf):
    x, y, shape = v.halves(spark, sf)
    r = rt.retrieval_report(rt.cosine_ranks(x, y, shape=shape))
    return r.select(*[rounded(F.col(c)).alias(c) for c in ("mrr", "acc", "mean_score")])


def mean_cosine(spark, sf):
    return rt.mean_cosine(*v.halves(spark, sf)[:2]).select(rounded(F.col("mean_cosine")).alias("mean_cosine"))


def _neighbours(spark, sf, k=max(rt.KNN_SIZES), find=rt.neighbour_lists):
    x, y, (n_x, n_y, dims) = v.halves(spark, sf)
    return find(y.select(F.col("vec_id").alias("x_id"), "vec"),
                          x.select(F.col("vec_id").alias("y_id"), "vec", "label"), k, shape=(n_y, n_x, dims))


def knn_top(spark, sf):
    return _neighbours(spark, sf, 10, rt.top_sources).select("x_id", "rank", "y_id", rounded(F.col("score")).alias("score"), "label")


def knn_vote(spark, sf):
    return rt.knn_vote(_neighbours(spark, sf))


def knn_entity_f1(spark, sf):
    """Neighbour votes as tags of sentences of five tokens; label ids past the tag list count as O."""
    vote = rt.knn_vote(_neighbours(spark, sf)).withColumn("pred", F.when(F.col("pred") < 7, F.col("pred")).otherwise(0))
    gold = v.halves(spark, sf)[1].select(F.col("vec_id").alias("x_id"), F.when(F.col("label") < 7, F.col("label")).otherwise(0).alias("y"))
    tok = rt.scatter(gold.select("x_id", "y", F.explode(F.array(*[F.lit(k) for k in rt.KNN_SIZES])).alias("k")), vote, ["x_id", "k"], -100)
    at = F.sort_array(F.collect_list(F.struct("x_id", F.col("pred").cast("int").alias("p"), F.col("y").cast("int").alias("y"))))
    rows = tok.groupBy("k", F.floor(F.col("x_id") / 5).alias("sent")).agg(at.alias("t")).select(
        "k", F.col("t.p").alias("preds"), F.col("t.y").alias("labels"))
    return tg.entity_f1(rows, "preds", "labels", tg.NER_TAGS, ["k"]).select("k", "tp", "pred", "gold", rounded(F.col("f1")).alias("f1"))


def bert_score_pairs(spark, sf):
    """Token-level score of the true sentence pairs."""
    x, y = (rt.sentences(s) for s in v.sentence_tokens(spark, sf)[:2])
    pairs = x.withColumnRenamed("vecs", "x_vecs").join(y.withColumnRenamed("vecs", "y_vecs"), "pair_id")
    return rt.bert_score_pairs(pairs).select("pair_id", rounded(F.col("bert_score")).alias("bert_score"))


def bert_score_ranks(spark, sf):
    *sides, shape = v.sentence_tokens(spark, sf)
    r = rt.bert_score_ranks(*map(rt.sentences, sides), shape=shape)
    return r.select("x_id", rounded(F.col("true_score")).alias("true_score"), "true_rank",
                    rounded(F.col("best_score")).alias("best_score"), "best_id",
                    rounded(F.col("score_sum")).alias("score_sum"), "n")


def cka_2d(spark, sf):
    return al.cka(v.sided(spark, sf)).select(rounded(F.col("cka")).alias("cka"))


def cka_3d(spark, sf):
    x, y, _ = v.halves(spark, sf)
    pairs = x.select("pair_id", F.col("vec").alias("x")).join(y.select("pair_id", F.col("vec").alias("y")), "pair_id")
    pairs = pairs.withColumns({"a": F.floor(F.col("pair_id") / 5), "b": F.col("pair_id") % 5})
    return al.cka_grouped(pairs, reduction=None).select("a", rounded(F.col("cka")).alias("cka"))


def _logits(spark, sf):
    rows = v.task_rows(spark, sf)
    return mt.with_preds(hd.head_logits(rows, hd.class_means(rows, "labels")))


def head_logits(spark, sf):
    d = _logits(spark, sf).select("row_id", "preds", F.posexplode("logits").alias("class_idx", "x"))
    return d.select("row_id", "preds", "class_idx", rounded(F.col("x")).alias("logit"))


def head_stats(spark, sf):
    """Best class and loss of each row, from tiles of rows and classes."""
    rows = v.task_rows(spark, sf)
    d = hd.head_stats(rows, hd.class_means(rows, "labels"), tile_rows=4096)
    return d.select("row_id", "preds", rounded(F.col("max_logit")).alias("max_logit"), rounded(F.col("loss")).alias("loss"))


def clf_metrics(spark, sf):
    d = _logits(spark, sf).withColumnRenamed("task", "dataset_name")
    return mt.evaluate(d, ["acc", "micro_f1", "macro_f1", "loss"]).select(
        "dataset_name", "split", "metric", rounded(F.col("value")).alias("value"))


def confusion_counts(spark, sf):
    return mt.confusion(_logits(spark, sf), ["task"])


def expected_loss(spark, sf):
    return mt.mean_loss(_logits(spark, sf), ["task"], labels="preds").select("task", rounded(F.col("value")).alias("loss"))


def task_loss_mean(spark, sf):
    return mt.mean_of_task_losses(_logits(spark, sf)).select(rounded(F.col("value")).alias("loss"))


QUERIES = {f.__name__: f for f in (
    layer_mean, pool_mean, pool_first, last_state, cosine_ranks, true_cosine, mrr_acc, mean_cosine, knn_top, knn_vote, knn_entity_f1,
    bert_score_pairs, bert_score_ranks, cka_2d, cka_3d, head_logits, head_stats, clf_metrics, confusion_counts, expected_loss, task_loss_mean)}
