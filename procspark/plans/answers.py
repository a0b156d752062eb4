"""Queries over documents as extractive QA examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from procspark.operators import qa_answers as qa, qa_windows as qw
from procspark.plans import views as v
from procspark.plans.views import rounded
from procspark.sources import qa_json as qj


def qa_windows(spark, sf):
    d = qw.eval_features(v.qa_answered(spark, sf).select("id", "context", "question"))
    spans = F.filter("offset_mapping", lambda o: o.isNotNull())
    return d.select("example_id", "window_no", "context_start", "n_context", "n_positions", "context_pos",
                    F.get(spans, F.lit(0))["start"].alias("first_char"), F.try_element_at(spans, F.lit(-1))["end"].alias("last_char"),
                    F.size("offset_mapping").alias("n_offsets"), F.array_join("context_tokens", "").alias("text"))


def qa_span_labels(spark, sf):
    d = v.qa_answered(spark, sf)
    none = F.struct(F.slice("answers.text", 1, 0).alias("text"), F.slice("answers.answer_start", 1, 0).alias("answer_start"))
    d = d.withColumn("answers", F.when(F.col("id") % 10 == 0, none).otherwise(F.col("answers")))
    feats = qw.qa_features(d.select("id", "context", "question", "answers"))
    lab = qw.span_labels(feats)
    both = qw.span_labels(lab.withColumnsRenamed({"start_position": "s", "end_position": "e"}), compat=True, padded_length=384)
    return both.select("example_id", "window_no", F.col("s").alias("start_position"), F.col("e").alias("end_position"),
                       F.col("start_position").alias("compat_start"))


def _nbest(spark, sf, negatives=False):
    return qa.nbest(v.qa_scored(spark, sf), negatives=negatives)


def qa_nbest(spark, sf):
    # the outer form, because the plain one adds a filter that computes the list twice
    return _answer_rows(_nbest(spark, sf))


def _answer_rows(d):
    d = d.select("example_id", F.posexplode_outer("predictions").alias("place", "p"))
    return d.select("example_id", "place", "p.text", "p.score", "p.start_logit", "p.end_logit",
                    rounded(F.col("p.probability")).alias("probability"))


def qa_nbest_examples(spark, sf):
    """Answers cut from the examples' contexts; starts must be places of maximal context, every fifth example has no window."""
    flags = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.size("start_logits") - 1), lambda p: F.struct(
        p.cast("string").alias("key"), ((p + F.col("example_id")) % 4 != 0).alias("value"))))
    feats = v.qa_scored(spark, sf).where("example_id % 5 <> 0").withColumn("token_is_max_context", flags)
    examples = v.qa_examples(spark, sf).select(F.col("id").alias("example_id"), "context")
    return _answer_rows(qa.nbest(feats, examples, max_context="token_is_max_context"))


def qa_unmatched(spark, sf):
    """Examples without a window."""
    feats = v.qa_scored(spark, sf).where("example_id % 5 <> 0")
    return qa.unmatched(feats, v.qa_examples(spark, sf).select(F.col("id").alias("example_id")))


def qa_null(spark, sf):
    return qa.best_answers(_nbest(spark, sf, negatives=True), negatives=True, null_threshold=-150.0).select(
        "id", "prediction_text", "score_diff")


def qa_em_f1(spark, sf):
    refs = v.qa_answered(spark, sf).select("id", "answers")
    s = qa.squad_scores(qa.best_answers(_nbest(spark, sf)), refs)
    return s.select("id", "exact_match", rounded(F.col("f1")).alias("f1"))


def qa_metric(spark, sf):
    refs = v.qa_answered(spark, sf).select("id", "answers", "lang")
    m = qa.squad_metric(qa.squad_scores(qa.best_answers(_nbest(spark, sf)), refs, keep=["lang"]), ["lang"])
    return m.select("lang", rounded(F.col("exact_match")).alias("exact_match"), rounded(F.col("f1")).alias("f1"), "n")


def qa_metric_missing(spark, sf):
    """Predictions for even ids only; the other references count as wrong."""
    refs = v.qa_answered(spark, sf).select("id", "answers", "lang")
    some = qa.best_answers(_nbest(spark, sf)).filter("id % 2 = 0")
    m = qa.squad_metric(qa.squad_scores(some, refs, keep=["lang"]), ["lang"])
    return m.select("lang", rounded(F.col("exact_match")).alias("exact_match"), rounded(F.col("f1")).alias("f1"), "n")


def nbest_json(spark, sf):
    """The n-best lists as JSON text, read again."""
    row = "array<struct<start_logit:double,end_logit:double,text:string,probability:double>>"
    d = qa.nbest_json(_nbest(spark, sf)).select("id", F.posexplode(F.from_json("nbest", row)).alias("place", "p"))
    return d.select("id", "place", "p.text", "p.start_logit", "p.end_logit", rounded(F.col("p.probability")).alias("probability"))


def _nested(spark, sf):
    """Each document as one article of a nested QA file; every seventh answer has a wrong offset."""
    names = F.create_map(*[F.lit(x) for x in ("en", "english", "de", "german", "fr", "french", "es", "spanish")])
    d = v.qa_answered(spark, sf)
    at = F.get("answers.answer_start", F.lit(0)) + F.when(F.col("id") % 7 == 0, 1).otherwise(0)
    qa_row = F.struct(F.concat_ws("-", names[F.col("lang")], "id").alias("id"), F.col("question"), F.array(F.struct(
        F.get("answers.text", F.lit(0)).alias("text"), at.cast("int").alias("answer_start"))).alias("answers"))
    paragraph = F.struct(F.col("context"), F.array(qa_row).alias("qas"))
    return d.select(F.col("lang").alias("file"), F.array(F.struct(F.array(paragraph).alias("paragraphs"))).alias("data"))


def qa_flatten(spark, sf):
    """One row per question of the English part, with its language by id."""
    d = qj.only_language(qj.flatten(_nested(spark, sf)), "en")
    return qj.language_of(d).select("id", "lang", "article_no", "paragraph_no", "qa_no", "question", F.length("context").alias("n"))


def qa_rejects(spark, sf):
    """Questions whose answer does not stand at its offset."""
    return qj.rejects(qj.flatten(_nested(spark, sf))).select("id", F.get("answers.answer_start", F.lit(0)).alias("answer_start"))


QUERIES = {f.__name__: f for f in (qa_windows, qa_span_labels, qa_nbest, qa_nbest_examples, qa_unmatched, qa_null, qa_em_f1, qa_metric, qa_metric_missing, nbest_json,
                                    qa_flatten, qa_rejects)}
