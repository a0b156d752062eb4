"""Extractive QA outputs: logits -> n-best answers -> SQuAD scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from procspark.functions.arrays import fsum, let
from procspark.functions.tokens import SPACE

# Fixed values of the SQuAD answer normalisation.
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
ARTICLES = r"(?U)\b(a|an|the)\b"
NO_ANSWER = "empty"
WINDOWS = 512  # windows scored at a time


CANDIDATES = ("array<struct<neg:double,window_no:int,start_rank:int,end_rank:int,start_logit:double,end_logit:double,"
              "begin:int,finish:int,text:string>>")


def _best_columns(x: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest of the first ``size`` values of each row, best first; of equal values the later one first."""
    flipped = np.where(np.arange(x.shape[1]) < size[:, None], -x, np.inf)[:, ::-1]
    return x.shape[1] - 1 - np.argsort(flipped, axis=1, kind="stable")[:, :n]


def _padded(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) values of a list column, and the lengths."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), max(int(size.max(initial=1)), 1)))
    out[np.arange(out.shape[1]) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out, size


def _window_spans(batch: pa.RecordBatch, n_best: int, max_answer_length: int, with_text: bool) -> pa.ListArray:
    """CANDIDATES of each window of a batch, the n best, from all pairs of its n best starts and ends at once."""
    col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
    (s, size), (e, size_e) = _padded(col["start_logits"]), _padded(col["end_logits"])
    rows = np.arange(len(s))[:, None]
    i, j = _best_columns(s, size, n_best), _best_columns(e, size_e, n_best)
    offs = col["offset_mapping"]
    first = offs.offsets.to_numpy()[:-1, None] - offs.offsets[0].as_py()
    n_offs = offs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)[:, None]
    spans = offs.values.slice(offs.offsets[0].as_py(), offs.offsets[-1].as_py() - offs.offsets[0].as_py())
    there = spans.is_valid().to_numpy(zero_copy_only=False)
    begins, ends = (spans.field(k).fill_null(0).to_numpy(zero_copy_only=False) for k in (0, 1))

    def at(values: np.ndarray, p: np.ndarray) -> np.ndarray:
        return values[np.minimum(first + p, len(values) - 1)] if len(values) else np.zeros(p.shape, values.dtype)

    usable_i = (i < size[:, None]) & (i < n_offs) & at(there, i)
    usable_j = (j < size_e[:, None]) & (j < n_offs) & at(there, j)
    if "max_context" in col:  # a null map allows all, a place it does not name is out
        for k in np.flatnonzero(col["max_context"].is_valid().to_numpy(zero_copy_only=False)):
            flags = dict(col["max_context"][k].as_py())
            usable_i[k] &= [bool(flags.get(str(p))) for p in i[k]]
    reach = j[:, None, :] - i[:, :, None]
    good = usable_i[:, :, None] & usable_j[:, None, :] & (reach >= 0) & (reach < max_answer_length)
    neg = np.where(good, -(s[rows, i][:, :, None] + e[rows, j][:, None, :]), np.inf).reshape(len(s), -1)
    best = np.argsort(neg, axis=1, kind="stable")[:, :n_best]  # equal scores by start rank, then end rank
    kept = np.take_along_axis(good.reshape(len(s), -1), best, 1)
    row, _ = np.nonzero(kept)
    pick = best[kept]
    si, ej = pick // j.shape[1], pick % j.shape[1]
    begin, finish = at(begins, i)[row, si], at(ends, j)[row, ej]
    text = _texts(col, row, begin, finish, at(ends, col["context_pos"].to_numpy()[:, None])[:, 0]) if with_text else [None] * len(row)
    fields = {"neg": neg[row, pick], "window_no": col["window_no"].to_numpy()[row], "start_rank": si.astype("int32"), "end_rank": ej.astype("int32"),
              "start_logit": s[row, i[row, si]], "end_logit": e[row, j[row, ej]], "begin": begin, "finish": finish}
    found = pa.StructArray.from_arrays([*[pa.array(v) for v in fields.values()], pa.array(text, pa.string())], [*fields, "text"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept.sum(1))]).astype("int32")), found)


def _texts(col: dict, row: np.ndarray, begin: np.ndarray, finish: np.ndarray, first_end: np.ndarray) -> list[str]:
    """Answers cut from the windows' own tokens; ``first_end``: where the first token of each window ends in the context."""
    tokens = col["context_tokens"]
    whole = pc.binary_join(tokens, "").to_pylist()
    at = tokens.offsets.to_numpy()
    own = tokens.values.slice(at[0], at[-1] - at[0])  # of these windows, not of the whole batch
    at = at - at[0]
    sizes = pc.utf8_length(own).fill_null(0).to_numpy(zero_copy_only=False)
    first = np.where(np.diff(at) > 0, sizes[np.minimum(at[:-1], len(sizes) - 1)], 0) if len(sizes) else np.zeros(len(at) - 1, int)
    start = first_end - first
    return [whole[r][a - start[r]:b - start[r]].lstrip(SPACE) if b > a else "" for r, a, b in zip(row, begin, finish)]


def feature_candidates(features: DataFrame, n_best: int = 20, max_answer_length: int = 30,
                       max_context: str | None = None, with_text: bool = False) -> DataFrame:
    """(example_id, spans): the best ``n_best`` valid (start, end) spans of each feature as one sorted list.

    Input: ``example_id, window_no, start_logits, end_logits, offset_mapping``. Batches of features are scored as
    matrices; only a feature's best spans leave it, and no other span of it can be among the example's best.
    ``with_text`` adds the answer text from the window's own ``context_tokens``. A feature without any
    valid span has an empty list.
    """
    more = [F.col(max_context).alias("max_context")] if max_context is not None else []
    logits = [F.col(c).cast("array<double>").alias(c) for c in ("start_logits", "end_logits")]
    src = features.select("example_id", F.col("window_no").cast("int").alias("window_no"), *logits, "offset_mapping", *more,
                          *(["context_tokens", F.col("context_pos").cast("int").alias("context_pos")] if with_text else []))

    def run(batches):
        for batch in batches:
            part = None
            for i in range(0, batch.num_rows, WINDOWS):
                part = batch.slice(i, WINDOWS)
                yield pa.RecordBatch.from_arrays([part.column(0), _window_spans(part, n_best, max_answer_length, with_text)], ["example_id", "spans"])
            del batch, part  # before the next one comes

    return src.mapInArrow(run, f"example_id {src.schema['example_id'].dataType.simpleString()}, spans {CANDIDATES}")


def min_null(features: DataFrame) -> DataFrame:
    """Smallest score of position 0 over the windows of an example, first window on ties."""
    s, e = F.get("start_logits", F.lit(0)), F.get("end_logits", F.lit(0))
    best = F.min(F.struct((s + e).alias("score"), "window_no", s.alias("start_logit"), e.alias("end_logit")))
    return (features.groupBy("example_id").agg(best.alias("n"))
            .select("example_id", F.col("n.score").alias("null_score"),
                    F.col("n.start_logit").alias("null_start"), F.col("n.end_logit").alias("null_end")))


def nbest(features: DataFrame, examples: DataFrame | None = None, negatives: bool = False, n_best: int = 20,
          max_answer_length: int = 30, max_context: str | None = None) -> DataFrame:
    """``predictions`` per example: array of struct<text, score, start_logit, end_logit, probability>.

    Without ``examples`` the answer texts come from the windows' ``context_tokens``
    and ``context_pos``, so no context is shuffled. With ``examples``
    (``example_id``, ``context``) they are cut from the contexts by offset,
    examples without any feature get the fallback answer, and features of other examples go (``unmatched`` lists both). With ``negatives`` the
    best null joins the list, last among equals, and is put back when the cut
    removed it.
    """
    own_text = examples is None
    cand = feature_candidates(features, n_best, max_answer_length, max_context, with_text=own_text)
    best = cand.groupBy("example_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("spans"))), 1, n_best).alias("spans"))
    out = best if own_text else examples.join(best, "example_id", "left")
    out = out.withColumn("spans", F.coalesce("spans", F.array().cast(CANDIDATES)))
    if negatives:
        out = out.join(min_null(features), "example_id", "left")
        last = F.lit(2**31 - 1)
        null = F.struct((-F.col("null_score")).alias("neg"), last.alias("window_no"), last.alias("start_rank"), last.alias("end_rank"),
                        F.col("null_start").alias("start_logit"), F.col("null_end").alias("end_logit"),
                        F.lit(0).alias("begin"), F.lit(0).alias("finish"), F.lit("").alias("text"))
        with_null = F.when(F.col("null_score").isNull(), F.col("spans")).otherwise(
            F.sort_array(F.concat("spans", F.array(null))))
        out = out.withColumn("spans", let(with_null, lambda a: let(F.slice(a, 1, n_best), lambda cut: F.when(
            F.exists(cut, lambda p: (p["begin"] == 0) & (p["finish"] == 0)) | F.col("null_score").isNull(),
            cut).otherwise(F.concat(cut, F.array(null))))))

    def answer(p: Column) -> Column:
        return p["text"] if own_text else F.substring(
            F.col("context"), p["begin"] + 1, F.greatest(p["finish"] - p["begin"], F.lit(0)))

    preds = F.transform("spans", lambda p: F.struct(
        answer(p).alias("text"),
        (-p["neg"]).alias("score"), p["start_logit"].alias("start_logit"), p["end_logit"].alias("end_logit")))
    fallback = F.array(F.struct(F.lit(NO_ANSWER).alias("text"), F.lit(0.0).alias("score"),
                                F.lit(0.0).alias("start_logit"), F.lit(0.0).alias("end_logit")))

    def lone_blank(a: Column) -> Column:
        return (F.size(a) == 0) | ((F.size(a) == 1) & (F.get(a, F.lit(0))["text"] == ""))

    filled = let(preds, lambda a: F.when(lone_blank(a), F.concat(fallback, a)).otherwise(a))

    def with_prob(a: Column) -> Column:
        top_score = F.array_max(F.transform(a, lambda p: p["score"]))
        return let(top_score, lambda m: let(
            fsum(F.transform(a, lambda p: F.exp(p["score"] - m))), lambda z: F.transform(
                a, lambda p: F.struct(p["text"].alias("text"), p["score"].alias("score"),
                                      p["start_logit"].alias("start_logit"),
                                      p["end_logit"].alias("end_logit"),
                                      (F.exp(p["score"] - m) / z).alias("probability")))))

    extra = ["null_score"] if negatives else []
    return out.select("example_id", *extra, let(filled, with_prob).alias("predictions"))


def unmatched(features: DataFrame, examples: DataFrame) -> DataFrame:
    """(example_id, n_features, n_examples) of the examples without a feature, or with several rows, and of features without example."""
    counts = features.select("example_id", F.lit(1).alias("f"), F.lit(0).alias("e")).unionByName(
        examples.select("example_id", F.lit(0).alias("f"), F.lit(1).alias("e")))
    return (counts.groupBy("example_id").agg(F.sum("f").alias("n_features"), F.sum("e").alias("n_examples"))
            .where("n_features = 0 or n_examples <> 1"))


def best_answers(nbest_df: DataFrame, negatives: bool = False, null_threshold: float = 0.0) -> DataFrame:
    """(id, prediction_text); with ``negatives`` also score_diff and no_answer_probability.

    The null answer wins when its score beats the best non-empty answer by more
    than the threshold, or when there is no non-empty answer.
    """
    first = F.get("predictions", F.lit(0))["text"]
    ident = F.col("example_id").alias("id")
    if not negatives:
        return nbest_df.select(ident, first.alias("prediction_text"))
    non_null = F.get(F.filter("predictions", lambda p: p["text"] != ""), F.lit(0))
    scored = (nbest_df.withColumn("_best", non_null)
              .withColumn("score_diff", F.col("null_score") - F.col("_best.start_logit") - F.col("_best.end_logit")))
    null_wins = F.col("_best").isNull() | F.coalesce(F.col("score_diff") > null_threshold, F.lit(False))
    return scored.select(ident, F.when(null_wins, "").otherwise(F.col("_best.text")).alias("prediction_text"),
                         F.lit(0.0).alias("no_answer_probability"), "score_diff")


def nbest_json(nbest_df: DataFrame) -> DataFrame:
    """(id, nbest) with the list as JSON text."""
    slim = F.transform("predictions", lambda p: F.struct(
        p["start_logit"].alias("start_logit"), p["end_logit"].alias("end_logit"),
        p["text"].alias("text"), p["probability"].alias("probability")))
    return nbest_df.select(F.col("example_id").alias("id"), F.to_json(slim).alias("nbest"))


def answer_tokens(text: Column) -> Column:
    """Lower case, no punctuation, no articles, split at white space."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), PUNCTUATION, ""), ARTICLES, " ")
    return F.filter(F.split(plain, r"(?U)\s+"), lambda t: t != "")


def _token_f1(pred: Column, gold: Column) -> Column:
    def times(xs: Column, t: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x == t))

    common = F.aggregate(F.array_distinct(pred), F.lit(0),
                         lambda a, t: a + F.least(times(pred, t), times(gold, t)))
    return let(common.cast("double"), lambda c: F.when(c > 0, 2.0 * c / (F.size(pred) + F.size(gold))).otherwise(0.0))


def squad_scores(predictions: DataFrame, references: DataFrame, answers: str = "answers",
                 keep: Sequence[str] = ()) -> DataFrame:
    """Per id: exact match and token F1, each the best over the gold answers.

    A reference without a prediction scores 0, as does a null prediction. ``keep`` names reference columns
    to carry along, such as the language.
    """
    gold = references.select("id", *keep, F.col(f"{answers}.text").alias("_gold"))
    joined = gold.join(predictions.select("id", "prediction_text"), "id", "left")
    answered = F.col("prediction_text").isNotNull()

    def best(score) -> Column:
        return let(answer_tokens(F.col("prediction_text")), lambda p: F.array_max(
            F.transform("_gold", lambda g: let(answer_tokens(g), lambda t: score(p, t)))))

    def scored(score) -> Column:
        return F.when(answered, F.coalesce(best(score), F.lit(0.0))).otherwise(0.0)

    return joined.select("id", *keep, scored(lambda p, t: (F.array_join(p, " ") == F.array_join(t, " ")).cast("double"))
                         .alias("exact_match"), scored(_token_f1).alias("f1"))


def squad_metric(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg((F.avg("exact_match") * 100).alias("exact_match"),
                                   (F.avg("f1") * 100).alias("f1"), F.count(F.lit(1)).alias("n"))
