"""The operator inputs, as views over the test tables.

Views cover their whole tables, but for `turn_pairs`: a turn without its partner is in no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from procspark.functions.ranking import range_bounds, spread, with_range_position
from procspark.functions.tiles import Shape
from procspark.functions.tokens import SPACE, words
from procspark.operators import dedup_split as ds, eventlog as ev
from procspark.operators.qa_windows import eval_features
from procspark.sources.tables import read_input

CASE = ("model_id", "revision_id", "case_id")


table = read_input


def joined(arr: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(arr, lambda x: x.cast("string")), sep)


def rounded(c: Column) -> Column:
    return F.round(c + F.lit(0.0), 6)


# --- process tables -------------------------------------------------------

def log(spark: SparkSession, sf: str) -> DataFrame:
    """Event log: a model is a user, its revision the week, a case one day."""
    day = F.to_date("ts")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("model_id"),
        F.date_sub(day, F.weekday(day)).cast("string").alias("revision_id"),
        F.concat_ws("|", F.col("user_id").cast("string"), day.cast("string")).alias("case_id"),
        "ts", "event_id", F.col("event_type").alias("activity"))


def traces(spark: SparkSession, sf: str) -> DataFrame:
    """Traces with activity set; anomalies are the positions of ``error``."""
    events = log(spark, sf)
    built = ev.with_activity_sets(ev.traces(events, CASE), events)
    at = F.filter(F.sequence(F.lit(0), F.size("trace") - 1), lambda i: F.get("trace", i) == "error")
    return built.withColumn("label", at)


def clean_traces(spark: SparkSession, sf: str) -> DataFrame:
    return ds.keep_multi_activity(ds.remove_duplicates(traces(spark, sf))).withColumn("id", ds.group_id())


def prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """All prefixes of all traces; copies are still in."""
    return ev.prefixes(ds.keep_multi_activity(traces(spark, sf)))


def models(spark: SparkSession, sf: str) -> DataFrame:
    """One row per model with activity set, neighbour pairs, and a flat tree text."""
    events = log(spark, sf)
    df = ev.with_activity_sets(ev.directly_follows(events, CASE), events)
    leaves = F.array_join(F.transform("unique_activities", lambda a: F.concat(F.lit("'"), a, F.lit("'"))), ", ")
    return df.withColumn("pt", F.concat(F.lit("-> ( "), leaves, F.lit(" )")))


def id_list(spark: SparkSession, sf: str) -> DataFrame:
    """(id, split): every model revision, by the last digit of the user."""
    digit = F.col("model_id").cast("bigint") % 10
    return (log(spark, sf).select("model_id", "revision_id").distinct()
            .select(ds.group_id().alias("id"), F.when(digit < 7, "train").when(digit < 9, "val")
                    .otherwise("test").alias("split")))


# --- texts ----------------------------------------------------------------

def documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Documents; the test file has one row group, so its rows are spread first."""
    return spread(table(spark, sf, "documents").select(*(cols or ("*",))), "doc_id")


def doc_words(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf, "doc_id", "lang", "source", "text").select(
        "doc_id", "lang", "source", words(F.col("text")).alias("tokens"))


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn, with one id in (conversation, turn) order."""
    return table(spark, sf, "conversations").withColumn("turn_id", F.col("conv_id") * 100_000 + F.col("turn"))


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, user, assistant): each assistant turn with the turn before it."""
    conv = table(spark, sf, "conversations")
    user = conv.filter(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"),
                                                       F.col("text").alias("user"))
    return (conv.filter(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("assistant"))
            .join(user, ["conv_id", "turn"]))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Word labels and predictions of each document; every 11th word is ignored."""
    ids = lambda f: F.transform("tokens", lambda t, i: f(i).cast("int"))
    gold = lambda i: (F.col("doc_id") + i.cast("bigint") * i) % 7
    pred = lambda i: F.when((i * 3 + F.col("doc_id")) % 5 == 0, (gold(i) + 1) % 7).otherwise(gold(i))
    return doc_words(spark, sf).select(
        "doc_id", "lang", ids(pred).alias("preds"),
        ids(lambda i: F.when(i % 11 == 0, -100).otherwise(gold(i))).alias("labels"))


# --- extractive QA --------------------------------------------------------

def qa_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as context; the answer is up to three words from a chosen one on, null without a word."""
    d = documents(spark, sf).withColumn("words", words(F.col("text")))
    n = F.size("words")
    k = F.try_mod(F.col("doc_id") * 31, n).cast("int")
    upto = lambda m: F.length(F.array_join(F.slice("words", 1, m), ""))  # noqa: E731  characters of the first m words
    d = d.withColumn("b", F.when(k >= 0, upto(k + 1) - F.length(F.ltrim(F.get("words", k), F.lit(SPACE))))).withColumn(
        "e", F.when(k >= 0, upto(F.least(k + 3, n))))
    return d.select(
        F.col("doc_id").alias("id"), F.col("text").alias("context"), "lang",
        F.concat(F.lit("  "), "lang", F.lit(" "), "source", F.lit(" "), F.col("n_chars").cast("string"))
        .alias("question"),
        F.struct(F.array(F.substring(F.col("text"), F.col("b") + 1, F.col("e") - F.col("b"))).alias("text"),
                 F.array("b").alias("answer_start")).alias("answers"))


def qa_answered(spark: SparkSession, sf: str) -> DataFrame:
    """The examples that can have an answer: a document without a word is none, as in the SQL twins."""
    return qa_examples(spark, sf).where(F.col("context").rlike(r"\S"))


def qa_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Windows with pseudo-logits, integer formulas of (document, window, position)."""
    feats = eval_features(qa_examples(spark, sf).select("id", "context", "question"))
    pos = F.sequence(F.lit(0), F.col("n_positions") - 1)
    d, w = F.col("example_id"), F.col("window_no")
    return feats.select(
        "example_id", "window_no", "offset_mapping", "context_tokens", "context_pos",
        F.transform(pos, lambda p: ((d * 31 + w * 17 + p * 13) % 101).cast("double")).alias("start_logits"),
        F.transform(pos, lambda p: ((d * 7 + w * 11 + p * 29) % 103).cast("double")).alias("end_logits"))


# --- vectors --------------------------------------------------------------

def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def placed_embeddings(spark: SparkSession, sf: str, out: str) -> tuple[DataFrame, int, int]:
    """Vectors with their place in id order, how many there are, and their length."""
    n, dims = table(spark, sf, "embeddings").agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    emb = embeddings(spark, sf)
    return with_range_position(emb, [F.col("vec_id")], out, bounds=range_bounds(emb, F.col("vec_id"), n=n)), n, dims


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Shape]:
    """First and second half in id order as aligned sides, and their shape: row i of each is a true pair.

    Of an odd number of rows the last one stays on the second side, without a partner.
    """
    emb, n, dims = placed_embeddings(spark, sf, "pair_id")
    half = F.lit(n // 2).cast("bigint")
    return emb.filter(F.col("pair_id") < half), emb.filter(F.col("pair_id") >= half).withColumn(
        "pair_id", F.col("pair_id") - half), (n // 2, n - n // 2, dims)


def sided(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides of the true pairs."""
    x, y, _ = halves(spark, sf)
    return x.withColumn("side", F.lit(0)).unionByName(y.join(x.select("pair_id"), "pair_id", "left_semi").withColumn("side", F.lit(1)))


def hidden_states(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as states of 4 layers * 5 positions per row, masked by row."""
    v = F.col("vec_id")
    return embeddings(spark, sf).select(
        F.floor(v / 20).alias("row_id"), (F.floor(v / 5) % 4).cast("int").alias("layer"),
        (v % 5).cast("int").alias("pos"), "vec",
        F.when(v % 5 < 1 + F.floor(v / 20) % 5, 1).otherwise(0).alias("mask"))


def sentence_tokens(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, Shape]:
    """Groups of five vectors in id order as sentences, split into aligned halves; the last may be shorter.

    Of an odd number of sentences the last one stays on the second side, without a partner.
    """
    emb, n, dims = placed_embeddings(spark, sf, "_at")
    first = (n + 4) // 5 // 2
    half = F.lit(first).cast("bigint")
    tok = emb.select(F.floor(F.col("_at") / 5).alias("pair_id"), (F.col("_at") % 5).cast("int").alias("pos"), "vec",
                     F.lit(1).alias("mask"))
    return (tok.filter(F.col("pair_id") < half),
            tok.filter(F.col("pair_id") >= half).withColumn("pair_id", F.col("pair_id") - half),
            (5 * first, n - 5 * first, dims))


def task_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of two tasks (even and odd ids) and two splits."""
    return embeddings(spark, sf).select(
        F.col("vec_id").alias("row_id"), "vec", F.col("label").alias("labels"),
        F.when(F.col("vec_id") % 2 == 0, "trace").otherwise("activity").alias("task"),
        F.when(F.col("vec_id") % 5 < 3, "val").otherwise("test").alias("split"))
