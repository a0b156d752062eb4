"""Nested QA JSON: data[].paragraphs[].qas[] -> one row per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from procspark.functions.ranking import with_position

# Language code -> prefix of the question ids.
LANGUAGES = {
    "ar": "arabic", "bn": "bengali", "en": "english", "fi": "finnish", "id": "indonesian",
    "ko": "korean", "ru": "russian", "sw": "swahili", "te": "telugu",
}

SCHEMA = ("data array<struct<paragraphs:array<struct<context:string,qas:array<struct<id:string,"
          "question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>")


ARTICLE = '"paragraphs"'  # fixed value: the key that each article has once; inside a string its quotes are escaped
PARAGRAPHS = SCHEMA[len("data array<struct<paragraphs:"):-len(">>")]


def read_nested(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The questions of nested files, with their place ``(file, article_no, paragraph_no, qa_no)``.

    Files are read as text that the articles' key cuts into records, so one large file is many tasks; a record begins with
    the paragraphs of its article, which are parsed, and the rest of it is passed over. Records are numbered by the
    start of their split and their place in it. A record that does not parse fails the job.
    """
    text = spark.read.option("lineSep", ARTICLE).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"^\s*:\s*", "").alias("_text"))
    placed = with_position(text, ["file"], [F.col("_id")], F.col("_split"), "_at")
    parsed = F.coalesce(F.from_json("_text", PARAGRAPHS), F.raise_error(F.concat(
        F.lit("no paragraphs in article "), (F.col("_at") - 1).cast("string"), F.lit(" of "), F.col("file"))).cast(PARAGRAPHS))
    own = F.when(F.col("_at") > 0, parsed)  # what stands before the first article is none
    return _questions(placed.select("file", (F.col("_at") - 1).cast("int").alias("article_no"), own.alias("paragraphs")))


def flatten(raw: DataFrame) -> DataFrame:
    """(file, data) to one row per question with its place ``(file, article_no, paragraph_no, qa_no)``."""
    # the outer form, because the plain one adds a filter that computes the data twice
    articles = raw.select("file", F.posexplode_outer("data").alias("article_no", "a")).where("article_no is not null")
    return _questions(articles.select("file", "article_no", F.col("a.paragraphs").alias("paragraphs")))


def _questions(articles: DataFrame) -> DataFrame:
    paragraphs = articles.select("file", "article_no", F.posexplode("paragraphs").alias("paragraph_no", "p"))
    return (paragraphs.select("file", "article_no", "paragraph_no", F.col("p.context").alias("context"),
                              F.posexplode("p.qas").alias("qa_no", "q"))
            .select("file", "article_no", "paragraph_no", "qa_no", F.col("q.id").alias("id"), "context",
                    F.col("q.question").alias("question"),
                    F.struct(F.col("q.answers.text").alias("text"),
                             F.col("q.answers.answer_start").alias("answer_start")).alias("answers")))


def language_of(df: DataFrame) -> DataFrame:
    """Add ``lang`` from the id prefix; questions of other languages go."""
    codes = F.create_map(*[F.lit(x) for code, name in LANGUAGES.items() for x in (name, code)])
    return df.withColumn("lang", F.try_element_at(codes, F.substring_index("id", "-", 1))).where("lang is not null")


def only_language(df: DataFrame, lang: str) -> DataFrame:
    return df.filter(F.substring_index("id", "-", 1) == LANGUAGES[lang])


def answers_match(context: str = "context", answers: str = "answers") -> Column:
    """Every answer text stands in the context at its offset."""
    pairs = F.arrays_zip(F.col(f"{answers}.text").alias("text"), F.col(f"{answers}.answer_start").alias("at"))
    return F.forall(pairs, lambda a: F.substring(F.col(context), a["at"] + 1, F.length(a["text"])) == a["text"])


def checked(df: DataFrame) -> DataFrame:
    """Fail the job on a row whose answers do not match their offsets."""
    bad = F.raise_error(F.concat(F.lit("answer does not match its offset: "), F.col("id")))
    return df.filter(F.when(answers_match(), True).otherwise(bad.cast("boolean")))


def rejects(df: DataFrame) -> DataFrame:
    return df.filter(~answers_match())


def load_qa(spark: SparkSession, paths: dict[str, str], split: str, lang: str | None = "en",
            strict: bool = True) -> DataFrame:
    """(id, context, question, answers) of one split (``train`` or ``dev``) and language."""
    df = read_nested(spark, paths[split])
    df = df if lang is None else only_language(df, lang)
    df = checked(df) if strict else df.filter(answers_match())
    return df.select("id", "context", "question", "answers")
