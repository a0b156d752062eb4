"""Documents to a training mixture: quality, one of each near copy, no benchmark passages, no secrets, target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from procspark.llm.crf import score_quality
from procspark.llm.mixing import mix_documents
from procspark.llm.parity import one_of_each
from procspark.llm.secrets import find_secrets
from procspark.llm.store import stash
from procspark.llm.winnow import decontaminate

#: Domains by (quality, toxic) that the first stage leaves, and their shares of the tokens.
DOMAINS = {"good": (1, 0), "good_toxic": (1, 1)}
TARGETS = {"good": 0.985, "good_toxic": 0.015}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels).where("predicted = 1").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of linked texts."""
    return one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not contaminated").select(*docs.columns)


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced; n_chars counts the new text."""
    found = find_secrets(docs, keep_text=True)
    text = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        text["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return found.withColumns(text).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domain chances and the rate of each document."""
    return mix_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, domains=DOMAINS)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark_free", benchmark_free),
          ("secrets_masked", secrets_masked), ("mixture", mixture)]

#: Trained models and fitted rates are not expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
