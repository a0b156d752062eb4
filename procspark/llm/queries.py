"""The registered queries of this subpackage: every operator over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from procspark.llm import oracle
from procspark.llm.chains import repeated_passages
from procspark.llm.crf import score_quality
from procspark.llm.fertility import fertility_rules
from procspark.llm.licenses import scan_licenses
from procspark.llm.manifest import merkle_manifest, without_newlines
from procspark.llm.mixing import mix_documents
from procspark.llm.parity import jaccard_components
from procspark.llm.pii import find_pii
from procspark.llm.secrets import find_secrets
from procspark.llm.shards import shard_documents
from procspark.llm.store import shared_folder
from procspark.llm.warc import read_archive, write_archive
from procspark.llm.whitening import whiten
from procspark.llm.winnow import decontaminate


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_soft_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return mix_documents(docs, table(spark, sf, "labels"))


def op2_license_index(spark: SparkSession, sf: str) -> DataFrame:
    return scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))


def op3_weak_pii(spark: SparkSession, sf: str) -> DataFrame:
    return find_pii(table(spark, sf, "documents"))


def op4_fertility(spark: SparkSession, sf: str) -> DataFrame:
    return fertility_rules(table(spark, sf, "documents").select("doc_id", "text", "lang")).drop("lang")


def op5_chained_passages(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_passages(table(spark, sf, "documents"), exact=True)


def op6_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf, "benchmark")).drop("text")


def op7_parity_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(table(spark, sf, "documents")).drop("_row")


def op8_line_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return score_quality(docs, table(spark, sf, "labels")).drop("text")


def op9_secret_cnn(spark: SparkSession, sf: str) -> DataFrame:
    return find_secrets(table(spark, sf, "documents").select("doc_id", "text"))


def op10_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/procspark-{uuid.uuid4().hex}/warc"
    write_archive(table(spark, sf, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_jacobi_davidson(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings").select("vec_id", "embedding")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_sampled_splitters(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(table(spark, sf, "documents").select("doc_id", "text"))


def op13_level_strings(spark: SparkSession, sf: str) -> DataFrame:
    return merkle_manifest(table(spark, sf, "documents"), without_newlines())


QUERIES = {f.__name__: f for f in (op1_soft_mixing, op2_license_index, op3_weak_pii, op4_fertility, op5_chained_passages, op6_winnowing, op7_parity_sketch, op8_line_crf, op9_secret_cnn, op10_warc_archive,
                                    op11_jacobi_davidson, op12_sampled_splitters, op13_level_strings)}
SQL = oracle.SQL
