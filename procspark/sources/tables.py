"""Explicit schemas and readers for process tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

_IDS = "row_id bigint, model_id string, revision_id string, unique_activities string"

SCHEMAS = {
    "pairs": f"{_IDS}, eventually_follows struct<src:string,dst:string>, out_of_order boolean, trace array<string>",
    "traces": f"{_IDS}, trace array<string>, label array<int>",
    "prefixes": f"{_IDS}, trace array<string>, prefix array<string>, next string",
    "models": "model_id string, revision_id string, unique_activities string, dfg string, pt string",
    "id_split": "id string, split string",
}

#: The tables that the named queries read.
INPUTS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
}


def read_input(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An input table by its declared schema, so no file is opened to plan a query."""
    return spark.read.schema(INPUTS[name]).parquet(f"{folder}/{name}.parquet")


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Parquet with a declared schema, so columns and filters reach the scan."""
    return spark.read.schema(schema(name)).parquet(path)


def read_csv(spark: SparkSession, path: str | list[str], columns: T.StructType | str) -> DataFrame:
    """CSV with a header, quoted multi-line fields and doubled quotes."""
    return (spark.read.schema(columns).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').csv(path))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """Discovery table: one row per process model, sets and pairs as text."""
    return read_csv(spark, path, schema("models"))
