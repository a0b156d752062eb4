"""Tables cut off from their lineage, and keys for rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one on a local master, whose only machine
    this is; on a cluster an error, as other machines would not see the folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="procspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later jobs and lost executors start there."""
    path = f"{shared_folder(df.sparkSession)}/procspark-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str = "doc_id", text: str = "text") -> Column:
    """Key of a row by its id and text: repeated ids with other texts stay apart, equal rows get equal results."""
    return F.xxhash64(F.col(id_col), F.col(text)).alias("_row")


def labelled_rows(docs: DataFrame, marks: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, and the other columns of marks) of ``most`` labelled rows at most, by a hash of their ids.

    docs has (doc_id, text), marks one row an id. Rows that repeat id and text count once, and the bound holds after
    the join, so an id that stands in very many rows takes no more than its place in that order.
    """
    some = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    keyed = docs.join(F.broadcast(some), "doc_id").withColumn("_row", row_key())  # at most ``most`` small rows
    first = keyed.select("doc_id", "_row").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_row").limit(most).select("_row")
    return stash(keyed.join(F.broadcast(first), "_row").dropDuplicates(["_row"]).drop("_row"), "labelled")
