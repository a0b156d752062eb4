"""Session defaults used by the bench, the tests and the entry module."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "procspark", **conf: str) -> SparkSession:
    """Session with AQE on and UTC time.

    ``master`` is for local runs; spark-submit picks it on a cluster. AQE merges small
    shuffle partitions but does not cut large ones, so for large data give a
    ``shuffle_partitions`` of about the shuffled bytes over 128 MB.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
