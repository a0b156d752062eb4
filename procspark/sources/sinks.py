"""Result sinks. Each writes partitions, so no result passes one task.

Writing again replaces what the same data set and epoch (and run) had and leaves the rest, so a task or job that is
repeated leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

METRIC_COLUMNS = ["run", "dataset", "split", "epoch", "metric", "value"]


def _replace(df: DataFrame, path: str, parts: list[str], kind: str, **options) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options)
    getattr(writer.partitionBy(*parts), kind)(path)


def store_predictions(df: DataFrame, path: str, row_id: str = "row_id", preds: str = "preds", labels: str = "labels",
                      dataset: str = "dataset_name", epoch: int = 0) -> None:
    """CSV ``ids, prediction, labels`` under ``dataset=.../epoch=...``."""
    _replace(df.select(F.col(row_id).alias("ids"), F.col(preds).alias("prediction"), F.col(labels).alias("labels"),
                       F.col(dataset).alias("dataset"), F.lit(epoch).alias("epoch")), path, ["dataset", "epoch"], "csv", header=True)


def store_generations(df: DataFrame, path: str, labels: str = "label_strings", preds: str = "preds",
                      dataset: str = "dataset_name", epoch: int = 0) -> None:
    """Parquet ``labels, preds`` (and the row id if there is one) under ``dataset=.../epoch=...``."""
    keep = [c for c in ("row_id",) if c in df.columns]
    _replace(df.select(*keep, F.col(labels).alias("labels"), F.col(preds).alias("preds"),
                       F.col(dataset).alias("dataset"), F.lit(epoch).alias("epoch")), path, ["dataset", "epoch"], "parquet")


def store_nbest(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines ``id, nbest`` with the n-best list as nested records."""
    slim = F.transform("predictions", lambda p: F.struct(
        p["start_logit"].alias("start_logit"), p["end_logit"].alias("end_logit"), p["text"].alias("text"),
        p["probability"].alias("probability")))
    df.select(F.col("example_id").alias("id"), slim.alias("nbest")).write.mode(mode).json(path)


def log_metrics(metrics: DataFrame, path: str, run: str, epoch: int = 0, dataset: str = "dataset_name",
                split: str = "split") -> None:
    """``evaluate`` rows into a metrics table by run and epoch."""
    rows = metrics.select(F.lit(run).alias("run"), F.col(dataset).alias("dataset"), F.col(split).alias("split"),
                          F.lit(epoch).alias("epoch"), "metric", F.col("value").cast("double").alias("value"))
    _replace(rows.select(*METRIC_COLUMNS), path, ["run", "epoch"], "parquet")
