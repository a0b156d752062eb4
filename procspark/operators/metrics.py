"""Evaluation metrics per dataset, as grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from procspark.functions.arrays import IGNORE, argmax, cross_entropy

Metric = Callable[..., DataFrame]


def with_preds(df: DataFrame, logits: str = "logits") -> DataFrame:
    return df.withColumn("preds", argmax(F.col(logits)))


def confusion(df: DataFrame, by: Sequence[str], preds: str = "preds", labels: str = "labels") -> DataFrame:
    """Row count per (by, label, pred); everything below needs only this small table."""
    return (df.filter(F.col(labels) != IGNORE)
            .groupBy(*by, F.col(labels).cast("int").alias("label"), F.col(preds).cast("int").alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_counts(df: DataFrame, by: Sequence[str], preds: str = "preds", labels: str = "labels") -> DataFrame:
    """tp, fp, fn per class."""
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    as_label = F.struct(F.col("label").alias("cls"), hit.alias("tp"), F.lit(0).cast("bigint").alias("fp"),
                        (F.col("n") - hit).alias("fn"))
    as_pred = F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("tp"),
                       (F.col("n") - hit).alias("fp"), F.lit(0).cast("bigint").alias("fn"))
    return (confusion(df, by, preds, labels).select(*by, F.inline(F.array(as_label, as_pred)))
            .groupBy(*by, "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0))


def _accuracy() -> Column:
    return F.sum("tp") / F.sum(F.col("tp") + F.col("fn"))


def _micro_f1() -> Column:
    return _f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))


def _macro_f1() -> Column:
    return F.avg(_f1(F.col("tp"), F.col("fp"), F.col("fn")))


# Metrics that are one aggregate over the per-class counts.
CLASS_METRICS = {"acc": _accuracy, "micro_f1": _micro_f1, "macro_f1": _macro_f1}


def _over_classes(name: str) -> Metric:
    def metric(df: DataFrame, by: Sequence[str] = (), preds: str = "preds", labels: str = "labels",
               classes: Sequence[int] | None = None) -> DataFrame:
        counts = class_counts(df, by, preds, labels)
        if classes is not None:
            counts = counts.filter(F.col("cls").isin(list(classes)))
        return counts.groupBy(*by).agg(CLASS_METRICS[name]().alias("value"))

    metric.__name__ = name
    metric.__doc__ = "Value per group, over the classes that occur, or those of ``classes`` that do."
    return metric


accuracy, micro_f1, macro_f1 = (_over_classes(n) for n in CLASS_METRICS)


def mean_loss(df: DataFrame, by: Sequence[str] = (), logits: str = "logits", labels: str = "labels") -> DataFrame:
    """Mean cross-entropy; ``labels="preds"`` gives the expected loss of the own predictions."""
    return df.groupBy(*by).agg(F.avg(cross_entropy(F.col(logits), F.col(labels))).alias("value"))


def mean_of_task_losses(df: DataFrame, by: Sequence[str] = (), task: str = "task", logits: str = "logits",
                        labels: str = "labels") -> DataFrame:
    return mean_loss(df, [*by, task], logits, labels).groupBy(*by).agg(F.avg("value").alias("value"))


def perplexity(df: DataFrame, by: Sequence[str] = (), loss: str = "loss", n: str = "num_tokens",
               strict: bool = True) -> DataFrame:
    """exp of the token-weighted mean loss; a group without tokens is an error (or null)."""
    total = F.sum(F.col(n).cast("double"))
    empty = F.raise_error(F.lit("perplexity of no tokens")).cast("double") if strict else F.lit(None)
    return df.groupBy(*by).agg(F.when(F.coalesce(total, F.lit(0.0)) > 0, F.exp(
        F.sum(F.col(loss) * F.col(n)) / total)).otherwise(empty).alias("value"))


METRICS: dict[str, Metric] = {
    "acc": accuracy, "micro_f1": micro_f1, "macro_f1": macro_f1, "loss": mean_loss,
    "perplexity": perplexity,
}


def _class_table(df: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    """All plain class metrics from one pass over the rows."""
    wide = class_counts(df, by).groupBy(*by).agg(*[CLASS_METRICS[n]().alias(n) for n in names])
    long = F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]))
    return wide.select(*by, long)


def evaluate(df: DataFrame, metrics: Sequence[str | tuple[str, dict]] = ("acc", "micro_f1", "macro_f1"),
             by: Sequence[str] = ("dataset_name", "split"),
             registry: dict[str, Metric] | None = None) -> DataFrame:
    """Long table (by..., metric, value). A metric is a name, or a name with its arguments.

    Class metrics without arguments share one pass over the rows; any other metric
    adds one of its own. ``registry`` adds or replaces metrics by name.
    """
    own = registry or {}
    plain = [m for m in metrics if isinstance(m, str) and m in CLASS_METRICS and m not in own]
    parts = [_class_table(df, plain, by)] if plain else []
    for m in metrics:
        if m in plain:
            continue
        name, kwargs = (m, {}) if isinstance(m, str) else m
        parts.append({**METRICS, **own}[name](df, by=by, **kwargs).select(*by, F.lit(name).alias("metric"), "value"))
    return reduce(DataFrame.unionByName, parts)


def run_evaluation(df: DataFrame, prepare_batch=None, prepare_outputs=None, prepare_step_outputs=None,
                   keep: Sequence[str] | None = None, metrics=("acc",), by=("dataset_name", "split"),
                   registry=None) -> DataFrame:
    """Hooks in order (batch, outputs, then the collected columns ``keep``, step outputs), then metrics."""
    for hook in (prepare_batch, prepare_outputs):
        df = hook(df) if hook else df
    df = df.select(*by, *keep) if keep else df
    df = prepare_step_outputs(df) if prepare_step_outputs else df
    return evaluate(df, metrics, by, registry)


def paired(preds: DataFrame, labels: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Predictions beside their labels by row id."""
    return preds.join(labels, row_id)


def unpaired(preds: DataFrame, labels: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Row ids that only one of the two tables has; empty when they fit."""
    a = preds.select(row_id, F.lit(1).alias("p"), F.lit(0).alias("l"))
    b = labels.select(row_id, F.lit(0).alias("p"), F.lit(1).alias("l"))
    return (a.unionByName(b).groupBy(row_id).agg(F.sum("p").alias("n_preds"), F.sum("l").alias("n_labels"))
            .filter((F.col("n_preds") != 1) | (F.col("n_labels") != 1)))


def size_share(df: DataFrame, activities: str = "unique_activities", by: Sequence[str] = ("split",)) -> DataFrame:
    """Share and running share of rows per activity-set size; the windows run on the counts."""
    counts = df.groupBy(*by, F.size(activities).alias("n_activities")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    share = F.col("n") / F.sum("n").over(w)
    return counts.withColumn("share", share).withColumn("cum_share", F.sum("share").over(
        w.orderBy("n_activities").rowsBetween(Window.unboundedPreceding, 0)))
