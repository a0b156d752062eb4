import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from procspark.functions.arrays import argmax, cross_entropy, logsumexp
from procspark.operators import metrics as mt


def _rows(spark, n=400):
    rnd = random.Random(2)
    data = [("de" if i % 3 else "fr", "test", rnd.randrange(4), rnd.choice([-100, 0, 1, 2, 2, 2])) for i in range(n)]
    return spark.createDataFrame(data, "dataset_name string, split string, preds int, labels int"), data


def _scores(pairs):
    pairs = [p for p in pairs if p[1] != -100]
    classes = sorted({c for p in pairs for c in p})
    f1 = []
    for c in classes:
        tp = sum(p == y == c for p, y in pairs)
        f1.append(2 * tp / (sum(p == c for p, _ in pairs) + sum(y == c for _, y in pairs)))
    return sum(p == y for p, y in pairs) / len(pairs), sum(f1) / len(f1)


def test_classification_metrics(spark):
    df, data = _rows(spark)
    got = {(r.dataset_name, r.metric): r.value for r in mt.evaluate(df).collect()}
    for lang in ("de", "fr"):
        acc, macro = _scores([(d[2], d[3]) for d in data if d[0] == lang])
        assert abs(got[lang, "acc"] - acc) < 1e-12 and abs(got[lang, "micro_f1"] - acc) < 1e-12
        assert abs(got[lang, "macro_f1"] - macro) < 1e-12
    only = mt.macro_f1(df, ["split"], classes=[0, 1, 2]).first().value
    assert 0 < only < 1


def test_argmax_and_losses(spark):
    d = spark.createDataFrame([([2.0, 1.0], 0, "a"), ([1.0, 2.0], 0, "a"), ([1000.0, 1000.0], 1, "b"), ([0.0, 0.0], -100, "b")],
                              "logits array<double>, labels int, task string")
    assert [r[0] for r in d.select(argmax(F.col("logits"))).collect()] == [0, 1, 0, 0]
    lse = math.log(math.exp(2) + math.exp(1))
    assert abs(d.select(logsumexp(F.col("logits"))).first()[0] - lse) < 1e-12
    ce = [r[0] for r in d.select(cross_entropy(F.col("logits"), F.col("labels"))).collect()]
    assert abs(ce[0] - (lse - 2)) < 1e-12 and abs(ce[2] - math.log(2)) < 1e-9 and ce[3] is None
    by = {r.task: r.value for r in mt.mean_loss(d, ["task"]).collect()}
    assert abs(by["a"] - (lse - 1.5)) < 1e-12
    assert abs(mt.mean_of_task_losses(d).first().value - (lse - 1.5 + math.log(2)) / 2) < 1e-9


def test_perplexity(spark):
    d = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("b", 5.0, 0)], "g string, loss double, num_tokens bigint")
    assert abs(mt.perplexity(d.filter("g = 'a'")).first().value - math.exp(1.25)) < 1e-12
    assert {r.g: r.value for r in mt.perplexity(d, ["g"], strict=False).collect()}["b"] is None
    for bad in (d.filter("g = 'b'"), d.limit(0)):
        with pytest.raises(PySparkException):
            mt.perplexity(bad).collect()


def test_hooks_run_in_order(spark):
    d = spark.createDataFrame([("x", "val", [0.0, 1.0], 1), ("x", "val", [1.0, 0.0], 1)],
                              "dataset_name string, split string, logits array<double>, y int")
    out = mt.run_evaluation(d, prepare_batch=lambda t: t.withColumnRenamed("y", "labels"), prepare_outputs=mt.with_preds,
                            keep=["preds", "labels"], prepare_step_outputs=lambda t: t.withColumn("preds", 1 - F.col("preds")),
                            metrics=["acc", ("flipped", {})], registry={"flipped": lambda df, by: mt.accuracy(
                                df.withColumn("preds", 1 - F.col("preds")), by)})
    assert {r.metric: r.value for r in out.collect()} == {"acc": 0.5, "flipped": 0.5}


def test_pairing(spark):
    p = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "row_id bigint, preds int")
    y = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "row_id bigint, labels int")
    assert {r.row_id for r in mt.unpaired(p, y).collect()} == {2, 3}
    assert mt.unpaired(p, y.limit(0)).count() == 3 and mt.paired(p, y).count() == 3


def test_size_share(spark):
    d = spark.createDataFrame([("t", ["a"]), ("t", ["a", "b"]), ("t", ["a", "c"]), ("v", ["a"])], "split string, unique_activities array<string>")
    got = sorted((r.split, r.n_activities, r.n, round(r.cum_share, 4)) for r in mt.size_share(d).collect())
    assert got == [("t", 1, 1, 0.3333), ("t", 2, 2, 1.0), ("v", 1, 1, 1.0)]
