import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from procspark.llm.crf import Field, score_quality

SF = "/root/testdata/sf0.001"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    field = Field(1)
    field.step = rng.normal(size=(2, 2))
    first = np.array([0, 3, 4, 9])
    good = rng.normal(size=9)
    p, steps, norm = field.marginals(good, first)
    want, want_steps, want_norm = np.zeros(9), np.zeros((2, 2)), 0.0
    for a, b in zip(first, first[1:]):
        total, each, pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(good[a + i] * v for i, v in enumerate(y)) + sum(field.step[u, v] for u, v in zip(y, y[1:])))
            total += w
            each += w * np.array(y)
            for u, v in zip(y, y[1:]):
                pair[u, v] += w
        want[a:b] = each / total
        want_steps += pair / total
        want_norm += np.log(total)
    np.testing.assert_allclose(p, want)
    np.testing.assert_allclose(steps, want_steps)
    assert norm == pytest.approx(want_norm)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = score_quality(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    poor = [r for r in got if r.quality == 0]
    assert np.mean([r.predicted == 0 for r in poor]) > 0.9


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r.doc_id: r.score for r in score_quality(docs, labels).collect()}
    b = {r.doc_id: r.score for r in score_quality(docs.withColumn("lang", F.lit("x")), flipped).collect()}
    assert a == pytest.approx(b)


def test_nulls_empty_texts_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (None, "a line\n\nanother", 9), (2, "", 9), (3, "x\n" * 3000, 9)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (1, 1)], "doc_id long, quality long")
    got = score_quality(docs, labels).collect()
    assert len(got) == 5 and all(r.score == pytest.approx(.5) and r.predicted == 0 for r in got)
    assert score_quality(docs.limit(0), labels.limit(0)).count() == 0
