import numpy as np
import pytest

from procspark.llm.mixing import DOMAINS, TARGETS, fit_rates, fold_rates, mix_documents

SF = "/root/testdata/sf0.01"


def test_rates_meet_targets_and_are_the_nearest(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([.4, .3, .2], 400)
    t = rng.integers(0, 900, 400)
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(t, p)], "n_tokens long, p array<double>")
    want = np.array([.7, .1, .2])
    start, steps = fit_rates(table, 3, want, .5)
    r = fold_rates(p, start, steps)
    total = t.sum() * .5
    assert (r >= 0).all() and np.abs((r * t) @ p - want * total).max() < 2e-5 * total
    # brute force: the same least squares by many small projected steps on the plain matrix
    m = (p * t[:, None]).T @ p
    x = np.full(400, .5)
    for _ in range(20000):
        x = np.maximum(x - .5 * p @ np.linalg.solve(m, (x * t) @ p - want * total), 0)
    assert np.abs((x * t) @ p - want * total).max() < 1e-4 * total
    assert ((r - .5) ** 2 * t).sum() == pytest.approx(((x - .5) ** 2 * t).sum(), rel=.05)


def test_unreachable_targets_come_as_close_as_they_can(spark):
    table = spark.createDataFrame([(10, [1.0, 0.0]), (30, [1.0, 0.0])], "n_tokens long, p array<double>")
    start, steps = fit_rates(table, 2, np.array([.5, .5]), 1.0)
    r = fold_rates(np.array([[1.0, 0.0]]), start, steps)
    assert r[0] == pytest.approx(.5, abs=1e-3)


def test_documents_are_mixed(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = mix_documents(docs, labels)
    assert "text" not in got.columns and got.count() == docs.count()
    names = list(DOMAINS)
    rows = got.select("n_tokens", "rate", *[f"p_{n}" for n in names]).toPandas()
    mass = [(rows.rate * rows.n_tokens * rows[f"p_{n}"]).sum() for n in names]
    total = rows.n_tokens.sum() * .5
    assert np.abs(np.array(mass) - np.array([TARGETS[n] for n in names]) * total).max() < 2e-5 * total
    by = got.join(labels, "doc_id").groupBy("toxic").avg("rate").collect()
    rate = {r.toxic: r[1] for r in by}
    assert rate[1] < .3 * rate[0]


def test_odd_inputs(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "some words", 5), (1, None, 5)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 0)], "doc_id long, quality long, toxic long")
    got = mix_documents(docs, labels).collect()
    assert len(got) == 4 and all(r.rate >= 0 and r.p_good == pytest.approx(.25) for r in got)
    assert mix_documents(docs.limit(0), labels.limit(0)).count() == 0
