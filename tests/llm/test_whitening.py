import numpy as np
import pytest

from procspark.llm import whitening as wt


@pytest.mark.parametrize("d, n, power", [(64, 500, 0), (200, 900, 0), (150, 600, 1), (20, 50, 0), (60, 30, .5), (1, 5, 0), (90, 4000, 3)])
def test_eigenpairs_against_a_dense_solver(d, n, power):
    x = np.random.default_rng(d).normal(size=(n, d)) * np.arange(1.0, d + 1) ** -power
    x -= x.mean(0)
    a = x.T @ x / n
    e, v = wt.jacobi_davidson(lambda b: a @ b, d, 32)
    want = np.linalg.eigvalsh(a)[::-1][:32]
    assert len(e) == min(32, d) and np.abs(e - want).max() < 1e-12 * want[0]
    assert np.abs(a @ v - v * e).max() < 1e-12 * want[0] and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-13


def test_equal_eigenvalues_and_zero():
    a = np.diag([5.0] * 6 + [2.0] * 40 + [0.0] * 20)
    e, v = wt.jacobi_davidson(lambda b: a @ b, 66, 32)
    assert np.allclose(e, [5] * 6 + [2] * 26, atol=1e-12) and np.abs(a @ v - v * e).max() < 1e-11
    assert np.allclose(wt.jacobi_davidson(lambda b: 0 * b, 40, 3)[0], 0)


def test_minres_against_least_squares():
    r = np.random.default_rng(3)
    a = r.normal(size=(12, 12))
    a = a + a.T
    b, shift = r.normal(size=(12, 3)), np.array([.1, .5, -2])
    got = wt.minres(lambda x: a @ x - x * shift, b, 12)
    want = np.stack([np.linalg.solve(a - s * np.eye(12), b[:, j]) for j, s in enumerate(shift)], 1)
    assert np.allclose(got, want, atol=1e-6)


def plain(vectors):
    good = [(i, v) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000 for _, v in good])
    n, s = len(x), x.sum(0)
    y = (x - s // n) - (s % n) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    return good, n, ((n * x - s) ** 2).sum(1), y, e[::-1], u[:, ::-1]


def some(n, d, seed=4):
    return [(i, np.float32(v).tolist()) for i, v in enumerate(np.random.default_rng(seed).normal(size=(n, d)) * np.linspace(3, 1, d))]


@pytest.mark.parametrize("rows", [
    some(400, 40), [*some(60, 5), (None, [1.0, 2.0, 3.0, 4.0, 5.0]), (7, None), (8, [1.0, None, 3.0, 4.0, 5.0]), (9, [1.0, float("nan"), 3.0, 4.0, 5.0]),
                    (9, [1.0, float("inf"), 3.0, 4.0, 5.0]), (3, [1.0, 2.0, 3.0, 4.0, 5.0]), (3, [1.0, 2.0, 3.0, 4.0, 5.0])],
    [(i, [*v, v[0] - v[1]]) for i, v in some(50, 3)]], ids=["plain", "nulls and copies", "dependent"])
def test_whitened_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, component string, n string").repartition(3)
    got = wt.whiten(df).toPandas()
    good, n, deviation, y, e, u = plain(rows)
    k = min(32, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k and set(got.n) == {n}
    assert np.abs(got.explained - (e / e.sum())[got.component - 1]).max() < 1e-12 and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    want = {}
    for (i, _), dev, w in zip(good, deviation, y @ u[:, :k] / np.sqrt(e[:k])):
        want.setdefault(i, []).append((int(dev), np.abs(w)))
    for i, part in got.groupby("vec_id", dropna=False):
        mine = want[None if np.isnan(i) else int(i)]
        assert {int(x) for x in part.deviation} == {m[0] for m in mine}
        if len(mine) == 1:
            assert np.abs(np.abs(part.sort_values("component").whitened.to_numpy()) - mine[0][1]).max() < 1e-6


def test_signs_are_the_same_for_all_rows(spark):
    rows = some(300, 8)
    got = wt.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().pivot(index="vec_id", columns="component", values="whitened")
    cov = np.cov(got.to_numpy().T, bias=True)
    assert np.abs(cov - np.eye(8)).max() < 1e-9


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, []), (2, [])]):
        assert wt.whiten(spark.createDataFrame(rows, schema)).count() == 0
    with pytest.raises(ValueError):
        wt.fit_whitening(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_large_deviations_stay_exact():
    c = wt.Centre(10**7, [7 * 10**12 + 3], [0], [2_000_000])
    x = np.array([[0], [2_000_000]])
    assert [int(v) for v in c.deviations(x).to_pylist()] == [(10**7 * int(v) - 7 * 10**12 - 3) ** 2 for v in x[:, 0]]
