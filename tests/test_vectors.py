import numpy as np
import pytest
from pyspark.sql import functions as F

from procspark.functions import tiles
from procspark.operators import alignment as al, heads as hd, pooling as pl, retrieval as rt

RNG = np.random.default_rng(0)


def _table(spark, m, **cols):
    names = list(cols)
    rows = [tuple(int(cols[c][i]) for c in names) + (m[i].tolist(),) for i in range(len(m))]
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in names) + ", vec array<double>")


def _unit(m):
    return m / np.linalg.norm(m, axis=-1, keepdims=True)


@pytest.mark.parametrize("tile", [None, 17])
def test_cosine_ranks(spark, tile):
    x, y = RNG.normal(size=(90, 8)), RNG.normal(size=(90, 8))
    y[:40] = x[:40] + .3 * y[:40]
    y[41], y[60] = x[7], x[7] * 2  # exact ties for row 7
    s = np.round(_unit(x) @ _unit(y).T, 10)
    r = {p.x_id: p for p in rt.cosine_ranks(_table(spark, x, pair_id=range(90)), _table(spark, y, pair_id=range(90)), tile).collect()}
    rank = [list(np.argsort(-s[i], kind="stable")).index(i) + 1 for i in range(90)]
    assert [r[i].true_rank for i in range(90)] == rank
    assert [r[i].best_id for i in range(90)] == [int(np.argmax(s[i])) for i in range(90)]
    assert all(r[i].n == 90 and abs(r[i].score_sum - s[i].sum()) < 1e-6 for i in range(90))
    table = spark.createDataFrame(list(r.values()))
    assert abs(rt.mean_reciprocal_rank(table).first().mrr - np.mean(1 / np.array(rank))) < 1e-12
    assert abs(rt.retrieval_accuracy(table).first().acc - np.mean(s.argmax(1) == np.arange(90))) < 1e-12
    assert abs(rt.mean_score(table).first().mean_score - s.mean()) < 1e-8


def _sentences(lens, dim):
    return [RNG.normal(size=(n, dim)) for n in lens]


def _bert(a, b):
    s = _unit(a) @ _unit(b).T
    p, r = s.max(0).mean(), s.max(1).mean()
    return 2 * p * r / (p + r)


@pytest.mark.parametrize("tokens", [None, 200])
def test_bert_score_against_direct_formula(spark, tokens):
    lens = RNG.integers(10, 50, size=(2, 40))
    xs, ys = _sentences(lens[0], 48), _sentences(lens[1], 48)
    rows = [[(i, p, v.tolist(), 1) for i, s in enumerate(side) for p, v in enumerate(s)]
            + [(i, 99, [9.0] * 48, 0) for i in range(40)] for side in (xs, ys)]
    x, y = (rt.sentences(spark.createDataFrame(t, "pair_id bigint, pos int, vec array<double>, mask int")) for t in rows)
    want = np.array([[_bert(a, b) for b in ys] for a in xs])
    got = {r.x_id: r for r in rt.bert_score_ranks(x, y, tokens).collect()}
    for i in range(40):
        assert abs(got[i].true_score - want[i, i]) < 1e-9 and abs(got[i].score_sum - want[i].sum()) < 1e-8
        assert got[i].best_id == want[i].argmax() and got[i].true_rank == (want[i] > want[i, i]).sum() + 1
    pairs = x.withColumnRenamed("vecs", "x_vecs").join(y.withColumnRenamed("vecs", "y_vecs"), "pair_id")
    one = {r.pair_id: r.bert_score for r in rt.bert_score_pairs(pairs).collect()}
    assert all(abs(one[i] - want[i, i]) < 1e-9 for i in range(40))


@pytest.mark.parametrize("tile", [None, 2])
def test_knn(spark, tile):
    src, trg, labels = RNG.normal(size=(70, 6)), RNG.normal(size=(31, 6)), RNG.integers(0, 4, 70)
    src[10:40] = src[10]  # a third of the sources are copies
    s = np.round(_unit(trg) @ _unit(src).T, 10)
    sources = _table(spark, src, y_id=range(70), label=labels).withColumn("label", F.col("label").cast("int"))
    near = rt.top_sources(_table(spark, trg, x_id=range(31)), sources, 1000, tile)
    votes = {(r.x_id, r.k): r.pred for r in rt.knn_vote(near, (1, 3, 25, 1000)).collect()}
    for i in range(31):
        order = np.argsort(-s[i], kind="stable")
        for k in (1, 3, 25, 1000):
            assert votes[i, k] == np.bincount(labels[order[:k]]).argmax()
    back = rt.scatter(spark.range(3).withColumnRenamed("id", "x_id"), spark.createDataFrame([(1, 5)], "x_id bigint, pred int"), ["x_id"], -100)
    assert {(r.x_id, r.pred) for r in back.collect()} == {(0, -100), (1, 5), (2, -100)}


def test_neighbour_lists_and_votes_leave_a_task_bit_by_bit(spark, monkeypatch):
    """Lists of a tile and labels of a batch are worked on in small parts, with the same results."""
    src, trg, labels = RNG.normal(size=(300, 4)), RNG.normal(size=(200, 4)), RNG.integers(0, 5, 300)
    s = np.round(_unit(trg) @ _unit(src).T, 10)
    sources = _table(spark, src, y_id=range(300), label=labels).withColumn("label", F.col("label").cast("int"))
    near = rt.neighbour_lists(_table(spark, trg, x_id=range(200)), sources, 250, 100)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan  # a co-group gives its lists all at once
    got = {r.x_id: (r.y_ids, r.labels) for r in near.collect()}
    for i in range(200):
        order = np.argsort(-s[i], kind="stable")[:250]
        assert got[i] == (order.tolist(), labels[order].tolist())
    batch = near.limit(50).select("x_id", "labels").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(rt, "VOTE_LABELS", 1000)
    parts = list(rt._bounded(batch))
    assert len(parts) > 9 and sum(p.num_rows for p in parts) == batch.num_rows
    assert all(p.num_rows == 4 for p in parts[:-1])


def _cka(x, y):
    x, y = x - x.mean(0), y - y.mean(0)
    return np.linalg.norm(x @ y.T) ** 2 / (np.linalg.norm(x.T @ x) * np.linalg.norm(y.T @ y))


def test_cka(spark):
    x, y = RNG.normal(3, 1, size=(50, 7)), RNG.normal(-2, 1, size=(50, 7))
    both = _table(spark, np.vstack([x, y]), side=[0] * 50 + [1] * 50).repartition(5)
    assert abs(al.cka(both).first().cka - _cka(x, y)) < 1e-9
    same = _table(spark, np.vstack([x, x]), side=[0] * 50 + [1] * 50)
    assert abs(al.cka(same).first().cka - 1) < 1e-9


def test_cka_grouped(spark):
    x, y = RNG.normal(size=(9, 4, 5)), RNG.normal(size=(9, 4, 5))
    rows = [(a, b, x[a, b].tolist(), y[a, b].tolist()) for a in range(9) for b in range(4)]
    d = spark.createDataFrame(rows, "a bigint, b bigint, x array<double>, y array<double>")
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = [np.linalg.norm(p.T @ q) ** 2 / (np.linalg.norm(p.T @ p) * np.linalg.norm(q.T @ q)) for p, q in zip(xc, yc)]
    got = {r.a: r.cka for r in al.cka_grouped(d, reduction=None).collect()}
    assert np.allclose([got[a] for a in range(9)], want)
    assert abs(al.cka_grouped(d).first().cka - np.mean(want)) < 1e-12


def test_pooling(spark):
    h = RNG.normal(size=(3, 4, 5, 6))  # row, layer, pos, dim
    mask = np.array([[1, 1, 1, 0, 0], [1, 1, 1, 1, 1], [0, 0, 0, 0, 0]])
    rows = [(r, l, p, h[r, l, p].tolist(), int(mask[r, p]) * 2) for r in range(3) for l in range(4) for p in range(5)]
    d = spark.createDataFrame(rows, "row_id bigint, layer int, pos int, vec array<double>, mask int")
    vec = lambda df: {r.row_id: r.vec for r in df.collect()}
    got = vec(pl.embed(d, 1, 4))
    assert np.allclose(got[0], h[0, 3, :3].mean(0)) and np.allclose(got[1], h[1, 3].mean(0)) and got[2] is None
    assert np.allclose(vec(pl.embed(d, [0, -1], 4, how="sum", pool="cls"))[1], h[1, [0, 3], 0].sum(0))
    tok = {(r.row_id, r.pos): r.vec for r in pl.embed(d, 2, 4, pool=None).collect()}
    assert np.allclose(tok[1, 2], h[1, 2:, 2].mean(0))
    assert np.allclose(vec(pl.last_token(pl.pick_layers(d, 1, 4)))[0], h[0, 3, 2])
    assert np.allclose(vec(pl.last_token(pl.pick_layers(d, 1, 4), "left"))[0], h[0, 3, 4])


def test_heads_both_ways(spark):
    v, w = RNG.normal(size=(20, 4)), RNG.normal(size=(5, 4))
    df = _table(spark, v, row_id=range(20)).withColumn("task", F.when(F.col("row_id") == 3, "none").otherwise(
        F.when(F.col("row_id") % 2 == 0, "a").otherwise("b")))
    heads = spark.createDataFrame([("a", c, w[c].tolist()) for c in range(3)] + [("b", c, w[c + 3].tolist()) for c in range(2)],
                                  "task string, class_idx int, vec array<double>")
    for limit in (10**6, 2):
        got = {r.row_id: r.logits for r in hd.head_logits(df, heads, max_bytes=limit).collect()}
        assert got[3] is None
        assert all(np.allclose(got[i], v[i] @ (w[:3] if i % 2 == 0 else w[3:]).T) for i in range(20) if i != 3)


def test_mean_cosine(spark):
    x, y = RNG.normal(size=(10, 4)), RNG.normal(size=(10, 4))
    a, b = x.mean(0), y.mean(0)
    got = rt.mean_cosine(_table(spark, x, i=range(10)), _table(spark, y, i=range(10))).first().mean_cosine
    assert abs(got - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_grid_follows_size_and_memory(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tiles.grid(spark, 500, 500, 64, None) == (1, 1)
    gx, gy = tiles.grid(spark, 10**6, 10**6, 64, None)
    assert gx * gy >= tiles.TILES_PER_CORE * cores
    gx, gy = tiles.grid(spark, 10**9, 10**9, 1024, None)
    assert 10**9 / gx * 8 * 1024 <= tiles.TILE_BYTES and 10**9 / gy * 8 * 1024 <= tiles.TILE_BYTES
    wide = tiles.grid(spark, 10**6, 10**6, 64, None, wide_y=True)
    assert wide[1] == 8 and wide[0] * wide[1] >= tiles.TILES_PER_CORE * cores


@pytest.mark.parametrize("limit", [10**9, 0])
def test_heads_by_row_and_task_both_ways(spark, limit):
    rows = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "b", [3.0, 4.0]), (2, "a", [0.0, 1.0]), (3, "c", [1.0, 1.0]), (4, "a", None)],
                                 "row_id long, task string, vec array<float>")
    many = [("a", c, [float(c), 1.0]) for c in range(30)] + [("b", 0, [1.0, 1.0])]
    got = hd.head_logits(rows, spark.createDataFrame(many, "task string, class_idx int, vec array<double>"), max_bytes=limit)
    by = {(r.row_id, r.task): r.logits for r in got.collect()}
    assert by[(1, "a")] == [c + 2.0 for c in range(30)] and by[(1, "b")] == [7.0] and by[(2, "a")] == [1.0] * 30
    assert by[(3, "c")] is None and by[(4, "a")] is None
    assert got.columns == ["row_id", "task", "vec", "logits"] and dict(got.dtypes)["vec"] == "array<double>"


def test_zero_vectors_have_cosine_zero(spark):
    side = lambda rows: spark.createDataFrame(rows, "pair_id long, vec array<double>")
    x = side([(0, [0.0, 0.0]), (1, [1.0, 0.0])])
    y = side([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0])])
    got = {r.x_id: (r.true_score, r.true_rank) for r in rt.cosine_ranks(x, y).collect()}
    assert got[0] == (0.0, 1) and got[1] == (1.0, 2)


@pytest.mark.parametrize("tile_rows", [None, 7])
def test_head_stats_in_tiles(spark, tile_rows):
    """One task with many classes, another with few; rows are hashed, so no shuffle goes by task."""
    v, w = RNG.normal(size=(40, 4)), RNG.normal(size=(301, 4))
    w[200] = w[17]  # a tie
    y = RNG.integers(0, 300, 40)
    rows = [(i, "big" if i % 8 else "small", v[i].tolist(), int(y[i]) if i % 8 else 0) for i in range(40)]
    rows += [(1, "small", v[1].tolist(), 5), (1, "big", v[2].tolist(), 3), (50, "none", v[0].tolist(), 0), (51, "big", None, 0), (52, "big", v[17].tolist(), None)]
    df = spark.createDataFrame(rows + rows[:3], "row_id bigint, task string, vec array<double>, labels int")
    heads = spark.createDataFrame([("big", c, w[c].tolist()) for c in range(300)] + [("small", 0, w[300].tolist())], "task string, class_idx int, vec array<double>")
    got = hd.head_stats(df, heads, tile_rows=tile_rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    by_task = [x.split(")")[0] for x in plan.split("hashpartitioning(") if x.startswith("task#")]
    assert all("row_id#" in x for x in by_task)
    out = got.collect()
    assert len(out) == len(rows) + 3 and got.columns == ["row_id", "task", "vec", "labels", "preds", "max_logit", "loss"]
    for r in out:
        if r.task == "none" or r.vec is None:
            assert (r.preds, r.max_logit, r.loss) == (None, None, None)
            continue
        logits = np.array(r.vec) @ (w[:300] if r.task == "big" else w[300:]).T
        assert r.preds == int(logits.argmax()) and abs(r.max_logit - logits.max()) < 1e-9
        if r.labels is None or r.labels >= len(logits):
            assert r.loss is None
        else:
            assert abs(r.loss - (np.log(np.exp(logits).sum()) - logits[r.labels])) < 1e-9


def test_neighbour_lists_send_one_row_a_block(spark):
    src, trg = RNG.normal(size=(200, 6)), RNG.normal(size=(9, 6))
    sources = _table(spark, src, y_id=range(200), label=[0] * 200).withColumn("label", F.col("label").cast("int"))
    lists = rt.neighbour_lists(_table(spark, trg, x_id=range(9)), sources, 50, tile_rows=60).collect()
    s = np.round(_unit(trg) @ _unit(src).T, 10)
    assert len(lists) == 9
    for r in lists:
        order = np.argsort(-s[r.x_id], kind="stable")[:50]
        assert r.y_ids == order.tolist() and np.allclose(r.scores, s[r.x_id][order])


def test_constant_and_zero_sides_have_no_alignment(spark):
    x = RNG.normal(size=(10, 3))
    both = _table(spark, np.vstack([x, np.ones((10, 3))]), side=[0] * 10 + [1] * 10)
    assert al.cka(both).first().cka is None
    rows = [(a, b, RNG.normal(size=3).tolist(), [0.0] * 3 if a == 1 else RNG.normal(size=3).tolist()) for a in range(3) for b in range(1)] + [
        (7, 9, [1.0, 2.0, 3.0], [0.0, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "a bigint, b bigint, x array<double>, y array<double>")
    got = {r.a: r.cka for r in al.cka_grouped(d, reduction=None).collect()}
    assert got[7] is None and set(got) == {0, 1, 2, 7}
    zero = _table(spark, np.zeros((4, 3)), i=range(4))
    assert rt.mean_cosine(zero, zero).first().mean_cosine == 0.0


def test_long_groups_are_folded(spark):
    """A group with most of the rows, spread over tasks, and small ones."""
    rows = [(0, b, RNG.normal(size=4).tolist(), RNG.normal(size=4).tolist()) for b in range(500)]
    rows += [(a, b, RNG.normal(size=4).tolist(), RNG.normal(size=4).tolist()) for a in (1, 2, None) for b in range(3)]
    d = spark.createDataFrame(rows, "a bigint, b bigint, x array<double>, y array<double>").repartition(4)
    got = {r.a: r.cka for r in al.cka_grouped(d, reduction=None).collect()}
    at: dict = {}
    for _, b, x, y in rows:
        at.setdefault(b, []).append((x, y))
    for a in (0, 1, 2, None):
        p, q = (np.array([np.array(r[i]) - (np.mean([z[i - 2] for z in at[r[1]]], 0) if len(at[r[1]]) > 1 else 0) for r in rows if r[0] == a]) for i in (2, 3))
        assert abs(got[a] - np.linalg.norm(p.T @ q) ** 2 / (np.linalg.norm(p.T @ p) * np.linalg.norm(q.T @ q))) < 1e-9


def test_pair_scores_of_ragged_sentences():
    sizes = RNG.integers(1, 12, (2, 60))
    (a, a_at), (b, b_at) = ((_unit(RNG.normal(size=(n.sum(), 5))), np.concatenate([[0], np.cumsum(n)])) for n in sizes)
    got = rt._pair_scores(a, a_at, b, b_at)
    for k in range(60):
        s = a[a_at[k]:a_at[k + 1]] @ b[b_at[k]:b_at[k + 1]].T
        x, y = s.max(1).mean(), s.max(0).mean()
        assert abs(got[k] - 2 * x * y / (x + y)) < 1e-9
