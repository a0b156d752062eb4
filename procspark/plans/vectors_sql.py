"""The queries of ``vectors`` in DuckDB SQL."""

from __future__ import annotations

from procspark.plans.texts_sql import chunk_f1_over

EMB = """emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings),
sz AS (SELECT count(*) // 2 AS half FROM emb),
un AS (SELECT vec_id, label, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM emb),
dims AS (SELECT vec_id, label, unnest(vec) AS x, unnest(range(len(vec))) AS dim FROM emb)"""
STATES = f"""{EMB}, st AS (SELECT vec_id // 20 AS row_id, (vec_id // 5) % 4 AS layer, vec_id % 5 AS pos,
    vec_id % 5 < 1 + (vec_id // 20) % 5 AS mask, dim, x FROM dims)"""
PAIRS = f"""{EMB}, sc AS (SELECT a.vec_id AS i, b.vec_id - half AS j, list_dot_product(a.u, b.u) AS s
    FROM un a, un b, sz WHERE a.vec_id < half AND b.vec_id >= half)"""


def ranks(pairs: str) -> str:
    return f"""{pairs}, ow AS (SELECT i, s AS own FROM sc WHERE i = j),
    bs AS (SELECT i, j AS best_id, s AS best_score FROM sc QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(s, 10) DESC, j) = 1),
    rk AS (SELECT i AS x_id, any_value(own) AS true_score, CAST(1 + count(*) FILTER (j <> i AND (round(s, 10) > round(own, 10)
           OR (round(s, 10) = round(own, 10) AND j < i))) AS BIGINT) AS true_rank, any_value(best_score) AS best_score,
           any_value(best_id) AS best_id, sum(s) AS score_sum, count(*) AS n FROM sc JOIN ow USING (i) JOIN bs USING (i) GROUP BY i)"""


RANK_OUT = """SELECT x_id, round(true_score, 6) AS true_score, true_rank, round(best_score, 6) AS best_score, best_id,
    round(score_sum, 6) AS score_sum, n FROM rk"""
NEAR = f"""{EMB}, nb AS (SELECT t.vec_id AS x_id, s.vec_id AS y_id, list_dot_product(t.u, s.u) AS score, s.label,
    row_number() OVER (PARTITION BY t.vec_id ORDER BY round(list_dot_product(t.u, s.u), 10) DESC, s.vec_id) AS rank
    FROM un t, un s, sz WHERE s.vec_id < half AND t.vec_id >= half)"""
VOTE = f"""{NEAR}, vt AS (SELECT x_id, k, label, count(*) AS c FROM nb, (SELECT unnest([1,3,10,25,50,100,250,500,1000]) AS k)
    WHERE rank <= k GROUP BY ALL),
    vote AS (SELECT x_id, CAST(k AS INTEGER) AS k, label AS pred FROM vt QUALIFY row_number() OVER (PARTITION BY x_id, k ORDER BY c DESC, label) = 1)"""
BERT = f"""{EMB}, half5 AS (SELECT (count(*) + 4) // 5 // 2 AS h FROM emb),
    tk AS (SELECT vec_id // 5 AS snt, vec_id % 5 AS pos, u FROM un),
    tt AS (SELECT a.snt AS i, b.snt - h AS j, a.pos AS p, b.pos AS q, list_dot_product(a.u, b.u) AS s FROM tk a, tk b, half5
           WHERE a.snt < h AND b.snt >= h),
    xs AS (SELECT i, j, avg(m) AS x FROM (SELECT i, j, p, max(s) AS m FROM tt GROUP BY ALL) GROUP BY ALL),
    ys AS (SELECT i, j, avg(m) AS y FROM (SELECT i, j, q, max(s) AS m FROM tt GROUP BY ALL) GROUP BY ALL),
    sc AS (SELECT i, j, 2 * x * y / (x + y) AS s FROM xs JOIN ys USING (i, j))"""
LOGITS = f"""{EMB}, r AS (SELECT vec_id AS row_id, CASE WHEN vec_id % 2 = 0 THEN 'trace' ELSE 'activity' END AS task,
    CASE WHEN vec_id % 5 < 3 THEN 'val' ELSE 'test' END AS split, vec, label AS y FROM emb),
    mn AS (SELECT task, label AS c, dim, avg(x) AS m FROM dims JOIN (SELECT row_id AS vec_id, task FROM r) USING (vec_id) GROUP BY ALL),
    hd AS (SELECT task, c, row_number() OVER (PARTITION BY task ORDER BY c) - 1 AS ci, list(m ORDER BY dim) AS w FROM mn GROUP BY task, c),
    lg AS (SELECT row_id, r.task, split, y, c, ci, list_dot_product(vec, w) AS l FROM r JOIN hd USING (task)),
    pd AS (SELECT row_id, any_value(task) AS task, any_value(split) AS split, any_value(y) AS y, arg_max(ci, l) AS p,
           max(l) + ln(sum(exp(l))  / exp(max(l))) AS lse, list(l ORDER BY ci) AS ls FROM lg GROUP BY row_id)"""
CLS = f"""{LOGITS}, cls AS (SELECT task, split, c, count(*) FILTER (p = c AND y = c) AS tp, count(*) FILTER (p = c AND y <> c) AS fp,
    count(*) FILTER (p <> c AND y = c) AS fn FROM pd, (SELECT unnest(range(10)) AS c) GROUP BY ALL HAVING tp + fp + fn > 0),
    m AS (SELECT task, split, sum(tp) / (sum(tp) + sum(fn)) AS acc, 2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS mic,
          avg(2.0 * tp / (2 * tp + fp + fn)) AS mac FROM cls GROUP BY ALL),
    ls AS (SELECT task, split, avg(lse - ls[y + 1]) AS loss FROM pd GROUP BY ALL)"""
CENTRED = f"""{EMB}, sd AS (SELECT CASE WHEN vec_id < half THEN 0 ELSE 1 END AS side, vec_id, dim,
    x - avg(x) OVER (PARTITION BY vec_id < half, dim) AS x FROM dims, sz WHERE vec_id < 2 * half),
    gr AS (SELECT a.side, a.dim AS d, b.dim AS e, sum(a.x * b.x) AS g FROM sd a JOIN sd b ON a.vec_id = b.vec_id GROUP BY ALL)"""
GROUPED = f"""{EMB}, pr AS (SELECT x.vec_id AS i, x.dim, x.x AS x, y.x AS y FROM dims x JOIN sz ON x.vec_id < half
    JOIN dims y ON y.vec_id = x.vec_id + half AND y.dim = x.dim),
    ct AS (SELECT i // 5 AS a, i % 5 AS b, dim, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM pr WINDOW w AS (PARTITION BY i % 5, dim)),
    gm AS (SELECT l.a, l.dim AS d, r.dim AS e, sum(l.x * r.y) AS xy, sum(l.x * r.x) AS xx, sum(l.y * r.y) AS yy
           FROM ct l JOIN ct r ON l.a = r.a AND l.b = r.b GROUP BY ALL)"""
KNN_ROWS = f"""{VOTE}, kt AS (SELECT v.k, v.x_id // 5 AS sent, v.x_id AS i, CASE WHEN v.pred < 7 THEN v.pred ELSE 0 END AS pred,
    CASE WHEN e.label < 7 THEN e.label ELSE 0 END AS gold FROM vote v JOIN emb e ON e.vec_id = v.x_id),
    raw AS (SELECT k || '#' || sent AS doc_id, k AS lang, i, pred, gold FROM kt)"""

SQL = {
    "layer_mean": f"""WITH {STATES} SELECT row_id, CAST(pos AS INTEGER) AS pos, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS x
        FROM st WHERE layer >= 2 GROUP BY ALL""",
    "pool_mean": f"""WITH {STATES} SELECT row_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS x FROM st
        WHERE layer = 3 AND mask GROUP BY ALL""",
    "pool_first": f"""WITH {STATES} SELECT row_id, CAST(dim AS INTEGER) AS dim, round(sum(x), 6) AS x FROM st
        WHERE layer IN (0, 2) AND pos = 0 GROUP BY ALL""",
    "last_state": f"""WITH {STATES} SELECT row_id, CAST(dim AS INTEGER) AS dim, round(arg_max(x, pos), 6) AS x FROM st
        WHERE layer = 3 AND mask GROUP BY ALL""",
    "cosine_ranks": f"WITH {ranks(PAIRS)} {RANK_OUT}",
    "true_cosine": f"WITH {PAIRS} SELECT i AS pair_id, round(s, 6) AS cosine FROM sc WHERE i = j",
    "mrr_acc": f"""WITH {ranks(PAIRS)} SELECT round(avg(1.0 / true_rank), 6) AS mrr, round(avg(CAST(best_id = x_id AS DOUBLE)), 6) AS acc,
        round(sum(score_sum) / sum(n), 6) AS mean_score FROM rk""",
    "mean_cosine": f"""WITH {EMB}, m AS (SELECT vec_id < half AS side, dim, avg(x) AS x FROM dims, sz GROUP BY ALL),
        p AS (SELECT a.x AS a, b.x AS b FROM m a JOIN m b USING (dim) WHERE a.side AND NOT b.side)
        SELECT round(sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS mean_cosine FROM p""",
    "knn_top": f"WITH {NEAR} SELECT x_id, CAST(rank AS INTEGER) AS rank, y_id, round(score, 6) AS score, label FROM nb WHERE rank <= 10",
    "knn_vote": f"WITH {VOTE} SELECT * FROM vote",
    "knn_entity_f1": chunk_f1_over(KNN_ROWS, ["O", "B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC"], "k",
                                   "SELECT unnest([1,3,10,25,50,100,250,500,1000]) AS lang"),
    "bert_score_pairs": f"WITH {BERT} SELECT i AS pair_id, round(s, 6) AS bert_score FROM sc WHERE i = j",
    "bert_score_ranks": f"WITH {ranks(BERT)} {RANK_OUT}",
    "cka_2d": f"""WITH {CENTRED} SELECT round(sum(x.g * y.g) / sqrt(sum(x.g * x.g) * sum(y.g * y.g)), 6) AS cka
        FROM gr x JOIN gr y ON x.d = y.d AND x.e = y.e WHERE x.side = 0 AND y.side = 1""",
    "cka_3d": f"""WITH {GROUPED} SELECT a, round(sum(xy * xy) / sqrt(sum(xx * xx) * sum(yy * yy)), 6) AS cka FROM gm GROUP BY a""",
    "head_logits": f"""WITH {LOGITS} SELECT row_id, CAST(p AS INTEGER) AS preds, CAST(ci AS INTEGER) AS class_idx, round(l, 6) AS logit
        FROM lg JOIN (SELECT row_id, p FROM pd) USING (row_id)""",
    "head_stats": f"""WITH {LOGITS} SELECT row_id, CAST(p AS INTEGER) AS preds, round(ls[p + 1], 6) AS max_logit, round(lse - ls[y + 1], 6) AS loss FROM pd""",
    "clf_metrics": f"""WITH {CLS} SELECT task AS dataset_name, split, 'acc' AS metric, round(acc, 6) AS value FROM m
        UNION ALL SELECT task, split, 'micro_f1', round(mic, 6) FROM m UNION ALL SELECT task, split, 'macro_f1', round(mac, 6) FROM m
        UNION ALL SELECT task, split, 'loss', round(loss, 6) FROM ls""",
    "confusion_counts": f"""WITH {LOGITS} SELECT task, y AS label, CAST(p AS INTEGER) AS pred, count(*) AS n FROM pd GROUP BY ALL""",
    "expected_loss": f"WITH {LOGITS} SELECT task, round(avg(lse - ls[p + 1]), 6) AS loss FROM pd GROUP BY task",
    "task_loss_mean": f"""WITH {LOGITS} SELECT round(avg(l), 6) AS loss FROM (SELECT task, avg(lse - ls[y + 1]) AS l FROM pd GROUP BY task)""",
}
