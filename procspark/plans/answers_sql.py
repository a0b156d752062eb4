"""The queries of ``answers`` in DuckDB SQL."""

from __future__ import annotations

from procspark.plans.texts_sql import TOK, words

EXAMPLES = rf"""{TOK},
sp AS (SELECT doc_id, t, i, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS fin,
       sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) - length(regexp_replace(t, '^\s+', '')) AS beg FROM tok),
cnt AS (SELECT doc_id, count(*) AS n, (doc_id * 31) % count(*) AS k FROM tok GROUP BY doc_id),
ans AS (SELECT c.doc_id, a.beg AS a_beg, b.fin AS a_end FROM cnt c JOIN sp a ON a.doc_id = c.doc_id AND a.i = c.k
        JOIN sp b ON b.doc_id = c.doc_id AND b.i = least(c.k + 2, c.n - 1)),
ex AS (SELECT d.doc_id, d.text, d.lang, c.n, a_beg, a_end,
       len({words("d.lang || ' ' || d.source || ' ' || d.n_chars")}) AS q
       FROM documents d JOIN cnt c USING (doc_id) JOIN ans USING (doc_id)),
win AS (SELECT doc_id, n, q, 381 - q AS w, a_beg, a_end, unnest(range(CASE WHEN n <= 381 - q THEN 1
          ELSE CAST(ceil((n - (381 - q)) / (253.0 - q)) AS BIGINT) + 1 END)) AS window_no FROM ex),
feat AS (SELECT *, window_no * (w - 128) AS c0, least(w, n - window_no * (w - 128)) AS nc FROM win)"""

SCORED = f"""{EXAMPLES},
pos AS (SELECT doc_id, window_no, q, c0, nc, unnest(range(q + nc + 3)) AS p FROM feat),
lg AS (SELECT pos.*, CAST((pos.doc_id * 31 + window_no * 17 + p * 13) % 101 AS DOUBLE) AS s,
       CAST((pos.doc_id * 7 + window_no * 11 + p * 29) % 103 AS DOUBLE) AS e, sp.beg, sp.fin
       FROM pos LEFT JOIN sp ON sp.doc_id = pos.doc_id AND p >= q + 2 AND p < q + 2 + nc AND sp.i = c0 + p - q - 2),
ts AS (SELECT *, row_number() OVER (PARTITION BY doc_id, window_no ORDER BY s DESC, p DESC) AS sr FROM lg QUALIFY sr <= 20),
te AS (SELECT *, row_number() OVER (PARTITION BY doc_id, window_no ORDER BY e DESC, p DESC) AS er FROM lg QUALIFY er <= 20),
cand AS (SELECT ts.doc_id, ts.window_no, sr, er, ts.s AS sl, te.e AS el, ts.s + te.e AS score, ts.beg AS b, te.fin AS f
         FROM ts JOIN te ON ts.doc_id = te.doc_id AND ts.window_no = te.window_no AND te.p >= ts.p AND te.p - ts.p + 1 <= 30
         WHERE ts.beg IS NOT NULL AND te.fin IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, window_no, sr, er) AS rk FROM cand QUALIFY rk <= 20),
lst AS (SELECT doc_id, rk, substr(text, CAST(b + 1 AS BIGINT), CAST(f - b AS BIGINT)) AS txt, score, sl, el FROM top JOIN ex USING (doc_id)),
few AS (SELECT doc_id, count(rk) AS m, max(txt) AS only_txt FROM ex LEFT JOIN lst USING (doc_id) GROUP BY doc_id),
allp AS (SELECT doc_id, rk, txt, score, sl, el FROM lst UNION ALL
         SELECT doc_id, 0, 'empty', 0.0, 0.0, 0.0 FROM few WHERE m = 0 OR (m = 1 AND only_txt = ''))"""
#: As SCORED, of documents with windows, and starts at flagged places only.
EXAMPLE_FORM = SCORED.replace("FROM feat),", "FROM feat WHERE doc_id % 5 <> 0),").replace(
    "AND te.p - ts.p + 1 <= 30", "AND te.p - ts.p + 1 <= 30 AND (ts.p + ts.doc_id) % 4 <> 0")


BEST = f"""{SCORED}, best AS (SELECT doc_id, txt FROM allp QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rk) = 1)"""


def toks(expr: str) -> str:
    """Answer normalisation over single words."""
    plain = f"regexp_replace(lower({expr}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    return (f"list_filter(regexp_split_to_array({plain}, '\\s+'), "
            "lambda x: x NOT IN ('', 'a', 'an', 'the'))")


F1 = f"""{BEST}, nt AS (SELECT ex.doc_id, ex.lang, {toks('txt')} AS p,
    {toks("substr(text, CAST(a_beg + 1 AS BIGINT), CAST(a_end - a_beg AS BIGINT))")} AS g FROM ex JOIN best USING (doc_id)),
ov AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)),
       len(list_filter(g, lambda y: y = x))))), 0) AS c FROM nt),
sc AS (SELECT doc_id, lang, CAST(p = g AS DOUBLE) AS em, CASE WHEN c > 0 THEN 2.0 * c / (len(p) + len(g)) ELSE 0.0 END AS f1 FROM ov)"""

SQL = {
    "qa_windows": f"""WITH {EXAMPLES}, g AS (SELECT f.doc_id, window_no, min(beg) AS first_char, max(fin) AS last_char,
        string_agg(t, '' ORDER BY i) AS text FROM feat f JOIN sp ON sp.doc_id = f.doc_id AND i >= c0 AND i < c0 + nc GROUP BY ALL)
        SELECT f.doc_id AS example_id, CAST(window_no AS INTEGER) AS window_no, CAST(c0 AS INTEGER) AS context_start,
        CAST(nc AS INTEGER) AS n_context, CAST(q + nc + 3 AS INTEGER) AS n_positions, CAST(q + 2 AS INTEGER) AS context_pos,
        CAST(first_char AS INTEGER) AS first_char, CAST(last_char AS INTEGER) AS last_char,
        CAST(q + nc + 3 AS INTEGER) AS n_offsets, text FROM feat f JOIN g USING (doc_id, window_no)""",
    "qa_span_labels": f"""WITH {EXAMPLES}, g AS (SELECT f.doc_id, window_no, any_value(q) AS q, any_value(nc) AS nc,
        min(beg) AS fb, max(fin) AS lf, any_value(a_beg) AS ab, any_value(a_end) AS ae,
        count(*) FILTER (beg <= a_beg) AS nb, count(*) FILTER (fin < a_end) AS ns
        FROM feat f JOIN sp ON sp.doc_id = f.doc_id AND i >= c0 AND i < c0 + nc GROUP BY ALL),
        h AS (SELECT *, doc_id % 10 <> 0 AND fb <= ab AND lf >= ae AS ok FROM g)
        SELECT doc_id AS example_id, CAST(window_no AS INTEGER) AS window_no,
        CAST(CASE WHEN ok THEN q + 2 + nb - 1 ELSE 0 END AS INTEGER) AS start_position,
        CAST(CASE WHEN ok THEN q + 2 + ns ELSE 0 END AS INTEGER) AS end_position,
        CAST(CASE WHEN ok THEN CASE WHEN nb = nc THEN 383 ELSE q + 2 + nb - 1 END ELSE 0 END AS INTEGER) AS compat_start FROM h""",
    "qa_nbest": f"""WITH {SCORED} SELECT doc_id AS example_id, CAST(row_number() OVER w - 1 AS INTEGER) AS place, txt AS text, score,
        sl AS start_logit, el AS end_logit, round(exp(score - max(score) OVER v) / sum(exp(score - mx)) OVER v, 6) AS probability
        FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS mx FROM allp)
        WINDOW w AS (PARTITION BY doc_id ORDER BY rk), v AS (PARTITION BY doc_id)""",
    "qa_nbest_examples": f"""WITH {EXAMPLE_FORM} SELECT doc_id AS example_id, CAST(row_number() OVER w - 1 AS INTEGER) AS place, txt AS text, score,
        sl AS start_logit, el AS end_logit, round(exp(score - max(score) OVER v) / sum(exp(score - mx)) OVER v, 6) AS probability
        FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS mx FROM allp)
        WINDOW w AS (PARTITION BY doc_id ORDER BY rk), v AS (PARTITION BY doc_id)""",
    "qa_unmatched": """SELECT doc_id AS example_id, CAST(0 AS BIGINT) AS n_features, CAST(1 AS BIGINT) AS n_examples
        FROM documents WHERE doc_id % 5 = 0""",
    "qa_null": f"""WITH {SCORED}, nul AS (SELECT doc_id, s + e AS ns, s, e FROM lg WHERE p = 0
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s + e, window_no) = 1),
        nn AS (SELECT doc_id, txt, sl, el FROM lst WHERE txt <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rk) = 1),
        z AS (SELECT ex.doc_id, coalesce(txt, 'empty') AS txt, ns - coalesce(sl, 0) - coalesce(el, 0) AS d FROM ex JOIN nul USING (doc_id) LEFT JOIN nn USING (doc_id))
        SELECT doc_id AS id, CASE WHEN d > -150.0 THEN '' ELSE txt END AS prediction_text, d AS score_diff FROM z""",
    "qa_em_f1": f"WITH {F1} SELECT doc_id AS id, em AS exact_match, round(f1, 6) AS f1 FROM sc",
    "qa_metric": f"""WITH {F1} SELECT lang, round(avg(em) * 100, 6) AS exact_match, round(avg(f1) * 100, 6) AS f1, count(*) AS n
        FROM sc GROUP BY lang""",
    "qa_metric_missing": f"""WITH {F1} SELECT lang, round(avg(CASE WHEN doc_id % 2 = 0 THEN em ELSE 0 END) * 100, 6) AS exact_match,
        round(avg(CASE WHEN doc_id % 2 = 0 THEN f1 ELSE 0 END) * 100, 6) AS f1, count(*) AS n FROM sc GROUP BY lang""",
    "nbest_json": f"""WITH {SCORED} SELECT doc_id AS id, CAST(row_number() OVER w - 1 AS INTEGER) AS place, txt AS text,
        sl AS start_logit, el AS end_logit, round(exp(score - max(score) OVER v) / sum(exp(score - mx)) OVER v, 6) AS probability
        FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS mx FROM allp)
        WINDOW w AS (PARTITION BY doc_id ORDER BY rk), v AS (PARTITION BY doc_id)""",
    "qa_flatten": f"""WITH {EXAMPLES} SELECT 'english-' || d.doc_id AS id, 'en' AS lang, 0 AS article_no, 0 AS paragraph_no, 0 AS qa_no,
        '  ' || d.lang || ' ' || d.source || ' ' || d.n_chars AS question, CAST(length(d.text) AS INTEGER) AS n
        FROM documents d JOIN ex USING (doc_id) WHERE d.lang = 'en'""",
    "qa_rejects": rf"""WITH d AS MATERIALIZED (SELECT doc_id, lang, text, {words('text')} AS tokens FROM documents WHERE doc_id % 7 = 0),
        c AS (SELECT *, len(tokens) AS n, (doc_id * 31) % len(tokens) AS k FROM d WHERE len(tokens) > 0),
        ex AS MATERIALIZED (SELECT doc_id, lang, text, length(array_to_string(tokens[1:k + 1], '')) - length(regexp_replace(tokens[k + 1], '^\s+', '')) AS a_beg,
            length(array_to_string(tokens[1:least(k + 3, n)], '')) AS a_end FROM c)
        SELECT CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' ELSE 'spanish' END
        || '-' || doc_id AS id, CAST(a_beg + 1 AS INTEGER) AS answer_start FROM ex
        WHERE substr(text, a_beg + 2, a_end - a_beg) <> substr(text, a_beg + 1, a_end - a_beg)""",
}
