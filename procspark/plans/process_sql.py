"""The queries of ``process`` in DuckDB SQL."""

from __future__ import annotations

from procspark.operators.prompts import PAIRS_TASK, TREE_TASK


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hash_sql(expr: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({expr} AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT)"


LOG = """
log AS (SELECT CAST(user_id AS VARCHAR) AS model_id,
               CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS revision_id,
               CAST(user_id AS VARCHAR) || '|' || CAST(CAST(ts AS DATE) AS VARCHAR) AS case_id,
               ts, event_id, event_type AS activity FROM events),
tr AS (SELECT model_id, revision_id, case_id, min(event_id) AS row_id,
              list(activity ORDER BY ts, event_id) AS trace FROM log GROUP BY ALL),
acts AS (SELECT model_id, revision_id, list_sort(list(DISTINCT activity)) AS acts FROM log GROUP BY ALL),
base AS (SELECT tr.*, acts, model_id || '_' || revision_id AS id FROM tr JOIN acts USING (model_id, revision_id)),
dedup AS (SELECT * FROM base QUALIFY row_number() OVER (
            PARTITION BY model_id, revision_id, acts, trace ORDER BY row_id) = 1),
clean AS (SELECT * FROM dedup WHERE len(acts) > 1)"""

SPLIT = f"""
split AS (SELECT *, CASE WHEN part < 100 THEN 'test' WHEN part < 280 THEN 'val' ELSE 'train' END AS split
          FROM (SELECT *, floor({hash_sql('id', 4)} * 1000 / 4294967296) AS part FROM clean))"""

PAIRS = """
ev AS (SELECT DISTINCT a.model_id, a.revision_id, a.case_id, a.activity AS src, b.activity AS dst
       FROM log a JOIN log b ON a.case_id = b.case_id AND (a.ts, a.event_id) < (b.ts, b.event_id)),
evr AS (SELECT ev.*, acts, row_id FROM ev JOIN acts USING (model_id, revision_id)
        JOIN (SELECT case_id, row_id FROM tr) USING (case_id) WHERE len(acts) > 1
        QUALIFY row_number() OVER (PARTITION BY model_id, revision_id, src, dst ORDER BY row_id) = 1)"""

PREFIX = """
pre AS (SELECT model_id, revision_id, row_id, acts, trace, k AS prefix_len, trace[1:k] AS prefix,
               coalesce(trace[k + 1], '[END]') AS nxt
        FROM (SELECT *, unnest(range(1, len(trace) + 1)) AS k FROM base WHERE len(acts) > 1)),
lab AS (SELECT *, CASE WHEN nxt = '[END]' THEN 0 ELSE list_position(acts, nxt) END AS labels FROM pre),
nxt AS (SELECT * FROM lab QUALIFY row_number() OVER (
            PARTITION BY model_id, revision_id, trace, prefix ORDER BY row_id) = 1)"""

MODELS = """
edge AS (SELECT DISTINCT model_id, revision_id, src, dst FROM (
           SELECT model_id, revision_id, activity AS src,
                  lead(activity) OVER (PARTITION BY case_id ORDER BY ts, event_id) AS dst FROM log)
         WHERE dst IS NOT NULL),
models AS (SELECT model_id, revision_id, acts, list(struct_pack(src, dst) ORDER BY src, dst) AS dfg
           FROM edge JOIN acts USING (model_id, revision_id) GROUP BY ALL)"""


def py_list(expr: str) -> str:
    return f"'[' || array_to_string(list_transform({expr}, lambda x: '''' || x || ''''), ', ') || ']'"


def cap(expr: str) -> str:
    return f"list_transform({expr}, lambda x: upper(x[1]) || lower(x[2:]))"


def numbered(expr: str) -> str:
    return (f"array_to_string(list_transform({cap(expr)}, "
            f"lambda x, i: CAST(i AS VARCHAR) || '. ' || x || chr(10)), '')")


TRACE_TEXT = (f"'Set of process activities: ' || {py_list('acts')} || chr(10) || 'Process: ' || {py_list('trace')}")
PAIR_TEXT = (f"'Set of activities: ' || {py_list('acts')} || chr(10) || 'Ordered activities: ' || "
             f"{py_list('[src, dst]')}")
TAIL = "chr(10) || ': Valid: '"
VALID = "CAST(NOT list_contains(trace, 'error') AS INTEGER)"
SEQ = f"'Sequence of activities: ' || {py_list(cap('prefix'))} || chr(10)"
LETTERS = (f"array_to_string(list_transform({cap('acts')}, "
           "lambda x, i: chr(CAST(i + 64 AS INTEGER)) || '. ' || x || chr(10)), '')")
QUESTION = "'Which one of the above activities should follow the below sequence of activities?' || chr(10)"
EDGES = "array_to_string(list_transform(dfg, lambda p: p.src || '>' || p.dst), '|')"
PAIR_PROMPT = f"{lit(PAIRS_TASK)} || chr(10) || {numbered('acts')} || 'Pairs of activities:' || chr(10)"
PAIR_TARGET = ("array_to_string(list_transform(dfg, lambda p: upper(p.src[1]) || lower(p.src[2:]) || ' -> ' || "
               "upper(p.dst[1]) || lower(p.dst[2:])), chr(10))")
TREE_PROMPT = f"{lit(TREE_TASK)} || chr(10) || {numbered('acts')} || 'Process Tree:' || chr(10)"
TREE = "'-> ( ' || array_to_string(list_transform(acts, lambda x: '''' || x || ''''), ', ') || ' )'"

SQL = {
    "trace_build": f"""WITH {LOG} SELECT model_id, revision_id, case_id, row_id,
        array_to_string(trace, '|') AS trace, array_to_string(acts, '|') AS activities FROM base""",
    "activity_sets": f"""WITH {LOG} SELECT model_id, revision_id, array_to_string(acts, '|') AS activities FROM acts""",
    "trace_dedup": f"""WITH {LOG} SELECT row_id, case_id, array_to_string(trace, '|') AS trace,
        CAST(len(list_filter(trace, lambda x: x = 'error')) AS INTEGER) AS n_anomalies FROM dedup""",
    "trace_only_dedup": f"""WITH {LOG} SELECT row_id, model_id, array_to_string(trace, '|') AS trace FROM base
        QUALIFY row_number() OVER (PARTITION BY model_id, revision_id, trace ORDER BY row_id) = 1""",
    "group_split": f"""WITH {LOG} SELECT row_id, id, CASE WHEN CAST(model_id AS BIGINT) % 10 < 7 THEN 'train'
        WHEN CAST(model_id AS BIGINT) % 10 < 9 THEN 'val' ELSE 'test' END AS split,
        CAST(len(acts) AS INTEGER) AS num_unique_activities FROM clean""",
    "hash_group_split": f"WITH {LOG}, {SPLIT} SELECT row_id, id, split FROM split",
    "split_dispatch": f"""WITH {LOG}, {SPLIT} SELECT asked, row_id, split FROM split
        JOIN (VALUES ('train', 'train'), ('val', 'val'), ('dev', 'test')) AS a(asked, split) USING (split)""",
    "trace_validity_prompt": f"""WITH {LOG}, {SPLIT} SELECT row_id, split, {VALID} AS labels,
        {TRACE_TEXT} || {TAIL} AS prompt FROM split""",
    "trace_classifier_text": f"WITH {LOG} SELECT row_id, {VALID} AS labels, {TRACE_TEXT} AS text FROM clean",
    "pair_validity_prompt": f"""WITH {LOG}, {PAIRS} SELECT model_id, revision_id, row_id,
        CAST(NOT src > dst AS INTEGER) AS labels, {PAIR_TEXT} || {TAIL} AS prompt FROM evr""",
    "pair_classifier_text": f"""WITH {LOG}, {PAIRS} SELECT model_id, revision_id,
        CAST(NOT src > dst AS INTEGER) AS labels, {PAIR_TEXT} AS text FROM evr""",
    "prefix_next": f"""WITH {LOG}, {PREFIX} SELECT row_id, CAST(prefix_len AS INTEGER) AS prefix_len,
        array_to_string(prefix, '|') AS prefix, nxt AS next, CAST(labels AS INTEGER) AS labels FROM lab""",
    "next_activity_prompt": f"""WITH {LOG}, {PREFIX} SELECT row_id, CAST(prefix_len AS INTEGER) AS prefix_len,
        CAST(labels AS INTEGER) AS labels, 'List of activites:' || chr(10) || '0. [END]' || chr(10) || {LETTERS}
        || {QUESTION} || {SEQ} || 'Answer: ' AS prompt FROM nxt WHERE nxt <> '[END]'""",
    "next_activity_menu": f"""WITH {LOG}, {PREFIX} SELECT row_id, CAST(prefix_len AS INTEGER) AS prefix_len,
        CAST(labels AS INTEGER) AS labels, chr(10) || '0. [END]' || chr(10) || {numbered('acts')} || {SEQ} AS text
        FROM nxt WHERE nxt <> '[END]'""",
    "label_tokens": f"""WITH {LOG}, {PREFIX} SELECT CAST(labels AS INTEGER) AS labels,
        CASE WHEN labels = 0 THEN '0' ELSE chr(CAST(labels + 64 AS INTEGER)) END AS token, count(*) AS n
        FROM nxt WHERE nxt <> '[END]' GROUP BY ALL""",
    "dfg_pairs": f"WITH {LOG}, {MODELS} SELECT model_id, revision_id, {EDGES} AS dfg FROM models",
    "dfg_prompt": f"""WITH {LOG}, {MODELS} SELECT model_id, revision_id, {PAIR_PROMPT} AS prompt,
        {PAIR_TARGET} || '</s>' AS target, {PAIR_PROMPT} || {PAIR_TARGET} || '</s>' AS text FROM models""",
    "dfg_prompt_eval": f"""WITH {LOG}, {MODELS} SELECT model_id, revision_id, {PAIR_PROMPT} AS text,
        {PAIR_TARGET} AS label_strings FROM models""",
    "tree_prompt": f"""WITH {LOG}, {MODELS} SELECT model_id, revision_id, {TREE} || '</s>' AS target,
        {TREE_PROMPT} || {TREE} || '</s>' AS text FROM models""",
    "tree_prompt_head16": f"""WITH {LOG}, {MODELS} SELECT row_id, {TREE_PROMPT} AS text,
        {TREE} || '</s>' AS label_strings FROM models JOIN (SELECT model_id, revision_id, min(event_id) AS row_id
        FROM log GROUP BY ALL) USING (model_id, revision_id) ORDER BY row_id LIMIT 16""",
    "parse_set_text": f"""WITH {LOG}, {MODELS} SELECT model_id, revision_id, array_to_string(acts, '|') AS activities
        FROM models""",
    "parse_pair_text": f"WITH {LOG}, {MODELS} SELECT model_id, revision_id, {EDGES} AS dfg FROM models",
    "activity_size_share": f"""WITH {LOG}, {SPLIT}, c AS (SELECT split, len(acts) AS k, count(*) AS n FROM split
        GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY split) AS sh FROM c)
        SELECT split, CAST(k AS INTEGER) AS n_activities, n, round(sh, 6) AS share,
        round(sum(sh) OVER (PARTITION BY split ORDER BY k), 6) AS cum_share FROM s""",
    "balanced_sample": f"""WITH {LOG}, {SPLIT} SELECT row_id, split, {VALID} AS labels FROM split
        QUALIFY row_number() OVER (PARTITION BY split, {VALID} ORDER BY {hash_sql('row_id', 4)}, row_id) <= 50""",
    "few_shot": f"""WITH {LOG} SELECT row_id, id FROM clean ORDER BY {hash_sql('row_id', 7)}, row_id LIMIT 32""",
    "epoch_order": f"""WITH {LOG} SELECT row_id, row_number() OVER (
        ORDER BY {hash_sql("(row_id || ':3')", 1)}, row_id) - 1 AS position FROM clean""",
    "task_batches": f"""WITH {LOG}, u AS (SELECT row_id, 'trace' AS task FROM clean UNION ALL
        SELECT event_id, 'activity' FROM events) SELECT row_id, task,
        CAST(floor((row_number() OVER (PARTITION BY task ORDER BY row_id) - 1) / 32) AS BIGINT) AS batch_id FROM u""",
}
