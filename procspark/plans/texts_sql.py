"""The queries of ``texts`` in DuckDB SQL."""

from __future__ import annotations

from procspark.operators.tags import NER_TAGS, POS_TAGS

WORDS = r"regexp_extract_all({}, '\s*\S+')"
SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"


def words(expr: str) -> str:
    return WORDS.format(expr)


def text_join(expr: str, sep: str = ",") -> str:
    return f"array_to_string({expr}, '{sep}')"


DOCS = f"docs AS (SELECT doc_id, lang, source, {words('text')} AS tokens FROM documents)"
TOK = f"""{DOCS},
tok AS (SELECT doc_id, lang, source, unnest(tokens) AS t, unnest(range(len(tokens))) AS i FROM docs)"""
TURNS = """turns AS (SELECT a.conv_id, a.turn, u.text AS usr, a.text AS assistant FROM conversations a
    JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant')"""
LOSSES = f"""{DOCS}, losses AS (SELECT doc_id, lang, len(list_filter(tokens, lambda t: length(t) % 7 <> 0)) AS num_tokens,
    ((doc_id * 37) % 100) / 25.0 AS loss FROM docs)"""
IDS = f"""{TURNS}, ids AS (SELECT conv_id, turn, list_transform({words('usr')}, lambda t: length(t)) AS p,
    list_transform({words('assistant')}, lambda t: length(t)) AS g FROM turns),
    inp AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN [-1] ELSE [] END || p || g AS ids,
            conv_id % 2 = 0 AS bos FROM ids)"""
CHOICES = f"""{TURNS}, ex AS (SELECT conv_id * 1000 + turn AS row_id, usr || ' what next?' AS text, assistant, reverse(assistant) AS c2
    FROM turns), ch AS (SELECT row_id, 0 AS choice_pos, text, assistant AS text_pair FROM ex
    UNION ALL SELECT row_id, 1, text, c2 FROM ex)"""
EVERY = f"""ev AS (SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS b,
    list_transform({words('text')}, lambda t: length(t)) AS p,
    list_transform({words('reverse(text)')}, lambda t: length(t)) AS g FROM conversations)"""
FACT = """f AS (SELECT d.lang AS dataset_name, d.source AS split, l.toxic AS p, l.quality AS y FROM labels l JOIN documents d USING (doc_id)),
    cls AS (SELECT dataset_name, split, c, count(*) FILTER (p = c AND y = c) AS tp, count(*) FILTER (p = c AND y <> c) AS fp,
    count(*) FILTER (p <> c AND y = c) AS fn FROM f, (SELECT unnest([0, 1]) AS c) GROUP BY ALL HAVING tp + fp + fn > 0)"""


TAGGED = f"""{TOK}, raw AS (SELECT doc_id, lang, i, (doc_id + i * i) % 7 AS gold,
    CASE WHEN (i * 3 + doc_id) % 5 = 0 THEN ((doc_id + i * i) % 7 + 1) % 7 ELSE (doc_id + i * i) % 7 END AS pred
    FROM tok WHERE i % 11 <> 0)"""


def chunk_f1_over(source: str, names: list[str], group: str, groups: str) -> str:
    """Chunk F1 by window functions over single tags (the engine works on whole sequences).

    ``source`` ends in a table ``raw(doc_id, lang, i, gold, pred)``.
    """
    table = "[" + ", ".join(f"'{n}'" for n in names) + "]"
    kind = "substr({0}, 1, 1)".format
    typ = ("CASE WHEN substr({0}, 2) = '' THEN '_' WHEN contains(substr({0}, 2), '-') "
           "THEN substr({0}, 2 + instr(substr({0}, 2), '-')) ELSE substr({0}, 2) END").format
    return f"""WITH {source},
    tags AS (SELECT 'g' AS side, doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos,
             {table}[gold + 1] AS tag FROM raw
             UNION ALL SELECT 'p', doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1, {table}[pred + 1] FROM raw
             UNION ALL SELECT unnest(['g', 'p']), doc_id, lang, count(*), 'O' FROM raw GROUP BY doc_id, lang),
    kd AS (SELECT *, {kind('tag')} AS k, {typ('tag')} AS ty FROM tags),
    pv AS (SELECT *, lag(k, 1, 'O') OVER w AS pk, lag(ty, 1, '') OVER w AS pt FROM kd WINDOW w AS (PARTITION BY side, doc_id ORDER BY pos)),
    ed AS (SELECT *, (pk IN ('E','S') OR (pk IN ('B','I') AND k IN ('B','S','O')) OR (pk NOT IN ('O','.') AND pt <> ty)) AS ends,
           (k IN ('B','S') OR (pk IN ('E','S','O') AND k IN ('E','I')) OR (k NOT IN ('O','.') AND pt <> ty)) AS starts FROM pv),
    be AS (SELECT *, coalesce(max(CASE WHEN starts THEN pos END) OVER (PARTITION BY side, doc_id ORDER BY pos
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM ed),
    sp AS (SELECT DISTINCT side, doc_id, lang, pt AS ty, b, pos - 1 AS e FROM be WHERE ends),
    n AS (SELECT lang, count(*) FILTER (side = 'p') AS pred, count(*) FILTER (side = 'g') AS gold FROM sp GROUP BY lang),
    hit AS (SELECT lang, count(*) AS tp FROM (SELECT doc_id, lang, ty, b, e FROM sp GROUP BY ALL HAVING count(*) = 2) GROUP BY lang),
    al AS ({groups})
    SELECT al.lang AS {group}, coalesce(tp, 0) AS tp, coalesce(pred, 0) AS pred, coalesce(gold, 0) AS gold,
    round(coalesce(2.0 * tp / (pred + gold), 0), 6) AS f1 FROM al LEFT JOIN n ON n.lang = al.lang LEFT JOIN hit ON hit.lang = al.lang"""


def chunk_f1(names: list[str]) -> str:
    return chunk_f1_over(TAGGED, names, "lang", "SELECT DISTINCT lang FROM documents")


def pad_left(expr: str, fill: str) -> str:
    return f"list_resize(CAST([] AS BIGINT[]), padded_length - n, {fill}) || {expr}"


SQL = {
    "named_union": """SELECT doc_id AS id, 'train_documents' AS dataset_name, 'train' AS split, CAST(length(text) AS INTEGER) AS n FROM documents
        UNION ALL SELECT page_id, 'train_pages', 'train', length(html) FROM pages
        UNION ALL SELECT item_id, 'test_benchmark', 'test', length(text) FROM benchmark
        UNION ALL SELECT conv_id, 'validation_conversations', 'validation', length(text) FROM conversations""",
    "strip_truncate": f"""WITH s AS (SELECT doc_id, regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') AS text FROM documents),
        w AS (SELECT doc_id, {words('text')}[1:128] AS t FROM s)
        SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, {text_join('t', '')} AS text FROM w""",
    "strip_pairs": f"""WITH {TURNS} SELECT conv_id, turn, regexp_replace(usr, '^{SPACE}+|{SPACE}+$', '', 'g') AS premise,
        regexp_replace(assistant, '^{SPACE}+|{SPACE}+$', '', 'g') AS hypothesis FROM turns""",
    "corpus_tokenize": f"""WITH {DOCS} SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, {text_join('tokens', '|')} AS tokens FROM docs""",
    "paired_metrics": """SELECT lang AS dataset_name, 'acc' AS metric, round(avg(CAST(toxic = quality AS DOUBLE)), 6) AS value
        FROM labels JOIN documents USING (doc_id) GROUP BY lang""",
    "unpaired_ids": """SELECT coalesce(d.doc_id, l.doc_id) AS row_id, CAST(d.doc_id IS NOT NULL AS BIGINT) AS n_preds,
        CAST(l.doc_id IS NOT NULL AS BIGINT) AS n_labels FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id
        WHERE d.doc_id IS NULL OR l.doc_id IS NULL""",
    "evaluation_hooks": """SELECT lang, 'acc' AS metric, round(avg(CAST(CAST(n_chars % 10 < 8 AS INTEGER) = quality AS DOUBLE)), 6) AS value
        FROM labels JOIN documents USING (doc_id) WHERE n_chars % 10 <> 5 GROUP BY lang""",
    "blank_line_filter": f"""SELECT * FROM (SELECT doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE NOT regexp_full_match(line, '{SPACE}*')""",
    "pack_blocks": f"""WITH {TOK}, nr AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 1000 AS batch_id FROM documents),
        g AS (SELECT batch_id, t, row_number() OVER (PARTITION BY batch_id ORDER BY doc_id, i) - 1 AS pos FROM tok JOIN nr USING (doc_id)) SELECT batch_id, pos // 512 AS block_id, string_agg(t, '' ORDER BY pos) AS text,
        CAST(sum(length(t)) AS INTEGER) AS n_chars FROM g GROUP BY ALL HAVING count(*) = 512""",
    "scored_tokens": f"WITH {LOSSES} SELECT doc_id, num_tokens FROM losses",
    "perplexity_by_lang": f"""WITH {LOSSES} SELECT lang, round(exp(sum(loss * num_tokens) / sum(num_tokens)), 6) AS perplexity
        FROM losses GROUP BY lang""",
    "tag_remap": f"""WITH {TOK} SELECT doc_id, string_agg(CASE WHEN (doc_id + i) % 9 < 7 THEN (doc_id + i) % 9 ELSE 0 END, ','
        ORDER BY i) AS tags FROM tok GROUP BY doc_id""",
    "tag_align": f"""WITH {TOK}, pc AS (SELECT doc_id, i, unnest(range(CAST(ceil(length(t) / 4.0) AS BIGINT))) AS k, (doc_id + i) % 7 AS y FROM tok)
        SELECT doc_id, '-100,' || string_agg(y, ',' ORDER BY i, k) || ',-100' AS all_pieces,
        '-100,' || string_agg(CASE WHEN k = 0 THEN y ELSE -100 END, ',' ORDER BY i, k) || ',-100' AS first_piece FROM pc GROUP BY doc_id""",
    "entity_f1": chunk_f1(NER_TAGS),
    "pos_chunk_f1": chunk_f1(POS_TAGS[:7]),
    "choice_expand": f"WITH {CHOICES} SELECT row_id, CAST(choice_pos AS INTEGER) AS choice_pos, text, text_pair FROM ch",
    "choice_regroup": f"""WITH {CHOICES} SELECT row_id, string_agg(len({words('text_pair')}), ',' ORDER BY choice_pos) AS n_words
        FROM ch GROUP BY row_id""",
    "choice_prompts": f"""WITH {TURNS}, b AS (SELECT *, 'Premise: "' || usr || '"' || chr(10) || 'Question: "what next?"' || chr(10)
        || 'Choice 1: "' || assistant || '"' || chr(10) || 'Choice 2: "' || reverse(assistant) || '"' || chr(10) || 'Answer: ' AS p FROM turns)
        SELECT conv_id, turn, CAST(turn % 2 AS INTEGER) AS label, p || '0' AS prompt, p AS cls_prompt FROM b""",
    "stack_pairs": f"""WITH {TURNS} SELECT conv_id * 1000 + turn AS pair_id, CAST(0 AS INTEGER) AS side, usr AS sentence FROM turns
        UNION ALL SELECT conv_id * 1000 + turn, 1, assistant FROM turns""",
    "loss_mask": f"""WITH {IDS}, m AS (SELECT conv_id, turn, list_transform(p, lambda x: -100) AS mask, g, bos FROM inp)
        SELECT conv_id, turn, {text_join("CASE WHEN bos THEN [-100] ELSE [] END || mask || g")} AS labels,
        {text_join("CASE WHEN bos THEN [-1] || mask || g ELSE mask || [-100] || g[2:] END")} AS compat_labels FROM m""",
    "last_token_label": f"""WITH {IDS} SELECT conv_id, turn, {text_join("list_transform(ids[2:], lambda x: -100) || [11 + turn % 3]")}
        AS labels FROM inp""",
    "strip_generation": f"""WITH {TURNS}, g AS (SELECT *, usr || chr(10) || CASE turn % 3 WHEN 0 THEN 'Pairs of activities:' || chr(10)
        WHEN 1 THEN 'Process Tree:' || chr(10) ELSE '' END || assistant AS t FROM turns)
        SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN t ELSE assistant END AS preds,
        CASE WHEN turn % 3 = 2 THEN substr(t, 21) ELSE assistant END AS compat_preds FROM g""",
    "pad_batches": f"""WITH {DOCS}, x AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch_id, list_transform(tokens, lambda t: length(t)) AS ids FROM docs),
        l AS (SELECT *, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch_id) AS padded_length FROM x)
        SELECT doc_id, batch_id, CAST(padded_length AS INTEGER) AS padded_length, {text_join(pad_left('ids', '0'))} AS input_ids,
        {text_join(pad_left("list_transform(ids, lambda v: 1)", '0'))} AS attention_mask,
        {text_join(pad_left("list_transform(ids, lambda v: v * 2)", '-100'))} AS labels FROM l""",
    "pad_scalar_batches": f"""WITH {DOCS}, k AS (SELECT d.doc_id, list_transform(tokens[1:64], lambda t: length(t)) AS ids, l.quality AS label
            FROM docs d JOIN labels l USING (doc_id)),
        x AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM k),
        l AS (SELECT *, len(ids) AS n, max(len(ids)) OVER (PARTITION BY batch_id) AS padded_length FROM x)
        SELECT doc_id, batch_id, label, {text_join('list_resize(ids, padded_length, 0)')} AS input_ids,
        {text_join('list_resize(list_transform(ids, lambda v: 1), padded_length, 0)')} AS attention_mask FROM l""",
    "pad_choice_batches": f"""WITH {EVERY}, l AS (SELECT *, max(greatest(len(p), len(g))) OVER (PARTITION BY b) AS m FROM ev)
        SELECT conv_id, turn, CAST(m AS INTEGER) AS padded_length,
        {text_join('list_resize(p, m, 0)')} || '|' || {text_join('list_resize(g, m, 0)')} AS input_ids,
        {text_join('list_resize(list_transform(p, lambda v: 1), m, 0)')} || '|' ||
        {text_join('list_resize(list_transform(g, lambda v: 1), m, 0)')} AS attention_mask FROM l""",
    "length_mask": f"""WITH {EVERY}, l AS (SELECT *, max(len(p)) OVER (PARTITION BY b) AS m FROM ev)
        SELECT conv_id, turn, {text_join('list_resize(list_transform(p, lambda v: 1), m, 0)')} AS mask FROM l""",
    "dataset_union_metrics": f"""WITH {FACT}, m AS (SELECT dataset_name, split, sum(tp) / (sum(tp) + sum(fn)) AS acc,
        2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS micro_f1, avg(2.0 * tp / (2 * tp + fp + fn)) AS macro_f1 FROM cls GROUP BY ALL)
        SELECT dataset_name, split, metric, round(value, 6) AS value FROM (
          SELECT dataset_name, split, 'acc' AS metric, acc AS value FROM m UNION ALL
          SELECT dataset_name, split, 'micro_f1', micro_f1 FROM m UNION ALL SELECT dataset_name, split, 'macro_f1', macro_f1 FROM m)""",
}
