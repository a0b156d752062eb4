import json
import math
import random

import pytest
from pyspark.sql import functions as F

from procspark.operators import qa_answers as qa

SCHEMA = ("example_id string, window_no int, start_logits array<double>, end_logits array<double>, "
          "offset_mapping array<struct<start:int,end:int>>, token_is_max_context map<string,boolean>")


def _features(seed, max_context):
    rnd = random.Random(seed)
    feats, ctx = [], {}
    for e in range(12):
        toks = [rnd.choice("abc") * rnd.randrange(1, 4) for _ in range(rnd.randrange(1, 40))]
        ctx[str(e)] = " ".join(toks)
        spans, at = [], 0
        for t in toks:
            spans.append((at, at + len(t)))
            at += len(t) + 1
        for w, c in enumerate(range(0, len(toks), 15)):
            part = spans[c:c + 20]
            offs = [None] * 3 + part + [None]
            if e == 3:
                offs = [None] * len(offs)
            n = len(offs)
            logits = [[float(rnd.randrange(12)) for _ in range(n)] for _ in range(2)]
            flags = {str(i): rnd.random() < .7 for i in range(n) if rnd.random() < .9} if max_context and w % 2 else None
            feats.append((str(e), w, *logits, offs, flags))
    ctx["empty"] = "no feature"
    return feats, ctx


def brute(feats, context, negatives, n_best=20, max_len=30, threshold=0.0):
    prelim, null = [], None
    for _, _, s, e, offs, flags in feats:
        if null is None or null["score"] > s[0] + e[0]:
            null = {"o": (0, 0), "score": s[0] + e[0], "s": s[0], "e": e[0]}
        order = lambda x: sorted(range(len(x)), key=lambda i: (x[i], i))[::-1][:n_best]
        for i in order(s):
            for j in order(e):
                if offs[i] is None or offs[j] is None or j < i or j - i + 1 > max_len:
                    continue
                if flags is not None and not flags.get(str(i), False):
                    continue
                prelim.append({"o": (offs[i][0], offs[j][1]), "score": s[i] + e[j], "s": s[i], "e": e[j]})
    if negatives and null:
        prelim.append(null)
    preds = sorted(prelim, key=lambda p: p["score"], reverse=True)[:n_best]
    if negatives and null and not any(p["o"] == (0, 0) for p in preds):
        preds.append(null)
    for p in preds:
        p["text"] = context[p["o"][0]:p["o"][1]]
    if not preds or (len(preds) == 1 and preds[0]["text"] == ""):
        preds.insert(0, {"text": "empty", "score": 0.0, "s": 0.0, "e": 0.0})
    z = sum(math.exp(p["score"] - max(q["score"] for q in preds)) for p in preds)
    probs = [math.exp(p["score"] - max(q["score"] for q in preds)) / z for p in preds]
    if not negatives:
        return preds, probs, preds[0]["text"]
    best = next((p for p in preds if p["text"]), None)
    lost = best is None or (null is not None and null["score"] - best["s"] - best["e"] > threshold)
    return preds, probs, "" if lost else best["text"]


@pytest.mark.parametrize("negatives,max_context,threshold", [(False, False, 0.0), (True, False, 0.0), (True, True, -8.0), (False, True, 0.0)])
def test_nbest_against_brute_force(spark, negatives, max_context, threshold):
    feats, ctx = _features(7, max_context)
    f = spark.createDataFrame(feats, SCHEMA)
    ex = spark.createDataFrame(list(ctx.items()), "example_id string, context string")
    best = qa.nbest(f, ex, negatives, max_context="token_is_max_context" if max_context else None)
    got = {r.example_id: r.predictions for r in best.collect()}
    final = {r.id: r.prediction_text for r in qa.best_answers(best, negatives, threshold).collect()}
    assert set(got) == set(ctx)
    for e in ctx:
        preds, probs, text = brute([x for x in feats if x[0] == e], ctx[e], negatives, threshold=threshold)
        assert [(p.text, p.score, p.start_logit, p.end_logit) for p in got[e]] == [(p["text"], p["score"], p["s"], p["e"]) for p in preds]
        assert all(abs(p.probability - q) < 1e-9 for p, q in zip(got[e], probs))
        assert final[e] == text
    row = json.loads(qa.nbest_json(best).first().nbest)[0]
    assert set(row) == {"start_logit", "end_logit", "text", "probability"}


@pytest.mark.parametrize("negatives", [False, True])
def test_window_text_equals_context_text(spark, negatives):
    feats, ctx = _features(11, False)
    rows = []
    for e, w, s, z, offs, flags in feats:
        real = [o for o in offs if o]
        toks = [ctx[e][(a - 1 if a else 0):b] for a, b in real]
        rows.append((e, w, s, z, offs, flags, toks, 3))
    f = spark.createDataFrame(rows, SCHEMA + ", context_tokens array<string>, context_pos int")
    ex = spark.createDataFrame([(k, c) for k, c in ctx.items() if k != "empty"], "example_id string, context string")
    by = lambda d: {r.example_id: r.predictions for r in d.collect()}
    assert by(qa.nbest(f, negatives=negatives)) == by(qa.nbest(f, ex, negatives))


def test_squad_scores(spark):
    cases = [("The cat.", ["cat"], 1.0, 1.0), ("a big cat", ["cat", "big dog"], 0.0, 2 / 3), ("x x y", ["x y y"], 0.0, 2 / 3),
             ("none", ["other"], 0.0, 0.0), ("An (apple)!", ["  APPLE  "], 1.0, 1.0), ("theory", ["the theory"], 1.0, 1.0)]
    p = spark.createDataFrame([(str(i), c[0]) for i, c in enumerate(cases)], "id string, prediction_text string")
    r = spark.createDataFrame([(str(i), (c[1], [0] * len(c[1]))) for i, c in enumerate(cases)],
                              "id string, answers struct<text:array<string>,answer_start:array<int>>")
    s = qa.squad_scores(p, r)
    got = {x.id: (x.exact_match, x.f1) for x in s.collect()}
    for i, c in enumerate(cases):
        assert got[str(i)][0] == c[2] and abs(got[str(i)][1] - c[3]) < 1e-12
    m = qa.squad_metric(s).first()
    assert abs(m.exact_match - 50.0) < 1e-9 and m.n == 6


def test_references_without_prediction_score_zero(spark):
    refs = spark.createDataFrame([("a", (["x y"], [0])), ("b", (["z"], [0]))], "id string, answers struct<text:array<string>,answer_start:array<int>>")
    preds = spark.createDataFrame([("a", "x y"), ("c", "w")], "id string, prediction_text string")
    m = qa.squad_metric(qa.squad_scores(preds, refs)).first()
    assert (m.exact_match, m.f1, m.n) == (50.0, 50.0, 2)


def test_texts_of_a_part_read_its_own_tokens_only(monkeypatch):
    import numpy as np
    import pyarrow as pa
    tokens = pa.array([[f" w{i}", " of", f" x{i}"] for i in range(1000)])
    seen, lengths = [], qa.pc.utf8_length
    monkeypatch.setattr(qa.pc, "utf8_length", lambda a: seen.append(len(a)) or lengths(a))
    part = tokens.slice(500, 10)
    rows = np.arange(10)
    got = qa._texts({"context_tokens": part}, rows, np.ones(10, int), np.full(10, 7), np.full(10, 5))
    assert got == [f"w{i} of"[:6] for i in range(500, 510)] and seen == [30]


BLANK = ["", "   ", "\n\t ", None, "one", " two words ", "the first of some more words than three", "a line\n\nand another  "]


@pytest.fixture
def blank_texts(tmp_path):
    """Documents without a word, and others; some have no source, so no question."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    rows = [{"doc_id": i, "text": BLANK[i % 8], "lang": ["en", "de", "fr"][i % 3], "source": None if i % 11 == 5 else "web", "n_chars": len(BLANK[i % 8] or "")}
            for i in range(96)]
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema(kinds)), tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["qa_flatten", "qa_rejects"])
def test_documents_without_a_word_are_no_nested_examples(spark, blank_texts, name):
    _same_as_sql(spark, blank_texts, name)


def _same_as_sql(spark, folder, name):
    import duckdb

    import check
    from procspark import plans
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    text, ok = check.compare(spark, con, folder, name, plans.QUERIES[name], plans.SQL[name])
    assert ok and "rows=0 " not in text, text


@pytest.mark.parametrize("name", ["qa_em_f1", "qa_metric", "qa_metric_missing"])
def test_documents_without_a_word_are_not_scored(spark, blank_texts, name):
    _same_as_sql(spark, blank_texts, name)


def test_documents_without_a_word_have_no_span_labels(spark, blank_texts):
    _same_as_sql(spark, blank_texts, "qa_span_labels")


def test_windows_without_context_are_labelled_cls(spark):
    from procspark.operators import qa_windows as qw
    rows = [(1, " ", "why", ([], [])), (2, "", "why", (["a"], [0])), (3, None, "why", (["a"], [0])), (4, "a b", None, (["a"], [0])), (5, "a b", "why", (["b"], [2]))]
    df = spark.createDataFrame(rows, "id long, context string, question string, answers struct<text:array<string>,answer_start:array<int>>")
    once = qw.span_labels(qw.qa_features(df))
    both = qw.span_labels(once.withColumnsRenamed({"start_position": "s", "end_position": "e"}), compat=True)
    got = {r.example_id: (r.s, r.e, r.start_position, r.end_position) for r in both.collect()}
    assert got == {1: (0,) * 4, 2: (0,) * 4, 3: (0,) * 4, 5: (4, 4, 5, 4)}


def test_documents_without_a_word_have_no_windows(spark, blank_texts):
    _same_as_sql(spark, blank_texts, "qa_windows")


def test_answers_of_examples_are_cut_without_python(spark, tmp_path):
    import re

    import pyarrow as pa
    import pyarrow.parquet as pq

    from procspark.plans import views as v
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice([" ", "\t", "\n", "\x0b", "  "]) if rnd.random() < .3 else rnd.choice("aß漢😀é.") for _ in range(rnd.randrange(60)))
    rows = [{"doc_id": i, "text": text(), "lang": "en", "source": "w", "n_chars": 1} for i in range(-20, 200)]
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())]
    pq.write_table(pa.Table.from_pylist(rows, pa.schema(kinds)), tmp_path / "documents.parquet")
    df = v.qa_examples(spark, str(tmp_path))
    want = {}
    for r in rows:
        spans = [m.span(1) for m in re.finditer(r"[ \t\n\x0b\f\r]*([^ \t\n\x0b\f\r]+)", r["text"])]
        k = r["doc_id"] * 31 % len(spans) if spans and r["doc_id"] >= 0 else 0 if spans and r["doc_id"] * 31 % len(spans) == 0 else None
        want[r["doc_id"]] = (None, None) if k is None else (spans[k][0], r["text"][spans[k][0]:spans[min(k + 2, len(spans) - 1)][1]])
    assert {r.id: (r.answers.answer_start[0], r.answers.text[0]) for r in df.collect()} == want
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
