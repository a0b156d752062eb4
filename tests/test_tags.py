import random

import pytest
from pyspark.sql import functions as F

from procspark.operators import tags as tg


def chunks(tags):
    """Sequential statement of the chunk rules."""
    out, prev, prev_t, begin = [], "O", "", 0
    for i, tag in enumerate(tags + ["O"]):
        kind, typ = tag[0], tag[1:].split("-", 1)[-1] or "_"
        end = (prev in "ES" or (prev in "BI" and kind in "BSO") or (prev not in "O." and prev_t != typ))
        start = (kind in "BS" or (prev in "ESO" and kind in "EI") or (kind not in "O." and prev_t != typ))
        if end:
            out.append((prev_t, begin, i - 1))
        if start:
            begin = i
        prev, prev_t = kind, typ
    return out


NAMES = [tg.NER_TAGS, tg.POS_TAGS, ["O", "B-A", "I-A", "E-A", "S-A", "I-B", "X", ".", "B-a-b"]]


@pytest.mark.parametrize("names", NAMES)
def test_spans_match_the_sequential_rule(spark, names):
    rnd = random.Random(len(names))
    rows = [([rnd.randrange(len(names)) for _ in range(n)], [rnd.choice([-100, 0, 1]) for _ in range(n)])
            for n in [0, 1, 2, 3, 10, 50, 300] * 4]
    d = spark.createDataFrame(rows, "p array<int>, y array<int>").coalesce(1)
    got = [[tuple(s) for s in r[0]] for r in d.select(tg.entity_spans(F.col("p"), F.col("y"), names)).collect()]
    assert got == [chunks([names[a] for a, b in zip(p, y) if b != -100]) for p, y in rows]


def test_entity_f1(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(40):
        y = [rnd.choice([-100] + list(range(7))) for _ in range(30)]
        rows.append(("ab"[i % 2], [t if rnd.random() < .8 and t >= 0 else rnd.randrange(7) for t in y], y))
    d = spark.createDataFrame(rows, "lang string, p array<int>, y array<int>")
    for r in tg.entity_f1(d, "p", "y", tg.NER_TAGS, ["lang"]).collect():
        tp = n_p = n_g = 0
        for lang, p, y in rows:
            if lang == r.lang:
                keep = [(a, b) for a, b in zip(p, y) if b != -100]
                a, b = (set(chunks([tg.NER_TAGS[k[i]] for k in keep])) for i in (0, 1))
                tp, n_p, n_g = tp + len(a & b), n_p + len(a), n_g + len(b)
        assert (r.tp, r.pred, r.gold) == (tp, n_p, n_g) and abs(r.f1 - 2 * tp / (n_p + n_g)) < 1e-12


def test_entity_f1_from_logits_and_empty(spark):
    d = spark.createDataFrame([([[0.0, 2.0], [3.0, 1.0]], [1, 0])], "p array<array<double>>, y array<int>")
    assert tg.entity_f1(d, "p", "y", ["O", "B-A"]).first().f1 == 1.0
    assert tg.entity_f1(d.limit(0), "p", "y", ["O", "B-A"]).first().f1 == 0.0


def test_align(spark):
    d = spark.createDataFrame([([None, 0, 0, 1, None], ["B-PER", "O"])], "word_ids array<int>, ner_tags array<string>")
    names = {"text": "tokens", "label": "ner_tags"}
    ids = {n: i for i, n in enumerate(tg.NER_TAGS)}
    assert tg.align_table(d, names, label2id=ids).first().labels == [-100, 1, 1, 0, -100]
    assert tg.align_table(d, names, label_all=False, label2id=ids).first().labels == [-100, 1, -100, 0, -100]
    with pytest.raises(ValueError):
        tg.align_table(d, {"text": "tokens"})


def test_remap(spark):
    d = spark.createDataFrame([([0, 6, 7, 8],)], "t array<int>")
    assert d.select(tg.remap_tags(F.col("t"))).first()[0] == [0, 6, 0, 0]


def test_ragged_and_null_rows_do_not_shift_others(spark):
    rows = [([1, 2, 0], [1, 2]), ([1], [1, 0, 3]), (None, [1]), ([3, 4], [3, 4]), ([5], None)]
    df = spark.createDataFrame(rows, "p array<int>, y array<int>").coalesce(1)
    got = tg.entity_f1(df, "p", "y", tg.NER_TAGS).first()
    assert (got.tp, got.pred, got.gold) == (3, 3, 3)
