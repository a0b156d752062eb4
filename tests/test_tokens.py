import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from procspark.functions.tokens import attention_mask, offsets, words
from procspark.operators import batches as bt, choices as ch, packing as pk, qa_windows as qw

TEXT = ["", "  lead", "one two\n\nthree ", "é 日本 \t x", " ".join(f"w{i}" for i in range(900))]


def test_words_and_offsets(spark):
    d = spark.createDataFrame([(t,) for t in TEXT] + [(None,)], "t string").coalesce(1)
    got = d.select("t", words(F.col("t")).alias("w"), offsets(words(F.col("t"))).alias("o")).collect()
    for r in got[:-1]:
        assert r.w == re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+", r.t)
        assert [tuple(x) for x in r.o] == [m.span() for m in re.finditer(r"[^ \t\n\x0b\f\r]+", r.t)]


def test_spans_of_a_batch_take_little_memory_besides_it():
    import pyarrow as pa
    from procspark.functions.tokens import _token_spans
    tokens = pa.array([[" word"] * 500, None, []] * 2000 + [["a"] * 100_000])
    import tracemalloc
    tracemalloc.start()  # numpy reports to it
    spans = _token_spans(tokens)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 8 * 1_100_000
    assert spans[0].as_py()[:2] == [{"start": 1, "end": 5}, {"start": 6, "end": 10}] and spans[1].as_py() == [] and spans[2].as_py() == []
    assert spans[-1].as_py()[-1] == {"start": 99_999, "end": 100_000} and len(spans) == len(tokens)


def test_attention_mask(spark):
    d = spark.createDataFrame([(2, 4), (0, 0), (3, 3)], "n int, l int")
    assert [r[0] for r in d.select(attention_mask(F.col("n"), F.col("l"))).collect()] == [[1, 1, 0, 0], [], [1, 1, 1]]


@pytest.mark.parametrize("block", [1, 7, 512])
def test_pack_blocks(spark, block):
    rnd = random.Random(block)
    docs = [(i, [rnd.randrange(1000) for _ in range(rnd.choice([0, 1, 5, 40, 700]))]) for i in range(60)]
    d = spark.createDataFrame(docs, "row_id bigint, ids array<int>").withColumn("twice", F.transform("ids", lambda x: x * 2))
    got = pk.pack_blocks(d, ["ids", "twice"], block, batch=F.floor(F.col("row_id") / 20)).orderBy("batch_id", "block_id").collect()
    want = []
    for b in range(3):
        flat = [x for i, xs in docs if i // 20 == b for x in xs]
        want += [flat[k:k + block] for k in range(0, len(flat) - block + 1, block)]
    assert [r.ids for r in got] == want and all(r.twice == [2 * x for x in r.ids] for r in got)


def test_blank_lines_strip_and_scored(spark):
    d = spark.createDataFrame([("  a ", "b\xa0"), (" \xa0", "x"), ("", None)], "t string, p string")
    assert [r.t for r in pk.drop_blank_lines(d, "t").collect()] == ["  a "]
    assert [tuple(r) for r in pk.strip_texts(d, "t", "p").collect()] == [("a", "b"), ("", "x"), ("", None)]
    assert pk.tokenize(d, "t", keep=["p"]).columns == ["p", "tokens"]
    n = spark.createDataFrame([([1, -100, 2],), ([],)], "l array<int>").select(pk.scored_tokens(F.col("l")))
    assert [r[0] for r in n.collect()] == [2, 0]


def test_padding(spark):
    d = spark.createDataFrame([(0, 0, [1, 2, 3], [1, 2, 3]), (1, 0, [4], [4]), (2, 1, [5, 6], [5, 6])],
                              "row_id bigint, batch_id bigint, input_ids array<int>, labels array<int>")
    left = [(r.input_ids, r.attention_mask, r.labels) for r in bt.pad_batches(d, 9, labels=["labels"]).orderBy("row_id").collect()]
    assert left[1] == ([9, 9, 4], [0, 0, 1], [-100, -100, 4]) and left[2] == ([5, 6], [1, 1], [5, 6])
    right = bt.pad_batches(d, 9, side="right", max_length=4).orderBy("row_id").collect()
    assert right[1].input_ids == [4, 9, 9, 9] and right[1].attention_mask == [1, 0, 0, 0]
    c = spark.createDataFrame([(0, [[1], [2, 3]]), (0, [[4, 5, 6], []])], "batch_id bigint, input_ids array<array<int>>")
    got = sorted(map(tuple, bt.pad_choice_batches(c, 0).select("input_ids", "attention_mask").collect()))
    assert got == [([[1, 0, 0], [2, 3, 0]], [[1, 0, 0], [1, 1, 0]]), ([[4, 5, 6], [0, 0, 0]], [[1, 1, 1], [0, 0, 0]])]


def test_choices(spark):
    d = spark.createDataFrame([(7, "c", "q", "x", "y", "z")], "row_id bigint, context string, question string, a string, b string, c2 string")
    long = ch.expand_choices(d, "context", "question", ["a", "b", "c2"])
    assert sorted((r.choice_pos, r.text, r.text_pair) for r in long.collect()) == [(0, "c q", "x"), (1, "c q", "y"), (2, "c q", "z")]
    assert ch.regroup_choices(long, ["text", "text_pair"]).first().text_pair == ["x", "y", "z"]
    s = ch.stack_columns(spark.range(1000).selectExpr("id", "'s' a", "'t' b"), "a", "b", "id")
    assert s.count() == 2000 and s.filter("side = 1 and sentence = 't'").count() == 1000


def _examples(spark):
    rnd = random.Random(5)
    rows = []
    for i, n in enumerate([1, 5, 20, 21, 37, 90, 200]):
        toks = [f"t{rnd.randrange(50)}" for _ in range(n)]
        text = " ".join(toks)
        for k in {0, n // 2, n - 1}:
            start = len(" ".join(toks[:k])) + (1 if k else 0)
            rows.append((f"{i}-{k}", " what  is it", text, ([toks[k]], [start])))
        rows.append((f"{i}-none", "q", text, ([], [])))
    return spark.createDataFrame(rows, "id string, question string, context string, answers struct<text:array<string>,answer_start:array<int>>"), rows


def _walk(offs, seq, answers, cls, compat):
    """Literal statement of the labelling rule over a feature's positions."""
    if not answers[1]:
        return cls, cls
    a, z = answers[1][0], answers[1][0] + len(answers[0][0])
    ctx = [p for p, s in enumerate(seq) if s == 1]
    if not (offs[ctx[0]][0] <= a and offs[ctx[-1]][1] >= z):
        return cls, cls
    if compat:
        s = ctx[0]
        while s < len(offs) and offs[s][0] <= a:
            s += 1
        s -= 1
    else:
        s = max(p for p in ctx if offs[p][0] <= a)
    e = ctx[-1]
    while offs[e][1] >= z:
        e -= 1
    return s, e + 1


@pytest.mark.parametrize("context_first", [False, True])
def test_windows_and_span_labels(spark, context_first):
    d, rows = _examples(spark)
    by_id = {r[0]: r for r in rows}
    args = dict(max_length=24, stride=6, context_first=context_first)
    feats = qw.eval_features(d, **args)
    plain = {(r.example_id, r.window_no): r for r in qw.span_labels(feats).collect()}
    compat = {(r.example_id, r.window_no): r.start_position for r in qw.span_labels(feats, compat=True).collect()}
    seen = {}
    for (ex, w), r in plain.items():
        q = len(by_id[ex][1].split())
        n = len(by_id[ex][2].split())
        width = 24 - 3 - q
        assert r.context_start == w * (width - 6) and r.n_context == min(width, n - r.context_start)
        seen.setdefault(ex, set()).update(range(r.context_start, r.context_start + r.n_context))
        at = 1 if context_first else q + 2
        seq = [1 if at <= p < at + r.n_context else 0 for p in range(r.n_positions)]
        assert [o is not None for o in r.offset_mapping] == [s == 1 for s in seq]
        offs = [tuple(o) if o else (0, 0) for o in r.offset_mapping]
        text = by_id[ex][2]
        assert [text[a:b] for a, b in offs if b] == text.split()[r.context_start:r.context_start + r.n_context]
        assert (r.start_position, r.end_position) == _walk(offs, seq, by_id[ex][3], 0, False)
        if not context_first:
            assert compat[(ex, w)] == _walk(offs, seq, by_id[ex][3], 0, True)[0]
    assert all(s == set(range(len(by_id[ex][2].split()))) for ex, s in seen.items())


def test_question_too_long(spark):
    d = spark.createDataFrame([("1", "q " * 30, "a b c")], "id string, question string, context string")
    with pytest.raises(PySparkException):
        qw.qa_features(d, max_length=24, stride=6).collect()


def test_batches_go_by_position_not_by_id(spark):
    from procspark.operators import batches as bt, packing as pk
    ids = [0, 1000, 70_000, 2_000_000]
    df = spark.createDataFrame([(i, list(range(300))) for i in ids], "row_id long, t array<int>")
    assert pk.pack_blocks(df, ["t"], 512).count() == 2
    got = {r.row_id: r.batch_id for r in bt.with_batch(df, "row_id", 2).collect()}
    assert got == {0: 0, 1000: 0, 70_000: 1, 2_000_000: 1}
