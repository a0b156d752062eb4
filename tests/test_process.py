import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from procspark.functions.ranking import hash_bucket, hash_order, range_bounds, range_number, spread, top_n, with_position, with_range_position
from procspark.operators import dedup_split as ds, eventlog as ev, labels as lb, prompts as pr

CASE = ["model_id", "revision_id", "case_id"]


@pytest.fixture(scope="module")
def log(spark):
    """Random log; half of all events are in one case, and one activity dominates."""
    rnd = random.Random(3)
    rows = []
    for e in range(600):
        hot = e % 2 == 0
        case = "hot" if hot else f"c{rnd.randrange(30)}"
        model = "m0" if hot else f"m{int(case[1:]) % 4}"
        ts = datetime(2024, 1, 1) + timedelta(minutes=rnd.randrange(6000))
        rows.append((model, "r", case, ts, e, rnd.choice("aaabcd")))
    return spark.createDataFrame(rows, "model_id string, revision_id string, case_id string, ts timestamp_ntz, "
                                       "event_id bigint, activity string"), rows


def _by_case(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[3], r[4])):
        out.setdefault((r[0], r[2]), []).append(r[5])
    return out


def test_traces_and_sets(log):
    df, rows = log
    got = {(r.model_id, r.case_id): r.trace for r in ev.traces(df, CASE).collect()}
    assert got == _by_case(rows)
    sets = {r.model_id: r.unique_activities for r in ev.activity_sets(df).collect()}
    assert sets == {m: sorted({r[5] for r in rows if r[0] == m}) for m in {r[0] for r in rows}}


def test_directly_follows_over_cuts(log):
    df, rows = log
    want = {}
    for (m, _), t in _by_case(rows).items():
        want.setdefault(m, Counter()).update(zip(t, t[1:]))
    edges = Counter((r.model_id, r.src, r.dst) for r in ev.follow_edges(df, CASE).collect())
    assert edges == Counter({(m, a, b): n for m, c in want.items() for (a, b), n in c.items()})
    got = {r.model_id: [tuple(p) for p in r.dfg] for r in ev.directly_follows(df, CASE).collect()}
    assert got == {m: sorted(c) for m, c in want.items()}


def test_eventually_follows(log):
    df, rows = log
    got = {(r.model_id, r.case_id, tuple(r.eventually_follows)) for r in ev.eventually_follows(df, CASE).collect()}
    assert got == {(m, c, (t[i], t[j])) for (m, c), t in _by_case(rows).items()
                   for i in range(len(t)) for j in range(i + 1, len(t))}


def test_prefixes_and_labels(spark):
    df = spark.createDataFrame([(1, ["b", "a"], ["a", "b"])], "row_id bigint, trace array<string>, unique_activities array<string>")
    got = [(r.prefix, r.next, r.y) for r in ev.prefixes(df).withColumn("y", lb.next_class()).collect()]
    assert got == [(["b"], "a", 1), (["b", "a"], "[END]", 0)]
    assert lb.drop_end(ev.prefixes(df)).count() == 1
    odd = df.withColumn("next", F.lit("zz"))
    assert odd.select(lb.next_class()).first()[0] is None
    with pytest.raises(PySparkException):
        odd.select(lb.next_class(strict=True)).collect()


def test_dedup_keeps_first_row_also_with_null_payload(spark):
    rows = [(5, "m", "r", ["a"], ["x"], True), (2, "m", "r", ["a"], ["x"], None), (9, "m", "r", ["a"], ["y"], True)]
    df = spark.createDataFrame(rows, "row_id bigint, model_id string, revision_id string, unique_activities array<string>, "
                                     "trace array<string>, label boolean")
    got = sorted(tuple(r) for r in ds.remove_duplicates(df).collect())
    assert got == [(2, "m", "r", ["a"], ["x"], None), (9, "m", "r", ["a"], ["y"], True)]
    assert sorted(map(tuple, ds.remove_duplicates(ds.remove_duplicates(df)).collect())) == got
    text = df.withColumn("raw", F.col("row_id").cast("string"))
    assert ds.remove_duplicates(text, set_text="raw").count() == 3


def test_prefix_dedup_commutes(log):
    df, _ = log
    short = ev.with_activity_sets(ev.traces(df.filter("case_id != 'hot' and event_id < 300"), CASE), df).withColumn(
        "trace", F.slice("trace", 1, 2))
    early, late = ev.prefixes(ds.remove_duplicates(short)), ds.remove_duplicates(ev.prefixes(short))
    rows = lambda d: sorted((r.row_id, r.prefix, r.next) for r in d.collect())
    assert rows(early) == rows(late) and early.count() < ev.prefixes(short).count()


def test_split_by_ids(spark):
    df = spark.createDataFrame([("1", "a", ["x", "y"]), ("2", "a", ["x", "y"]), ("3", "a", ["x"]), ("4", "a", ["x", "y"])],
                               "model_id string, revision_id string, unique_activities array<string>")
    ids = spark.createDataFrame([("1_a", "train"), ("2_a", "test"), ("3_a", "train")], "id string, split string")
    assert {(r.id, r.split) for r in ds.split_by_ids(df, ids).collect()} == {("1_a", "train"), ("2_a", "test")}
    assert ds.overlapping_ids(ids).count() == 0
    assert ds.overlapping_ids(ids.union(spark.createDataFrame([("1_a", "val")], "id string, split string"))).first().id == "1_a"
    text = df.withColumn("unique_activities", F.lit("{'x'}"))
    assert ds.split_by_ids(text, ids, compat="charlen").count() == 3


def test_hash_split_is_disjoint_complete_and_sized(spark):
    df = spark.range(40_000).select((F.col("id") % 20_000).cast("string").alias("id"))
    for method in ("xxhash64", "md5"):
        out = ds.hash_split(df, method=method)
        assert out.count() == 40_000
        assert out.distinct().groupBy("id").count().filter("count > 1").count() == 0
        share = {r.split: r["count"] / 40_000 for r in out.groupBy("split").count().collect()}
        assert abs(share["test"] - 0.1) < 0.02 and abs(share["val"] - 0.18) < 0.02


def test_select_split(spark):
    df = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    assert [ds.select_split(df, s).count() for s in ("train", "val", "test", "other")] == [1, 1, 1, 1]
    assert ds.select_split(df, "other", unknown="all").count() == 3


def test_positions_in_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"))
    df = df.withColumn("h", hash_order(F.col("id"), seed=1))
    out = with_position(df, ["k"], [F.col("h"), F.col("id")], hash_bucket(F.col("h"), 16)).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.k, []).append((r.position, r.h, r.id))
    for g in groups.values():
        assert [p for p, *_ in sorted(g)] == list(range(len(g)))
        assert [x[1:] for x in sorted(g)] == sorted(x[1:] for x in g)


@pytest.mark.parametrize("ids", [
    range(500), [i * 10**15 - 3 * 10**17 for i in range(700)], [(i * 0x9E3779B97F4A7C15) % 2**64 - 2**63 for i in range(900)],
    [0] * 300 + [7, 5], [None, -4, None, 9], []], ids=["dense", "sparse", "hashed", "equal", "nulls", "empty"])
def test_range_positions(spark, ids):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(ids)], "v long, tie long")
    order = [F.col("v"), F.col("tie")]
    got = {r.tie: r.position for r in with_range_position(df, order, rows=40).collect()}
    want = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
    assert got == {i: n for n, i in enumerate(want)}
    keyed = with_range_position(df.withColumn("k", F.when(F.col("tie") % 3 > 0, "hot")), order, keys=["k"], rows=40).collect()
    for part in (0, 1):
        mine = [i for i in want if (i % 3 > 0) == part]
        assert {r.tie: r.position for r in keyed if (r.k is not None) == part} == {i: n for n, i in enumerate(mine)}


def test_many_ranges(spark):
    df = spark.range(0, 30_000, 3).select(F.col("id"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("t"))
    for c, kind in (("id", "bigint"), ("t", "string")):
        bounds = range_bounds(df, F.col(c), rows=50)
        assert len(bounds) > 128
        sizes = df.groupBy(range_number(F.col(c), bounds, kind).alias("r")).count().collect()
        assert {r.r for r in sizes} == set(range(1, len(bounds) + 2)) and max(r["count"] for r in sizes) < 250
        got = with_range_position(df, [F.col(c)], rows=50).collect()
        assert all(r.position * 3 == r.id for r in got)


@pytest.mark.parametrize("n", [10, 1500])
def test_top_n_small_and_large(spark, n):
    df = spark.range(9000).select("id", (F.col("id") % 2).alias("k")).withColumn("h", hash_order(F.col("id"), seed=2))
    got = {(r.k, r.id) for r in top_n(df, ["k"], F.col("h"), F.col("id"), n).collect()}
    rows = df.collect()
    want = {(k, i) for k in (0, 1) for _, i in sorted((r.h, r.id) for r in rows if r.k == k)[:n]}
    assert got == want


def test_sampling(spark):
    df = spark.range(200).select(F.col("id").alias("row_id"), F.lit("train").alias("split"), (F.col("id") % 10 == 0).alias("y"))
    assert Counter(r.y for r in ds.balanced_sample(df, "y", 15).collect()) == {True: 15, False: 15}
    assert ds.few_shot(df, 8).collect() == ds.few_shot(df, 8).collect()
    assert [r.row_id for r in ds.head(df).collect()] == list(range(16))
    one, two = (([r.row_id for r in ds.epoch_shuffle(df, e).collect()]) for e in (0, 1))
    assert one != two and sorted(one) == sorted(two)
    b = ds.task_batches(df.withColumn("task", F.lit("t")), 32)
    assert Counter(r.batch_id for r in b.collect()) == {i: 32 if i < 6 else 8 for i in range(7)}


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 10, 1, 64)
    assert spread(wide, "id") is wide


ACTS = ["be bold", "it's"]


def _one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k)
                                   for k, v in cols.items()])


def test_golden_prompts(spark):
    d = _one(spark, a=ACTS, t=["it's", "be bold"])
    a, t = F.col("a"), F.col("t")
    pair = F.struct(F.lit("x").alias("src"), F.lit("y").alias("dst"))
    got = d.select(
        pr.trace_prompt(a, t), pr.trace_prompt(a, t, tail=False), pr.trace_prompt(a, t, as_set=True), pr.pair_prompt(a, pair),
        pr.pair_prompt(a, pair, tail=False), pr.next_activity_prompt(a, t), pr.next_activity_menu(a, t)).first()
    assert got[0] == "Set of process activities: ['be bold', \"it's\"]\nProcess: [\"it's\", 'be bold']\n: Valid: "
    assert got[1] == "Set of process activities: ['be bold', \"it's\"]\nProcess: [\"it's\", 'be bold']"
    assert got[2].startswith("Set of process activities: {'be bold', \"it's\"}\n")
    assert got[3] == "Set of activities: ['be bold', \"it's\"]\nOrdered activities: ['x', 'y']\n: Valid: "
    assert got[4] == "Set of activities: ['be bold', \"it's\"]\nOrdered activities: ['x', 'y']"
    assert got[5] == ("List of activites:\n0. [END]\nA. Be bold\nB. It's\nWhich one of the above activities should follow the "
                      "below sequence of activities?\nSequence of activities: [\"It's\", 'Be bold']\nAnswer: ")
    assert got[6] == "\n0. [END]\n1. Be bold\n2. It's\nSequence of activities: [\"It's\", 'Be bold']\n"


def test_menu_needs_letters(spark):
    d = _one(spark, a=[f"x{i}" for i in range(27)], t=["x1"])
    with pytest.raises(PySparkException):
        d.select(pr.next_activity_prompt(F.col("a"), F.col("t"))).collect()


def test_generation_prompts(spark):
    d = spark.createDataFrame([(ACTS, [("be bold", "it's"), ("it's", "be bold")], "-> ( 'a' ) \n")],
                              "unique_activities array<string>, dfg array<struct<src:string,dst:string>>, pt string")
    train, test = (pr.dfg_prompt(d, "</s>", train=t).first() for t in (True, False))
    assert train.prompt == pr.PAIRS_TASK + "\n1. Be bold\n2. It's\nPairs of activities:\n"
    assert train.target == "Be bold -> It's\nIt's -> Be bold</s>" and train.text == train.prompt + train.target
    assert (test.text, test.target) == (train.prompt, "Be bold -> It's\nIt's -> Be bold")
    tree, tree_eval = (pr.tree_prompt(d, "</s>", train=t).first() for t in (True, False))
    assert tree.target == tree_eval.target == "-> ( 'a' )</s>" and tree_eval.text == tree.prompt
    assert tree.prompt.endswith("Process Tree:\n")


def test_strip_prompt(spark):
    texts = ["p Process Tree:\nT Pairs of activities:\n", "q Pairs of activities:\nP", "nothing here at all to be found"]
    d = spark.createDataFrame([(t,) for t in texts], "g string")
    assert [r[0] for r in d.select(pr.strip_prompt(F.col("g"))).collect()] == ["T Pairs of activities:\n", "P", texts[2]]
    assert [r[0] for r in d.select(pr.strip_prompt(F.col("g"), compat=True)).collect()][2] == texts[2][20:]


def test_two_choice(spark):
    d = spark.range(1).select(pr.two_choice_prompt(*[F.lit(x) for x in "pqab"]), pr.two_choice_prompt(*[F.lit(x) for x in "pqab"], shift=False))
    text = 'Premise: "p"\nQuestion: "q"\nChoice 1: "a"\nChoice 2: "b"\nAnswer: '
    assert tuple(d.first()) == (text + "0", text)


def test_loss_mask(spark):
    d = spark.createDataFrame([([5, 6, 7, 8, 9], [5, 6]), ([1, 5, 6, 7, 8], [5, 6])], "ids array<int>, p array<int>")
    mask = lambda **k: [r[0] for r in d.select(lb.loss_mask("ids", "p", 1, **k)).collect()]
    assert mask() == [[-100, -100, 7, 8, 9], [-100, -100, -100, 7, 8]]
    assert mask(compat=True) == [[-100, -100, -100, 8, 9], [-100, -100, -100, 7, 8]]
    assert mask(mask_bos=False)[1] == [1, -100, -100, 7, 8]
    with pytest.raises(PySparkException):
        spark.createDataFrame([([1, 2], [9])], "ids array<int>, p array<int>").select(lb.loss_mask("ids", "p")).collect()


def test_label_tokens(spark):
    d = spark.createDataFrame([("trace", 1), ("activity", 0), ("activity", 26)], "task string, y int")
    got = {(r.task, r.y): r.token for r in lb.with_label_token(d, "y", lb.label_dimension(spark)).collect()}
    assert got == {("trace", 1): "True", ("activity", 0): "0", ("activity", 26): "Z"}
    last = spark.range(1).select(lb.last_token_label(F.lit(3), F.lit(1), {"1": 7, "2": 8}), lb.choice_label(F.lit("2"))).first()
    assert (last[0], last[1]) == ([-100, -100, 8], 1)


def test_neighbour_pairs_in_one_busy_hour(spark):
    """Most events of one case lie in one hour; they are cut by their number, and no pair is lost or made up."""
    rnd = random.Random(3)
    start = datetime(2024, 5, 1, 10)
    rows = [("m", "r", "hot" if rnd.random() < .9 else f"c{i % 7}", start + timedelta(milliseconds=rnd.randrange(3_000_000) if i % 20 else 10**7 * i), i,
             rnd.choice("abcdefgh")) for i in range(4000)]
    log = spark.createDataFrame(rows, "model_id string, revision_id string, case_id string, ts timestamp, event_id bigint, activity string")
    case = ["model_id", "revision_id", "case_id"]
    got = Counter((r.src, r.dst) for r in ev.follow_edges(log, case).collect())
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[3], r[4], r[5]))
    want = Counter((a[2], b[2]) for e in by.values() for a, b in zip(sorted(e), sorted(e)[1:]))
    assert got == want
    bounds = range_bounds(log, F.col("ts"))
    pieces = log.where("case_id = 'hot'").groupBy(range_number(F.col("ts"), bounds, "timestamp").alias("b")).count().collect()
    assert max(r["count"] for r in pieces) < 4000 * 0.6 and len(pieces) > 4
