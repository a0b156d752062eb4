import random

import pytest

from procspark.llm.winnow import decontaminate, digest, word_list


def brute(docs, items, window=10):
    out = {}
    for d, text in docs:
        w, hit, ids = word_list(text), set(), set()
        for i, t in items:
            x = word_list(t)
            n = min(window, len(x))
            if i is None or not n:
                continue
            grams = {tuple(x[a:a + n]) for a in range(len(x) - n + 1)}
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in grams:
                    hit |= set(range(a, a + n))
                    ids.add(str(i))
        out[d] = (len(w), len(hit), len(ids), digest(ids), bool(hit))
    return out


@pytest.fixture(scope="module")
def case():
    r = random.Random(5)
    vocab = ["a", "bb", "Été", "x1", "the", "zz"]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 4, 6, 9, 10, 11, 25])))) for i in range(12)]
    items += [(12, None), (None, "a bb a bb a bb a bb a bb a bb"), items[3], (3, "un deux trois quatre cinq six")]
    docs = []
    for d in range(60):
        parts = [" ".join(r.choice(vocab) for _ in range(r.randrange(30)))]
        for _ in range(r.randrange(3)):
            x = (items[r.randrange(len(items))][1] or "").split()
            a = r.randrange(len(x) + 1)
            parts += [", ".join(x[a:a + r.randrange(30)]).upper(), r.choice(vocab)]
        docs.append((d, "--".join(parts)))
    docs += [(60, None), (61, ""), (62, "?!"), (63, "the " * 5000)]
    return docs, items


@pytest.mark.parametrize("limit", [10**9, 0])
def test_both_ways_equal_brute_force(spark, case, limit):
    docs, items = case
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_hit int")
    got = decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), index_bytes=limit)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
            for r in got.collect()} == brute(docs, items)


@pytest.mark.parametrize("limit", [10**9, 0])
def test_repeated_ids_nulls_and_empty_tables(spark, limit):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item), (1, "other"), (None, item), (None, None), (1, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_hit) for r in decontaminate(df, bench, index_bytes=limit).collect())
    assert got == [("1", 0), ("1", 10), ("1", 10), ("None", 0), ("None", 10)]
    assert decontaminate(df.limit(0), bench, index_bytes=limit).count() == 0
    assert not decontaminate(df, bench.limit(0), index_bytes=limit).where("contaminated").count()
