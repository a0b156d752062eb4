import random

import numpy as np
import pytest

from procspark.llm.bytescan import stream
from procspark.llm.graph import components
from procspark.llm.parity import band_keys, jaccard_components, most_differing, one_of_each, sketch


def brute(docs, threshold=75):
    sets = []
    for d, t in docs:
        w = (t or "").lower().split()
        sets.append((d, {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(30))
    line = " ".join(word() for _ in range(9))
    docs = []
    for d in range(n):
        if docs and r.random() < .6:
            w = (r.choice(docs)[1] or "").split()
            for _ in range(r.randrange(1 + len(w) // 12)):
                w[r.randrange(len(w))] = word()
            w = w[: len(w) - r.randrange(3)]
        else:
            w = [word() for _ in range(r.choice([0, 1, 3, 5, 7, 9, 12, 30, 60, 200]))]
            if r.random() < .4:
                w += line.split()
        docs.append((d, r.choice([" ", "\t", "\n "]).join(w)))
    return docs + [(n, None), (n + 1, "  \n"), (n + 2, docs[3][1].upper())]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, node string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == brute(docs)


def test_linking_sets_share_a_key_and_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    with np.errstate(over="ignore"):
        pool = np.sort(stream(11, 4000))
        for _ in range(1500):
            n = int(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 33, 64, 65, 120, 300]))
            a = set(rng.choice(pool, n, replace=False).tolist())
            b = set(a)
            for _ in range(int(rng.integers(0, n // 3 + 2))):
                if rng.random() < .5 and len(b) > 1:
                    b.discard(next(iter(b)))
                else:
                    b.add(int(rng.choice(pool)))
            sa, sb = (np.sort(np.array(list(x), np.uint64)) for x in (a, b))
            far = int(np.bitwise_count((sketch(sa) ^ sketch(sb)).view(np.uint64)).sum())
            assert far <= len(a ^ b)
            if 100 * len(a & b) >= 75 * len(a | b):
                assert len(a ^ b) <= most_differing(len(a), len(b), 75)
                for frequent in (None, pool[:1500]):  # which shingles are frequent never loses a link
                    ka, kb = ({int(x) for k in band_keys(s, 75, frequent) for x in k} for s in (sa, sb))
                    assert ka & kb


def test_repeated_rows_null_ids_and_one_of_each(spark):
    text = "one two three four five six seven eight"
    rows = [(5, text), (5, text), (None, text), (3, text + " nine"), (7, ""), (8, None), (None, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_components(df).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in got))) == sorted(map(str, [
        (5, 3), (5, 3), (None, 3), (3, 3), (7, 7), (8, 8), (None, None)]))
    kept = sorted(str(r.doc_id) for r in one_of_each(df).collect())
    assert kept == ["3", "7", "8", "None"]
    assert jaccard_components(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
