import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from procspark.llm import manifest as mf

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def rise(nodes):
    """(root, siblings of each node from the bottom up) of one list."""
    path, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i - i % 3
            path[k].append((level[run:i], level[i + 1:run + 3]))
            at[k] = i // 3
        level = [sha(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], path


def plain(rows):
    leaf = lambda r, t: sha(*map(enc, r[:4]), enc(t))
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r, leaf(r, r[4])))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    low = {s: rise([h for _, h in trees[s]]) for s in names}
    root, top = rise([low[s][0] for s in names])
    out = []
    for n, s in enumerate(names):
        for (r, h), path in zip(trees[s], low[s][1]):
            path = path + top[n]
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            fold = leaf(r, r[4].replace("\n", "")) if bad else h
            for a, b in path:
                fold = sha(*a, fold, *b)
            out.append((r[0], h, low[s][0], root, sha(*[x for a, b in path for x in a + b]), fold, fold == root))
    return sorted(out, key=repr)


def some(n, sources, seed=2):
    r = random.Random(seed)
    return [(r.randrange(-50, 10**6), r.choice(sources), r.choice(["en", None, ""]), r.choice([None, 7]),
             r.choice([None, "", "a\nb", "é|日\n\n", "x:1", "plain"])) for _ in range(n)]


@pytest.mark.parametrize("rows", [
    some(300, ["a", None, "", "é", "-"]), some(1, ["a"]), some(4, ["a"]), some(9, list("abcdefghij")), some(600, ["hot"]),
    [(5, "s", "en", 1, "t\n")] * 30 + some(20, ["s"]), [(None, None, None, None, None)] * 2, some(200, [f"s{i}" for i in range(120)])],
    ids=["mixed", "one", "four", "sources", "blocks", "copies", "nulls", "many sources"])
def test_against_plain_hashes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"leaf": F.lit("x"), "pos": F.lit(1), "tree": F.lit("t")}).repartition(3)
    got = mf.merkle_manifest(df, mf.without_newlines())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_rounds(spark, monkeypatch):
    """Small blocks make the same tree in more rounds; a long text and no tampering."""
    rows = some(150, ["a", "b", "b", "b"]) + [(1, "a", "en", 1, "wörd " * 200_000)]
    monkeypatch.setattr(mf, "LEVELS", 1)
    got = mf.merkle_manifest(spark.createDataFrame(rows, SCHEMA), mf.without_newlines()).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)
    monkeypatch.setattr(mf, "LEVELS", 5)
    assert all(r.verified for r in mf.merkle_manifest(spark.createDataFrame(rows[:40], SCHEMA)).collect())


def test_empty(spark):
    assert mf.merkle_manifest(spark.createDataFrame([], SCHEMA), mf.without_newlines()).count() == 0
