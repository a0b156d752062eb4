import random
import zlib

import pytest
from pyspark.sql import functions as F

from procspark.llm.shards import quantiles, shard_documents, splitters, write_shards

RESULT = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def plain(rows, shards=8):
    """(id, size, crc, shard, slot) by one pass over the sorted rows."""
    data = [(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows]
    data.sort(key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, *r[1:]))
    total, before, out, slots = sum(r[1] for r in data), 0, [], {}
    for r in data:
        s = min(shards - 1, (2 * before + r[1]) * shards // (2 * total))
        before += r[1]
        slots[s] = slots.get(s, -1) + 1
        out.append((*r, s, slots[s]))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in df.collect()), key=repr)


def some(n, seed=1):
    r = random.Random(seed)
    return [(i * 7 - 900, "é" * r.choice([0, 3, 9, 40, 900])) for i in range(n)]


@pytest.mark.parametrize("rows", [
    some(700), some(5), [(3, "x" * 200_000), *some(300)], [(7, "same")] * 400 + some(100), [(7, f"t{i}") for i in range(500)],
    [(None, None), (None, "a"), (2, None), (2, ""), (2, "b\0c")]], ids=["plain", "few", "giant", "copies", "one id", "nulls"])
def test_against_one_pass(spark, rows):
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == RESULT
    assert rows_of(got) == sorted(plain(rows), key=repr)
    each = got.groupBy("shard").agg(F.sum("size").alias("b")).collect()
    total, top = sum(r.b for r in each), max(len((t or "").encode()) + 1 for _, t in rows)
    assert all(abs(r.b - total / 8) <= top for r in each) and {r.law for r in got.collect()} == {"bytes"}


def test_empty_and_other_ids(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    words = [(f"k{i:03d}", "x" * i) for i in range(60)] + [(None, "q")]
    got = rows_of(shard_documents(spark.createDataFrame(words, "doc_id string, text string"), 3))
    assert sorted(r[1:] for r in got) == sorted(r[1:] for r in plain([(k and int(k[1:]), t) for k, t in words], 3))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, "x" * i, 5, "k", i, "z") for i in range(30)], "doc_id long, text string, shard int, _key string, _range long, kept string")
    got = shard_documents(df, keep=["text", "shard", "_key", "_range", "kept"])
    assert got.columns == [*RESULT, "text", "_key", "_range", "kept"]
    assert all(r.text == "x" * r.doc_id and r["_range"] == r.doc_id for r in got.collect())


def test_overfull_ranges_are_cut(spark):
    """Keys of which nine in ten lie between two neighbouring splitters of a thin sample."""
    rows = spark.range(4000).select(F.format_string("%06d", F.when(F.col("id") % 10 > 0, F.col("id") + 100_000).otherwise(F.col("id"))).alias("_key"),
                                    F.lit(10).cast("long").alias("size"))
    bounds, before = splitters(rows, 40_000, 50)
    from procspark.functions.ranking import range_number
    each = [r.s for r in rows.groupBy(range_number(F.col("_key"), bounds, "string").alias("r")).agg(F.sum("size").alias("s")).collect()]
    assert max(each) <= 2 * 800 + 10 and before[-1] == (40_000, 4000)
    assert quantiles([], 5) == [] and quantiles([("a", 1.0)], 3) == ["a"]


def test_files(spark, tmp_path):
    rows = some(200)
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, slot string")
    write_shards(df, str(tmp_path / "s"), 4, rows_a_file=30)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted(rows)
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b")).collect()
    assert all(r.n <= 30 and r.b - r.a == r.n - 1 for r in files)
