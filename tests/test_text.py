import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from procspark.functions import text as tx

STRINGS = ["it's", "a", "b x", 'say "hi"', "both ' and \"", "tab\tnl\n back\\slash\r", "nb\xa0sp", "é", "ßtraße",
           "HELLO World", "", "\x07bell", "\U0001f600x", "  pad \x1c", "​zero", " sep", "'", '"', "\\"]


def test_python_text_rules(spark):
    df = spark.createDataFrame([(s,) for s in STRINGS], "s string")
    c = F.col("s")
    got = df.select("s", tx.py_repr(c).alias("r"), tx.capitalize(c).alias("c"), tx.strip(c).alias("st"),
                    tx.lstrip(c).alias("l"), tx.rstrip(c).alias("rs"), tx.is_blank(c).alias("b")).collect()
    for r in got:
        assert (r.r, r.c, r.st, r.l, r.rs, r.b) == (
            repr(r.s), r.s.capitalize(), r.s.strip(), r.s.lstrip(), r.s.rstrip(), not r.s.strip())


def test_list_repr(spark):
    rows = [STRINGS, [], ["x"]]
    df = spark.createDataFrame([(x,) for x in rows], "a array<string>")
    assert [r[0] for r in df.select(tx.py_list_repr(F.col("a"))).collect()] == [str(x) for x in rows]


def test_parse_set(spark):
    sets = [set(STRINGS), set(), {"one"}, {"b x", "it's", "a"}]
    df = spark.createDataFrame([(str(s),) for s in sets], "t string")
    assert [r[0] for r in df.select(tx.parse_set(F.col("t"))).collect()] == [sorted(s) for s in sets]


@pytest.mark.parametrize("bad", ["[1]", "{}", "{1, 'a'}", "__import__('os')", "{'a'} | {'b'}", "['a']"])
def test_parse_set_rejects(spark, bad):
    df = spark.createDataFrame([(bad,)], "t string")
    assert df.select(tx.parse_set(F.col("t"))).first()[0] is None
    with pytest.raises(PySparkException):
        df.select(tx.parse_set(F.col("t"), strict=True)).collect()


def test_parse_pairs(spark):
    rows = [[("a", "b x"), ("b x", "it's")], [], [("q\xa0", "\n")]]
    df = spark.createDataFrame([(str(r),) for r in rows] + [("{}",), ("[('a',)]",)], "t string")
    got = [r[0] for r in df.select(tx.parse_pairs(F.col("t"))).collect()]
    assert [[tuple(p) for p in g] for g in got[:3]] == rows and got[3:] == [None, None]
