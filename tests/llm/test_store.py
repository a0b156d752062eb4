import pytest
from pyspark.sql import functions as F

from procspark.llm.crf import fit_field
from procspark.llm.mixing import mix_documents
from procspark.llm.store import labelled_rows, shared_folder


def test_an_id_of_very_many_rows_keeps_the_bound(spark):
    """One labelled id stands in 20,000 equal rows, another in 20,000 texts."""
    docs = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 1).otherwise(2).cast("long").alias("doc_id"),
                                      F.when(F.col("id") % 2 == 0, F.lit("same")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    docs = docs.union(spark.createDataFrame([(i, f"x{i}") for i in range(3, 30)] + [(None, "n"), (99, None)], "doc_id long, text string"))
    marks = spark.createDataFrame([(i, i % 2) for i in range(1, 100)], "doc_id long, y int")
    got = labelled_rows(docs, marks, 60)
    assert got.columns == ["doc_id", "text", "y"] and got.count() == 60 and got.where("doc_id = 1").count() <= 1
    assert got.select("doc_id", "text").distinct().count() == 60
    assert labelled_rows(docs, marks, 5).count() <= 5 and labelled_rows(docs, marks.limit(0), 5).count() == 0


def test_lines_of_all_texts_are_bounded(spark):
    docs = spark.createDataFrame([(i, "good line of words here\n" * 30 if i % 2 else "$$ ## 12\n" * 30) for i in range(80)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    assert fit_field(docs, labels, max_total=400).unary.any()
    assert not fit_field(docs, labels, max_total=31).unary.any()  # one text: no labels of both kinds


def test_own_columns_stay_beside_the_rates(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} text", "mine", 7) for i in range(20)], "doc_id long, text string, p string, rate int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = mix_documents(docs, labels)
    assert got.columns[:2] == ["doc_id", "p"] and {r.p for r in got.collect()} == {"mine"} and dict(got.dtypes)["rate"] == "double"


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_folder(Session())
