"""Row-wise operators work unchanged on a stream."""

from pyspark.sql import functions as F

from procspark.operators import labels as lb, prompts as pr, qa_windows as qw


def _drain(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_prompts_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    src = spark.createDataFrame([(1, ["a", "b"], ["b", "a"], [0]), (2, ["c"], ["c"], [])],
                                "row_id bigint, unique_activities array<string>, trace array<string>, label array<int>")
    src.write.parquet(path)
    build = lambda d: d.select("row_id", lb.trace_is_valid().alias("y"), pr.trace_prompt(F.col("unique_activities"), F.col("trace")).alias("p"))
    _drain(build(spark.readStream.schema(src.schema).parquet(path)), "prompts")
    assert sorted(spark.table("prompts").collect()) == sorted(build(src).collect())


def test_windows_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    src = spark.createDataFrame([(str(i), "q", "w " * (20 * i)) for i in range(1, 6)], "id string, question string, context string")
    src.write.parquet(path)
    build = lambda d: qw.qa_features(d, max_length=24, stride=6).select("example_id", "window_no", "n_context")
    _drain(build(spark.readStream.schema(src.schema).parquet(path)), "windows")
    assert sorted(spark.table("windows").collect()) == sorted(build(src).collect())
