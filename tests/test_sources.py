import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from procspark.functions.text import parse_pairs, parse_set
from procspark.operators import metrics as mt
from procspark.sources import catalogue as cat, qa_json as qj, sinks, tables


def test_models_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('model_id,revision_id,unique_activities,dfg,pt\n'
                 'm,1,"{\'a\', ""it\'s""}","[(\'a\', ""it\'s"")]","-> ( \'a\',\n ""it\'s"" )"\n')
    r = tables.read_models(spark, str(p)).select("model_id", parse_set(F.col("unique_activities")).alias("a"),
                                                 parse_pairs(F.col("dfg")).alias("d"), "pt").first()
    assert (r.model_id, r.a, [tuple(x) for x in r.d], r.pt) == ("m", ["a", "it's"], [("a", "it's")], "-> ( 'a',\n \"it's\" )")


def test_table_schema_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "m", "r", "{'a'}", ["a"], [0])], tables.schema("traces")).write.parquet(path)
    plan = tables.read_table(spark, "traces", path).filter("model_id = 'm'").select("row_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<row_id:bigint,model_id:string>" in plan and "EqualTo(model_id,m)" in plan


@pytest.fixture()
def qa_file(tmp_path):
    ctx = "Das schöne 日本 und Wein"
    qa = lambda i, q, text, at: {"id": i, "question": q, "answers": [{"text": text, "answer_start": at}]}
    data = {"data": [{"paragraphs": [{"context": ctx, "qas": [qa("english-1", "q1", "日本", 11), qa("finnish-1", "q2", "Wein", 18)]},
                                     {"context": "b", "qas": [qa("english-2-x", "q3", "b", 0)]}]},
                     {"paragraphs": [{"context": "c d", "qas": [qa("english-3", "q4", "d", 2)]}]}]}
    p = tmp_path / "dev.json"
    p.write_text(json.dumps(data, ensure_ascii=False), encoding="utf-8")
    return str(p)


def test_nested_json(spark, qa_file):
    df = qj.load_qa(spark, {"dev": qa_file}, "dev", "en")
    assert [(r.id, r.question, r.answers.text[0]) for r in df.collect()] == [
        ("english-1", "q1", "日本"), ("english-2-x", "q3", "b"), ("english-3", "q4", "d")]
    every = qj.read_nested(spark, qa_file)
    assert [(r.article_no, r.paragraph_no, r.qa_no) for r in every.collect()] == [(0, 0, 0), (0, 0, 1), (0, 1, 0), (1, 0, 0)]
    assert {r.lang for r in qj.language_of(every).collect()} == {"en", "fi"}
    assert qj.load_qa(spark, {"dev": qa_file}, "dev", None).count() == 4


@pytest.mark.parametrize("size", ["400", "128m"])
def test_one_large_file_is_many_tasks(spark, tmp_path, size):
    """Splits of a few hundred bytes cut articles, strings and the key itself; numbers and texts stay those of one parse."""
    qa = lambda k: {"id": f"english-{k}", "question": f'is "paragraphs" a key? {k}', "answers": [{"text": "日本", "answer_start": 2}]}
    data = {"version": "1", "data": [{"title": f't "paragraphs": {a}', "paragraphs": [
        {"context": f"x {'日本 é ' * (a % 7)}{p}", "qas": [qa(f"{a}-{p}-{q}") for q in range(a % 3)]} for p in range(a % 4)], "more": {"a": [1]}} for a in range(60)]}
    for n in range(2):
        (tmp_path / f"f{n}.json").write_text(json.dumps(data, ensure_ascii=False, indent=n or None), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = qj.read_nested(spark, str(tmp_path))
        got = sorted((r.file[-7:], r.article_no, r.paragraph_no, r.qa_no, r.id, r.context, r.question, r.answers.text[0]) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted((f"f{n}.json", a, p, q, x["id"], par["context"], x["question"], "日本") for n in range(2) for a, art in enumerate(data["data"])
                  for p, par in enumerate(art["paragraphs"]) for q, x in enumerate(par["qas"]))
    assert got == want
    (tmp_path / "bad.json").write_text('{"data": [{"paragraphs": 5}]}')
    with pytest.raises(PySparkException):
        qj.read_nested(spark, str(tmp_path / "bad.json")).collect()


def test_flatten_works_its_data_out_once(spark):
    """The data of a row is made once, also if Python makes it; rows without articles have no questions."""
    from procspark.functions.tokens import offsets, words
    raw = spark.createDataFrame([("f", "one two"), ("g", "")], "file string, t string").withColumn("n", F.size(offsets(words(F.col("t")))))
    qa_row = F.struct(F.concat(F.lit("q"), F.col("n").cast("string")).alias("id"), F.col("t").alias("question"),
                      F.array(F.struct(F.col("t").alias("text"), F.lit(0).alias("answer_start"))).alias("answers"))
    articles = F.array(F.struct(F.array(F.struct(F.col("t").alias("context"), F.array(qa_row).alias("qas"))).alias("paragraphs")))
    d = qj.flatten(raw.select("file", F.when(F.col("n") > 0, articles).alias("data")))
    assert d._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [(r.file, r.article_no, r.id) for r in d.collect()] == [("f", 0, "q2")]


def test_answer_check(spark, qa_file, tmp_path):
    p = tmp_path / "bad.json"
    p.write_text(open(qa_file, encoding="utf-8").read().replace('"answer_start": 18', '"answer_start": 17'), encoding="utf-8")
    assert [r.id for r in qj.rejects(qj.read_nested(spark, str(p))).collect()] == ["finnish-1"]
    assert qj.load_qa(spark, {"dev": str(p)}, "dev", "fi", strict=False).count() == 0
    with pytest.raises(PySparkException):
        qj.load_qa(spark, {"dev": str(p)}, "dev", "fi").collect()


def test_catalogue(spark):
    entries = cat.evaluation_entries()
    names = [e.dataset_name for e in entries]
    assert len(names) == len(set(names)) == 313
    sizes = {f: len(cat.evaluation_entries([f])) for f in [*cat.FAMILIES, "tydiqa", "copa"]}
    assert sizes == {"xnli": 30, "amnli": 20, "indicxnli": 22, "pawsx": 14, "wikiann": 52, "masakhaner": 20, "masakhaner2": 38,
                     "udpos": 62, "mlqa": 14, "xcopa": 22, "tydiqa": 17, "copa": 2}
    by = {e.dataset_name: e for e in entries}
    assert by["validation_tydiqa_ar"].split == "train" and by["test_tydiqa_en"].split == "dev"
    assert by["test_mlqa_de"].name == "mlqa.de.de" and "validation_udpos_Thai" not in by
    assert cat.train_entry("udpos").name == "udpos.English" and cat.train_entry("pawsx", "de").name == "de"
    assert cat.train_entry("copa").path == "super_glue"
    assert cat.catalogue(spark).filter("role = 'test'").count() == sum(e.role == "test" for e in entries)


def test_read_entries(spark, tmp_path):
    root = str(tmp_path)
    picked = [e for e in cat.evaluation_entries(["masakhaner", "wikiann"]) if e.dataset_name in ("test_masakhaner_hau", "test_wikiann_de")]
    for e in picked:
        spark.createDataFrame([(["x", "y"], [8, 3])], "tokens array<string>, ner_tags array<int>").write.parquet(cat.location(root, e))
    got = {(r.dataset_name, r.lang, r.split): r.ner_tags for r in cat.read_entries(spark, root, picked).collect()}
    assert got == {("test_masakhaner_hau", "hau", "test"): [0, 3], ("test_wikiann_de", "de", "test"): [8, 3]}
    (tmp_path / "copa").mkdir()
    (tmp_path / "copa" / "en_test.csv").write_text("premise,label\n\"a, b\",1\n")
    e = next(x for x in cat.evaluation_entries(["copa"]) if x.data_files)
    assert cat.read_entry(spark, root, e).first().premise == "a, b"
    assert "text" in cat.to_logical(cat.read_entry(spark, root, e), {"text": "premise"}).columns


def test_one_scan_for_many_entries(spark, tmp_path):
    """The plan has one scan a source path, a place that two entries name goes to both, names that end alike stay apart."""
    root = str(tmp_path)
    entries = cat.evaluation_entries(["wikiann", "xnli"])
    for i, place in enumerate(sorted({cat.location(root, e) for e in entries})):
        spark.createDataFrame([(i, place)], "n int, at string").coalesce(1).write.parquet(place)
    twice = [*entries, cat.Entry("again", "train", "nli", "xnli", "en", "test", "en"), cat.Entry("none", "train", "nli", "xnli", "e", "n", None)]
    spark.createDataFrame([(-1, cat.location(root, twice[-1]))], "n int, at string").write.parquet(cat.location(root, twice[-1]))
    df = cat.read_entries(spark, f"file://{root}", twice)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Union") == 1
    got = {(r.dataset_name, r.split, r.lang): r["at"] for r in df.collect()}
    assert got == {(e.dataset_name, e.role, e.lang): cat.location(root, e) for e in twice}


def test_writing_twice_leaves_one_copy(spark, tmp_path):
    d = spark.createDataFrame([(4, "x", "test", 1, 0), (7, "y", "test", 1, 1)], "row_id bigint, dataset_name string, split string, preds int, labels int")
    p, g, m = (str(tmp_path / x) for x in "pgm")
    metrics = mt.evaluate(d, ["acc"])
    for _ in range(2):
        for epoch in (0, 1):
            sinks.store_predictions(d, p, epoch=epoch)
            sinks.store_generations(d.selectExpr("row_id", "dataset_name", "'l' label_strings", "'p' preds"), g, epoch=epoch)
            for run in ("r1", "r2"):
                sinks.log_metrics(metrics, m, run, epoch)
    assert spark.read.csv(p, header=True).count() == 4 and spark.read.parquet(g).count() == 4 and spark.read.parquet(m).count() == 8
    sinks.store_predictions(d.where("dataset_name = 'x'"), p, epoch=1)
    assert spark.read.csv(p, header=True).count() == 4


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(4, "x", "test", 1, 0), (7, "y", "test", 1, 1)], "row_id bigint, dataset_name string, split string, preds int, labels int")
    p = str(tmp_path / "p")
    sinks.store_predictions(d, p, epoch=2)
    back = spark.read.option("header", True).csv(p)
    assert sorted((r.ids, r.prediction, r.labels, r.dataset, r.epoch) for r in back.collect()) == [("4", "1", "0", "x", 2), ("7", "1", "1", "y", 2)]
    g = str(tmp_path / "g")
    sinks.store_generations(d.selectExpr("row_id", "dataset_name", "'l\n' label_strings", "'p' preds"), g)
    assert {(r.row_id, r.labels, r.preds, r.dataset) for r in spark.read.parquet(g).collect()} == {(4, "l\n", "p", "x"), (7, "l\n", "p", "y")}
    n = str(tmp_path / "n")
    preds = "array(named_struct('text', 'a', 'score', 1d, 'start_logit', 1d, 'end_logit', 0d, 'probability', 1d)) predictions"
    sinks.store_nbest(d.selectExpr("dataset_name example_id", preds), n)
    assert spark.read.json(n).filter("nbest[0].text = 'a'").count() == 2
    m = str(tmp_path / "m")
    for run in ("r1", "r2"):
        sinks.log_metrics(mt.evaluate(d, ["acc"]), m, run)
    assert {(r.run, r.dataset, r.metric, r.value) for r in spark.read.parquet(m).collect()} == {
        (r, n, "acc", v) for r in ("r1", "r2") for n, v in (("x", 0.0), ("y", 1.0))}
