import re

import corpus_pipeline as cp
import pytest
from tests.llm.test_parity import brute as copies
from tests.llm.test_winnow import brute as leaks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in cp.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_stages_keep_the_columns(kept):
    assert all(set(b.columns) == set(a.columns) and b.count() <= a.count() for a, b in kept[:-1])


def test_quality_keeps_good_and_drops_poor_documents(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a, b = kept[0]
    left = {r.doc_id for r in b.collect()}
    marks = [(r.doc_id in left, r.quality) for r in a.join(labels, "doc_id").collect()]
    assert sum(k == bool(q) for k, q in marks) >= .95 * len(marks)


def test_one_document_of_each_group_stays(kept):
    a, b = ([(r.doc_id, r.text) for r in x.collect()] for x in kept[1])
    want = {c for _, n, c in copies(a) if n} | {d for d, n, _ in copies(a) if not n}
    assert {d for d, _ in b} == want


def test_contaminated_documents_go(spark, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    a, b = ([(r.doc_id, r.text) for r in x.collect()] for x in kept[2])
    found = leaks(a, items)
    assert {d for d, _ in b} == {d for d in found if not found[d][4]}


def test_secrets_are_gone_and_other_texts_unchanged(kept):
    a, b = ({r.doc_id: r for r in x.collect()} for x in kept[3])
    assert set(a) == set(b)
    secret = re.compile(r"token = \"?[0-9a-f]{20}")
    assert not any(secret.search(r.text) for r in b.values())
    assert all(b[d].text == a[d].text or "[secret]" in b[d].text for d in a)
    assert all(r.n_chars == len(r.text) for r in b.values())


def test_last_stage_and_run_agree(spark, kept):
    a, b = kept[4]
    assert b.count() == a.count() and b.where("rate < 0 or rate is null").count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rate = {r.toxic: r[1] for r in b.join(labels, "doc_id").groupBy("toxic").avg("rate").collect()}
    assert rate[0] > 0.4 and rate[1] < rate[0] / 2
    got = {r.doc_id: r.rate for r in cp.run(spark, SF).collect()}
    want = {r.doc_id: r.rate for r in b.collect()}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-6 for d in got)
