import hashlib

import pytest
from pyspark.errors import PySparkException

from procspark.llm.warc import read_archive, read_blobs, reconstruct, write_archive

BIG = "<p>é" + "x" * 120
ROWS = [(5, "http://a/1", BIG), (3, "http://a/2", BIG), (9, None, BIG), (1, "http://b\r\nX: y", "small"), (2, "u", "small"),
        (7, "v", None), (8, "w", ""), (3, "http://a/2", BIG), (None, "n", BIG), (4, "z", "y" * 300000)]


@pytest.fixture
def archive(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "k") for r in ROWS], "page_id long, url string, html string, digest string")
    write_archive(pages, str(tmp_path / "a"))
    return str(tmp_path / "a")


def test_records_come_back(spark, archive):
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload))
                 for r in read_archive(spark, archive).collect())
    want = []
    for p, _, h in ROWS:
        raw = (h or "").encode()
        other = len(raw) >= 100 and h == BIG and p != 3
        want.append((str(p), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if other else "response", 3 if other else None, raw))
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert {r.url for r in read_archive(spark, archive).collect()} >= {None, "http://b%0D%0AX: y"}


def test_exact_records_and_one_copy_of_each_payload(spark, archive):
    assert read_blobs(spark, archive).count() == len({h or "" for _, _, h in ROWS})
    for r in reconstruct(spark, archive).collect():
        record = bytes(r.record)
        head, rest = record.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        assert len(rest) - 4 == int(fields["Content-Length"])
        http, body = rest[:-4].split(b"\r\n\r\n", 1)
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
            assert int(http.rsplit(b": ", 1)[1]) == len(body)
        else:
            assert body == b"" and fields["WARC-Refers-To"] == "<urn:page:3>"


def test_damage_is_seen_and_empty_tables_work(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    write_archive(empty, str(tmp_path / "e"))
    assert read_archive(spark, str(tmp_path / "e")).count() == 0
    spark.createDataFrame([("00", bytearray(b"x"))], "digest string, payload binary").write.parquet(str(tmp_path / "d/blobs"))
    with pytest.raises(PySparkException, match="does not have the digest"):
        read_blobs(spark, str(tmp_path / "d")).collect()
