"""A content-addressed WARC archive.

``blobs`` has every payload once, under its SHA-256; ``heads`` has the exact header bytes of every
record and the digest they belong to. Records come back by a join on the digest, after each stored
payload has been hashed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Payloads below this many bytes are never revisits.
LEAST_SHARED = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends inside a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def record_heads(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, digest, bytes, record_type, head): everything of a record but its payload.

    pages has (page_id, url, digest, bytes). Among equal payloads of at least ``LEAST_SHARED`` bytes the rows
    with the smallest page_id are responses and the others revisit it.
    """
    first = (pages.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first")))
    rows = pages.join(first, "digest", "left")
    revisit = (F.col("bytes") >= LEAST_SHARED) & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    kind = F.when(revisit, "revisit").otherwise("response")
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _line("WARC-Type", kind), _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Date", F.lit(date)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first")))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block.cast("string")), F.lit("\r\n"), http)
    return rows.select("page_id", "digest", "bytes", kind.alias("record_type"), F.encode(head, "UTF-8").alias("head"))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                  date: str = DATE) -> None:
    """Write ``path/heads`` and ``path/blobs``. Null payloads are empty; null urls give no target line; other
    columns are not kept. Copies of a payload are folded before the shuffle, so a payload that very many pages
    share costs one row per task. Repeated rows give repeated records; an empty table an empty archive.
    """
    payload = F.encode(F.coalesce(html, F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    record_heads(rows.drop("payload"), date).write.parquet(f"{path}/heads")
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{path}/blobs")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload, payload_digest, payload_bytes); fails on a payload that does not have its digest."""
    blobs = spark.read.schema("digest string, payload binary").parquet(f"{path}/blobs")
    actual = F.sha2("payload", 256)
    checked = F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(
        F.concat(F.lit("payload does not have the digest "), "digest")).cast("string"))
    return blobs.select("digest", "payload", checked.alias("payload_digest"),
                        F.octet_length("payload").cast("long").alias("payload_bytes"))


def head_field(name: str) -> Column:
    """A field of the record's own header lines; empty if missing."""
    return F.regexp_extract(F.decode("head", "UTF-8"), rf"(?:^|\r\n){name}: ([^\r]*)\r\n", 1)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, head, payload, payload_digest, payload_bytes) of every record.

    All but the payload is read from the header bytes. Columns that are not used are not moved: without
    ``payload`` only digests and lengths of the payloads, hashed where they are stored, are joined.
    """
    heads = spark.read.schema("page_id long, digest string, bytes long, record_type string, head binary").parquet(
        f"{path}/heads").select("head", F.regexp_extract(head_field("WARC-Payload-Digest"), "sha256:(.*)", 1).alias("digest"))
    rows = heads.join(read_blobs(spark, path), "digest")
    page = lambda name: F.regexp_extract(head_field(name), "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    uri = head_field("WARC-Target-URI")
    return rows.select(page("WARC-Record-ID").alias("page_id"), F.when(uri != "", uri).alias("url"),
                       head_field("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"),
                       "head", "payload", "payload_digest", "payload_bytes")


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record): the full bytes of every record, headers, payload of responses, and the closing blank lines."""
    rows = read_archive(spark, path)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", F.concat("head", body, F.lit(b"\r\n\r\n")).alias("record"))
