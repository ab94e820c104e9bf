"""A content-addressed WARC archive as two tables.

``payloads`` stores the bytes of each distinct payload once, under their SHA-256. ``headers`` stores each
record's exact header block. A record is rebuilt by joining the two on the digest; a payload whose bytes do
not have the digest it is stored under fails the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, released, written

#: Equal payloads of at least so many bytes become revisits of the first one.
REVISIT_BYTES = 100


def write(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record per row of ``pages`` under ``path``.

    The payload is the column in UTF-8 (bytes as they are; null: empty). Of records with equal payloads of at
    least 100 bytes the one with the least id is the response and the others are revisits of it; rows that
    repeat that id are responses too, and so is every row if all ids are null. Line breaks in a URL are
    percent-encoded, so that a header keeps its form. Payloads of any length are stored whole. Other columns are
    not stored, whatever their names. An empty table makes an empty archive.
    """
    content = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    raw = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), content.alias("payload"))
    raw = raw.withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("")))
    keys = written(raw.select("id", "key", "url", "digest", F.octet_length("payload").cast("long").alias("size")), "warc-keys")
    first = keys.groupBy("digest").agg(F.min("id").alias("first"))
    marked = keys.join(first, "digest")
    revisit = (F.col("size") >= REVISIT_BYTES) & (F.col("id").isNull() | (F.col("id") > F.col("first"))) & F.col("first").isNotNull()
    address = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.format_string("WARC-Record-ID: <urn:page:%s>", "key"),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "digest"),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.format_string("WARC-Refers-To: <urn:page:%s>", F.col("first").cast("string"))),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("size").cast("string"))),
    ]
    marked.select("digest", F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")).alias("header")).write.parquet(f"{path}/headers")
    owners = first.select("digest", F.coalesce(F.col("first").cast("string"), F.lit("")).alias("key"))
    # joined and deduplicated on the same keys: the payloads move once, dealt by digest and id, so evenly
    stored = raw.select("digest", "key", "payload").join(owners, ["digest", "key"]).dropDuplicates(["digest", "key"])
    stored.select("digest", "payload").write.parquet(f"{path}/payloads")


def read(spark, path: str, rebuild: bool = False) -> DataFrame:
    """Every record of the archive: id, url, record_type, refers_to, payload_digest and payload_bytes (both
    taken from the stored payload after it was checked against the digest it is stored under), header; with
    ``rebuild`` also ``payload`` and ``record``, the bytes of the whole WARC record."""
    payloads = spark.read.parquet(f"{path}/payloads")
    actual = F.sha2("payload", 256)
    checked = F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest")))
    payloads = payloads.select("digest", checked.alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), *["payload"] * rebuild)
    headers = spark.read.parquet(f"{path}/headers")
    field = lambda name, form: F.regexp_extract("header", f"\r\n{name}: {form}\r\n", 1)
    parsed = headers.select(
        field("WARC-Record-ID", "<urn:page:([^>]*)>").try_cast("long").alias("id"),
        field("WARC-Target-URI", "([^\r]*)").alias("url"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:([^>]*)>").try_cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("digest"),
        "header",
    )
    out = parsed.join(payloads, "digest").drop("digest")
    if rebuild:
        body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
        out = out.withColumn("record", F.concat(F.col("header").cast("binary"), body, F.lit("\r\n\r\n").cast("binary")))
    return out


def op2_content_archive(spark, sf_dir: str) -> DataFrame:
    """``pages`` written as an archive; every record is rebuilt, and what is returned is taken from its bytes (of a
    revisit: from the payload that it refers to)."""
    path = fresh_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    released(spark)
    body = F.expr("CASE WHEN record_type = 'response' THEN substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4) ELSE payload END")
    out = read(spark, path, rebuild=True).withColumn("body", body)
    return out.select(F.col("id").alias("page_id"), F.octet_length("body").cast("long").alias("payload_bytes"), F.sha2("body", 256).alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha256(body) AS payload_digest,
             min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM q
"""
