"""WARC archives with revisit records: write them with Spark, read them back, resolve revisits.

Headers (page id, payload digest, size) are grouped by digest; where several records share a
payload, one stays a response and the others become revisits that name it. Payloads are not
shuffled: digests that repeat are written as a table first, so its size is known when the
pages are joined with it, and a digest with very many records is split by the skew settings
of ``mirador.session``.

Archives are text files whose row separator is the blank line that ends a WARC record, so
each file is a sequence of plain WARC/1.0 records; payload bytes are written as they are.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mirador.sources.tables import stage
from mirador.sources.workspace import scratch

from .registry import query, table

RECORD_END = "\r\n\r\n"
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ID = "urn:page:"
PARSED = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, "
    "payload_bytes bigint, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 20 bits (5 hex digits) make 4 letters."""
    hexed = F.sha1(payload)
    return F.concat(
        *[
            F.translate(F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0"), DIGITS, LETTERS)
            for i in range(8)
        ]
    )


def lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(
        *[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in pairs]
    )


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(payload_digest, response_id): payloads of several records and the record that keeps them."""
    return (
        pages.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("records"))
        .filter("records > 1 AND response_id IS NOT NULL")
        .select("payload_digest", "response_id")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    archive_bytes: int = 64 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write one record per row of ``pages`` (page_id, url, payload binary).

    Of the records with equal payloads of at least ``min_bytes`` bytes, the one with the
    largest page_id is the response and the others revisit it; rows that repeat its page_id
    are responses too. A null payload is empty. Null page ids revisit like others and are the
    response only among themselves, then all of them. A null url leaves its header out; line
    breaks in a url are percent-encoded. Other columns are not looked at. An empty table
    writes no record. ``archive_bytes`` is the size an archive should have on average: where
    the scan's partitions are larger, rows are dealt out anew.
    """
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": base32_sha1(F.col("payload"))}
    )
    repeated = stage(resolve(rows, min_bytes), "warc-revisits").withColumnRenamed("payload_digest", "of_digest")
    total = pages.agg(F.sum(F.octet_length("payload").cast("bigint"))).first()[0] or 0
    archives = max(1, math.ceil(total / archive_bytes))
    if pages.rdd.getNumPartitions() < archives:
        rows = rows.repartition(archives)
    joined = rows.join(
        repeated, (F.col("payload_digest") == F.col("of_digest")) & (F.col("payload_bytes") >= min_bytes), "left"
    )
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"),
        lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("payload_bytes"))),
        F.lit("\r\n"),
    )
    block = F.concat(F.encode(http, "UTF-8"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    as_id = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = lines(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", as_id(F.col("page_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        ("WARC-Profile", F.when(revisit, PROFILE)),
        ("WARC-Refers-To", F.when(revisit, as_id(F.col("response_id")))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)),
    )
    record = F.concat(F.encode(F.concat(F.lit("WARC/1.0\r\n"), head, F.lit("\r\n")), "UTF-8"), block)
    joined.select(record.cast("string").alias("value")).write.option("lineSep", RECORD_END).text(path)


def records_of(archive: memoryview) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, HTTP head and payload of each record, cut by Content-Length."""
    data, at = bytes(archive), 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        first, *rest = data[at:head_end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in rest)
        start = head_end + 4
        end = start + int(headers["Content-Length"])
        http, _, payload = data[start:end].partition(b"\r\n\r\n")
        yield headers, http, payload
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has no end")
        at = end + 4


def id_of(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(ID)
    return int(text) if text not in ("", "null") else None


def parse(batches: Iterator[pa.RecordBatch], with_payload: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            out = []
            for headers, _, payload in records_of(content.as_buffer()):
                kind = headers["WARC-Type"]
                response = kind == "response"
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if response and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} is not the one its digest names")
                out.append(
                    (
                        id_of(headers["WARC-Record-ID"]),
                        headers.get("WARC-Target-URI"),
                        kind,
                        id_of(headers.get("WARC-Refers-To")),
                        digest,
                        len(payload) if response else None,
                        payload if response and with_payload else None,
                    )
                )
            columns = list(zip(*out)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives under ``path``; a revisit has no payload and null bytes."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
        ]
    )
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda batches: parse(batches, with_payload, schema), PARSED)


def with_sizes(records: DataFrame) -> DataFrame:
    """Join revisits to the responses they name, which have the payload's size."""
    heads = stage(records.drop("payload"), "warc-heads")
    responses = (
        heads.filter("record_type = 'response'")
        .groupBy(F.col("page_id").alias("refers_to"))
        .agg(F.max("payload_bytes").alias("full_bytes"))
    )
    named = stage(
        responses.join(heads.select("refers_to").distinct(), "refers_to", "left_semi"), "warc-named"
    )
    return heads.join(named, "refers_to", "left").select(
        "page_id", "url", "record_type", "refers_to", "payload_digest",
        F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"),
    )


ORACLE = """
WITH d AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
    SELECT page_id, payload_bytes,
           list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)),
               'string_agg', '') AS payload_digest
    FROM d
), m AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM b
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM m
"""


@query("op2_warc_revisits", ORACLE)
def op2_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as WARC records, read back, revisits resolved."""
    path = scratch(spark, "warc")
    pages = table(spark, folder, "pages").select("page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    write_archives(pages, path)
    return with_sizes(read_archives(spark, path, with_payload=False)).drop("url")
