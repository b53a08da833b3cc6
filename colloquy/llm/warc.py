"""WARC archives with revisit resolution.

Only record headers travel for the resolution: they are shuffled by payload digest, the smallest
page_id of each digest (partial minimum, so a hot payload is one row per task) becomes the original,
and every other record joins to it and becomes a revisit.  Responses keep their payload, revisits get
fresh headers that name the original.  Archives are gzip-compressed WARC/1.1 files written by Spark
into the shared folder (a record is a line, the record separator is the line separator), a bounded
number of records each, and are read back with Spark's binary reader, one file at a time.

Nulls and edge cases: a null html is an empty payload; a null url has no target header; a null page_id
sorts last and reads back as null.  Repeated page rows with equal payloads: the first is the
response, the others revisit it.  Payloads below ``min_bytes`` are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.common import materialize, shared_path

MIN_BYTES = 0
RECORDS_PER_FILE = 1000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
RESULT = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_heads(pages: DataFrame) -> DataFrame:
    """``(uid, page_id, url, html, payload_bytes, payload_digest)``; uid tells repeated rows apart."""
    def run(batches):
        for pdf in batches:
            raw = [t.encode("utf-8") if isinstance(t, str) else b"" for t in pdf["html"]]
            pdf["payload_bytes"] = [len(b) for b in raw]
            pdf["payload_digest"] = [digest32(b) for b in raw]
            yield pdf

    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("string").alias("page_id"),
                        F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # ids travel as text: exact beside nulls
    heads = rows.mapInPandas(run, "uid bigint, page_id string, url string, html string, payload_bytes bigint, payload_digest string")
    return heads.withColumn("page_id", F.col("page_id").cast("bigint"))


def resolve(heads: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(uid, record_type, o_page, o_uid)``: each record's original (itself for a response)."""
    key = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page"), F.col("uid").alias("uid"))
    shared = heads.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(key).alias("o"))
    out = heads.select("uid", "payload_digest", "payload_bytes").join(shared, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & (F.col("o.uid") != F.col("uid"))
    return out.select("uid", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                      F.when(revisit, F.col("o.page")).alias("o_page"), F.when(revisit, F.col("o.uid")).alias("o_uid"))


def _urn(page: Column, uid: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"), uid.cast("string"), F.lit(">"))


def record_lines(records: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC record (without the closing separator) per row, as column ``value``."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    response = F.col("record_type") == "response"
    size = F.octet_length(http) + F.when(response, F.col("payload_bytes")).otherwise(0)
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: "), _urn(F.col("page_id"), F.col("uid")),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(response, F.lit("")).otherwise(F.concat(
            F.lit("\r\nWARC-Refers-To: "), _urn(F.col("o_page"), F.col("o_uid")),
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), F.lit(END),
        http, F.when(response, F.coalesce(F.col("html"), F.lit(""))).otherwise(F.lit("")))
    return records.select(value.alias("value"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    heads = materialize(record_heads(pages), "warc-heads")
    records = heads.join(resolve(heads, min_bytes), "uid")
    (record_lines(records).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-cased names) and block of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
        start = head_end + 4
        end = start + int(fields["content-length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        yield fields, data[start:end]
        at = end + 4


def _page(urn: str) -> int | None:
    page = re.fullmatch(r"<urn:page:(-?\d+|null):\d+>", urn)[1]
    return None if page == "null" else int(page)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``; a response's payload is hashed again."""
    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for f, block in parse_records(zlib.decompress(content, wbits=31)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    told = f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and (len(payload) != n or digest32(payload) != told):
                        raise ValueError(f"payload of {f['warc-record-id']} does not match its header")
                    rows.append((_page(f["warc-record-id"]), n, told, f["warc-type"],
                                 _page(f["warc-refers-to"]) if "warc-refers-to" in f else None))
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                for name, place in (("page_id", 0), ("refers_to", 4)):
                    out[name] = pd.array([r[place] for r in rows], dtype="Int64")      # exact beside nulls
                yield out

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInPandas(run, RESULT)


def warc_round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write deduplicated archives of ``pages`` into the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)
