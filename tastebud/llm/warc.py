"""WARC archives with revisit records for payloads that occur more than once.

Who is a revisit is decided on headers: page id, payload digest and length are
written once and shuffled by digest (partial minimum first). The revisits found
meet their pages by page id and digest, so copies of one payload lie under as many
keys as there are pages; no payload is shuffled under its digest.

Records are written by Spark's own text writer: a WARC record ends with two CRLF,
which is exactly the line separator given to the writer, so the output is
committed by Spark's protocol on any file system and a lost executor leaves no
half archive. Files are gzip members of at most ``max_records`` records and about
``FILE_BYTES``: records go to one folder per size class, and a class of twice the
size has half as many to a file. Headers are fresh: ids from page and payload, the
date of the run.

Reading takes the files as binary rows, walks each by Content-Length, and
resolves revisits by joining the record id they refer to with the responses.

Defined results: a null payload is empty; a payload under ``min_bytes`` is always
a response; of equal longer payloads the smallest page id is the response (rows
that repeat that id are all responses; null ids come last); a null url is
written as ``urn:unknown``; rows that repeat page and payload repeat the record
id; an empty table gives an empty archive. A record that can't be read (no WARC
line, no length, cut off) is a row of type ``broken`` that is not ok, and the rest
of its file is left out; other files are read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastebud.llm.common import materialise, small_batches

MIN_BYTES = 100
MAX_RECORDS, FILE_BYTES = 1000, 256 * 1024 * 1024
CRLF = "\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
RECORDS = ("record_id string, page_id long, record_type string, url string, payload_digest string, payload_bytes long, "
           "refers_to_id string, warc_date string, ok boolean")


def _record_id(page_id: Column, digest: Column) -> Column:
    name = F.md5(F.concat(F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def resolve(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """Pages as (page_id, url, payload, digest, bytes, original), original null for responses; and all headers."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.encode("payload", "UTF-8"), 256)) \
               .withColumn("bytes", F.octet_length("payload").cast("long"))
    headers = materialise(spark, rows.select("page_id", "digest", "bytes"), "headers")
    firsts = (headers.where(F.col("bytes") >= min_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("digest", "first"))
    # Written, so that joins read plain shuffles, of which AQE splits the one a common payload makes uneven.
    firsts = materialise(spark, firsts, "firsts")
    revisits = (headers.join(firsts, "digest").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
                .select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), F.col("first").alias("original")).distinct())
    same = rows["page_id"].eqNullSafe(F.col("r_page")) & (rows["digest"] == F.col("r_digest"))
    return rows.join(materialise(spark, revisits, "revisits"), same, "left").select(
        "page_id", "url", "payload", "digest", "bytes", "original"), headers


def records(resolved: DataFrame, warc_date: str) -> DataFrame:
    """One WARC/1.1 record per row as text, without the closing blank lines."""
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(HTTP_HEAD), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    # Control characters and spaces can't stand in a header line.
    uri = F.coalesce(F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20"), F.lit("urn:unknown"))
    refers = F.when(revisit, F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF),
        F.lit("WARC-Refers-To: "), _record_id(F.col("original"), F.col("digest")), F.lit(CRLF))).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF + "WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest")),
        F.lit(CRLF + "X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")),
        F.lit(CRLF + "WARC-Target-URI: "), uri,
        F.lit(CRLF + "WARC-Date: " + warc_date + CRLF), refers,
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(CRLF + CRLF))
    return resolved.select(F.concat(head, block).alias("value"))


def write_archive(pages: DataFrame, path: str, warc_date: str | None = None, id_col: str = "page_id",
                  url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_BYTES,
                  max_records: int = MAX_RECORDS, file_bytes: int = FILE_BYTES) -> None:
    """Write the de-duplicated archive below ``path``/size-N as ``*.txt.gz`` WARC files with fresh headers."""
    date = warc_date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    resolved, headers = resolve(pages, id_col, url_col, payload_col, min_bytes)
    small = max(1, file_bytes // max_records)  # bytes of a record of class 0
    size = F.greatest(F.ceil(F.log2(F.greatest(F.col("bytes"), F.lit(1)) / F.lit(small))), F.lit(0)).cast("int")
    classes = sorted(r["size"] for r in headers.select(size.alias("size")).distinct().collect()) or [0]  # one per doubling
    for c in classes:
        rows = resolved if len(classes) == 1 else resolved.where(size == c)
        (records(rows, date).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
         .option("maxRecordsPerFile", max(1, max_records >> c)).text(f"{path}/size-{c:02d}"))


def parse(stream) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """Records of one uncompressed WARC stream as (headers by lower-case name, block); no headers: what follows is unreadable."""
    try:
        while line := stream.readline():
            if not line.strip():
                continue
            headers: dict[str, str] = {}
            if line.startswith(b"WARC/"):
                while (line := stream.readline()).strip():
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    headers[name.strip().lower()] = value.strip()
            length = headers.get("content-length", "")
            block = stream.read(int(length)) if length.isdecimal() else b""
            if not length.isdecimal() or len(block) != int(length):
                yield None, b""
                return
            yield headers, block
    except (OSError, EOFError, zlib.error):  # a gzip member that ends early or isn't one
        yield None, b""


def _rows(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["record_id", "page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to_id", "warc_date", "ok"]
    for batch in files:
        for content in batch["content"]:
            rows = []
            for head, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
                if head is None:
                    rows.append((None, None, "broken", None, None, None, None, None, False))
                    continue
                payload, page = block.partition(b"\r\n\r\n")[2], head.get("x-page-id", "null")
                digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                response = head.get("warc-type") == "response"
                read = hashlib.sha256(payload).hexdigest() if response else digest
                rows.append((head.get("warc-record-id"), int(page) if page.lstrip("-").isdecimal() else None, head.get("warc-type", "broken"),
                             head.get("warc-target-uri"), read, len(payload) if response else None, head.get("warc-refers-to"),
                             head.get("warc-date"), read is not None and read == digest))
            frame = pd.DataFrame(rows, columns=columns)
            yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64"})


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Headers of all records below ``path``; response digests and lengths are computed from the payload read."""
    small_batches(spark)  # batches end by bytes, whatever the files hold
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true")
             .load(path).select("content"))
    return files.mapInPandas(_rows, RECORDS)


def read_resolved(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, revisits completed from the response that they refer to."""
    rows = materialise(spark, read_records(spark, path), "records")  # headers alone
    originals = (rows.where(F.col("record_type") == "response").groupBy(F.col("record_id").alias("refers_to_id"))
                 .agg(F.max("payload_bytes").alias("full_bytes"), F.min("page_id").alias("refers_to")))
    originals = materialise(spark, originals, "originals")
    columns = ["page_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to", "warc_date", "ok"]
    revisits = rows.where(F.col("record_type") == "revisit").join(originals, "refers_to_id", "left")
    return (rows.where(F.col("record_type") != "revisit").withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
            .unionByName(revisits.withColumn("payload_bytes", F.col("full_bytes")).select(*columns)))
