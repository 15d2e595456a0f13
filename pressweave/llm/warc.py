"""Web archives: write captures as records, read archives, and assemble the records of each capture.

Records are text of a fixed shape, so Spark's text writer makes the archive files
(the record separator is its line separator); files are closed after a fixed number
of records.  Reading takes whole files and cuts them by the lengths that the records state.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressweave.llm.common import framed, importable

REVISIT_BYTES = 1000
RECORDS_PER_FILE = 6000
END = "\r\n\r\n"
RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
          "stated_digest string, http_length long, payload binary, payload_bytes long, payload_digest string, block string")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_uri(kind: str, key: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(key.cast("string"), F.lit("none")), F.lit(f":{kind}>"))


def record(kind: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}")]
    lines += [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")) for name, value in headers]
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def deduplicated(captures: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``digest``, ``bytes`` and ``original``: the largest key among equal payloads, null for that one itself.

    Payloads below ``least_bytes`` stand for themselves.  The originals are one
    aggregate (combined before the shuffle) over digests that occur more than once;
    rows meet it in a plain join, whose hot keys adaptive execution splits.
    """
    digest = F.sha1(F.col("payload").cast("binary"))
    rows = captures.withColumns({"digest": digest, "bytes": F.octet_length("payload").cast("long")})
    own = F.when(F.col("bytes") >= least_bytes, F.col("digest")).otherwise(F.concat(F.lit("small "), F.col("key").cast("string")))
    rows = rows.withColumn("_same", own)
    groups = (rows.groupBy("_same").agg(F.max("key").alias("_last"), F.count(F.lit(1)).alias("_n"))
              .filter("_n > 1").select("_same", "_last"))
    joined = rows.join(groups, "_same", "left")
    return joined.withColumn("original", F.when(F.col("_last") != F.col("key"), F.col("_last"))).drop("_same", "_last")


def write_archive(captures: DataFrame, path: str, least_bytes: int = REVISIT_BYTES,
                  records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write ``key``, ``url``, ``payload`` (text, null: empty) as request, response or revisit, and metadata records.

    Null urls leave the target header out; a capture without key is written under the key "none" and is
    never the original of another; rows that repeat a key are captures of their own that share records.  Line ends in urls become spaces, as a
    header is one line.  An empty table gives an archive without records.
    """
    key, when = F.col("key"), F.lit("2024-01-01T00:00:00Z")
    captures = captures.select("key", F.regexp_replace("url", r"[\r\n]+", " ").alias("url"),
                               F.coalesce("payload", F.lit("")).alias("payload"))
    rows = deduplicated(captures, least_bytes)
    main = record_uri("response", key)
    target, date = ("WARC-Target-URI", F.col("url")), ("WARC-Date", when)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    shown_digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http_type = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = record("response", [("WARC-Record-ID", main), target, date, shown_digest, http_type], F.concat(http, F.col("payload")))
    revisit = record("revisit", [("WARC-Record-ID", main), target, date, shown_digest, http_type, ("WARC-Profile", F.lit(PROFILE)),
                                 ("WARC-Refers-To", record_uri("response", F.col("original")))], http)
    request = record("request", [("WARC-Record-ID", record_uri("request", key)), target, date, ("WARC-Concurrent-To", main),
                                 ("Content-Type", F.lit("application/http; msgtype=request"))],
                     F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(f" HTTP/1.1{END}")))
    metadata = record("metadata", [("WARC-Record-ID", record_uri("metadata", key)), target, date, ("WARC-Concurrent-To", main),
                                   ("Content-Type", F.lit("application/warc-fields"))], F.lit("charset-detected: utf-8\r\n"))
    texts = rows.select(F.explode(F.array(request, F.when(F.col("original").isNull(), response).otherwise(revisit), metadata)).alias("value"))
    (texts.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path))


def header_map(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}


def records_of(raw: bytes) -> Iterator[tuple]:
    """The records of one archive file (plain, or gzip members one after another)."""
    if raw[:2] == b"\x1f\x8b":
        parts = []
        while raw:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(raw) + member.flush())
            raw = member.unused_data
        raw = b"".join(parts)
    at = 0
    while (head_end := raw.find(b"\r\n\r\n", at)) >= 0:
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no record starts at byte {at}")
        head = header_map(raw[at:head_end])
        start, size = head_end + 4, int(head["content-length"])
        block = raw[start:start + size]
        at = start + size + 4
        http_length, payload, text = None, None, None
        if head["warc-type"] in ("response", "revisit"):
            top, _, body = block.partition(b"\r\n\r\n")
            http_length = int(header_map(top).get("content-length") or len(body))
            if head["warc-type"] == "response":
                payload = body
        else:
            text = block.decode("utf-8", "replace")
        digest = re.sub("^sha1:", "", head.get("warc-payload-digest", "")) or None
        yield (head.get("warc-record-id"), head["warc-type"], head.get("warc-concurrent-to"), head.get("warc-refers-to"),
               head.get("warc-target-uri"), head.get("warc-date"), digest, http_length, payload,
               None if payload is None else len(payload), None if payload is None else hashlib.sha1(payload).hexdigest(), text)


def read_archive(spark: SparkSession, path: str, rows_per_batch: int = 500) -> DataFrame:
    """One row per record of the files below ``path``; a file (up to 2 GB) is read as one piece by one task."""
    importable(spark)
    names = [f.split()[0] for f in RECORD.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for raw in batch["content"]:
                rows = []
                for row in records_of(bytes(raw)):
                    rows.append(row)
                    if len(rows) >= rows_per_batch:
                        yield framed(rows, names, "http_length", "payload_bytes")
                        rows = []
                yield framed(rows, names, "http_length", "payload_bytes")

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per response or revisit, with the request and the metadata that are concurrent to it.

    Of several requests (or metadata records) of one capture the one with the
    smallest record id is shown and all are counted, so the state of a group is of
    constant size.  Records concurrent to nothing that is there are left to
    ``orphans``.  A capture without request or metadata has nulls there.
    """
    def side(kind: str, name: str) -> list[Column]:
        is_kind = F.col("type") == kind
        return [F.min(F.when(is_kind, F.struct("record_id", "date", "block"))).alias(name),
                F.count(F.when(is_kind, 1)).alias(f"n_{name}")]

    others = (records.filter(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
              .groupBy(F.col("concurrent_to").alias("_of")).agg(*side("request", "request"), *side("metadata", "metadata")))
    main = records.filter(F.col("type").isin("response", "revisit"))
    return main.join(others, F.col("record_id") == F.col("_of"), "left").select(
        "record_id", "target_uri", "date",
        F.struct("type", "refers_to", "payload", F.coalesce("payload_bytes", "http_length").alias("payload_bytes"),
                 F.coalesce("payload_digest", "stated_digest").alias("payload_digest")).alias("response"),
        "request", "metadata", F.coalesce("n_request", F.lit(0)).alias("n_request"),
        F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"))


def orphans(records: DataFrame) -> DataFrame:
    """Requests and metadata whose response is not in the archives."""
    main = records.filter(F.col("type").isin("response", "revisit")).select(F.col("record_id").alias("_of"))
    return (records.filter(F.col("type").isin("request", "metadata"))
            .join(main, F.col("concurrent_to") == F.col("_of"), "left_anti"))


def capture_key(uri: Column) -> Column:
    """The key in a record id that ``write_archive`` made."""
    return F.regexp_extract(uri, r"^<urn:capture:(-?\d+):", 1).try_cast("long")
