"""WARC archives with revisit resolution.

Writing. Headers alone (key, payload digest, length) are shuffled by digest; of records with equal
payloads of at least ``min_bytes`` the smallest key keeps its payload as a response, and the others
become revisit records that name it. Payloads move once, by their unique key, to meet their record
type, so a payload that a third of the pages share is not gathered anywhere.

Archives are WARC/1.1 files, each compressed with gzip as a whole: Spark has no writer that cuts a file
into a gzip member for each record, and one that opened files itself would leave those of lost
executors behind. So files are read from their start, not sought in. Spark's text writer makes them: a
row is a whole record and the line separator is the blank lines that end it, so they are committed like
any other Spark output, in any store. Files hold about FILE_BYTES unpacked and never more than MOST_BYTES,
unless a single record does: payloads of more than LARGE times the mean are written apart from the others,
so that the largest of each part bounds its records a file and few long pages don't make all files small.

Reading. Files, packed or plain, are read as binary and cut by Content-Length, never by looking for separators, and
digests are checked. Revisit records are joined to the responses of their digest, which gives them
the payload's length and the key of the response.

``rewrite`` does all of that from archives to archives, with fresh headers.

A null payload is empty. Rows with a null key are written under an empty id and read back as null;
they are never the smallest key. Repeated rows with one key and payload are all responses: a tie needs
no rule. Payloads of any length up to a file's limit (2 GB) are carried whole. An empty table writes no
records. Only the key, the URI and the payload are read, so other columns, of whatever names, have no
effect.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, shared_dir, written

MIN_BYTES = 100
FILE_BYTES = 64 << 20

#: Most bytes of a file of several records; a record's payload that is so many times the mean is a large one.
MOST_BYTES, LARGE = 1 << 30, 16

#: Bytes of a record besides its payload and URI, about.
HEADER = 1024
END = "\r\n\r\n"


def revisits(pages: DataFrame, key: str, payload: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """_key, _digest and refers_to, the key of the response, of the pages that are revisits."""
    rows = measured(pages, payload)
    headers = rows.where(F.col("bytes") >= min_bytes).select(key, "digest")
    originals = headers.groupBy("digest").agg(F.min(key).alias("original"), F.count("*").alias("n")).where("n > 1 AND original IS NOT NULL").drop("n")
    return headers.join(originals, "digest").where(~F.col(key).eqNullSafe(F.col("original"))).select(F.col(key).alias("_key"), F.col("digest").alias("_digest"), F.col("original").alias("refers_to")).distinct()


def measured(pages: DataFrame, payload: str) -> DataFrame:
    """Adds digest and bytes of the payload."""
    return pages.withColumns({"digest": F.sha2(F.coalesce(F.col(payload), F.lit("")), 256), "bytes": F.octet_length(F.coalesce(payload, F.lit(""))).cast("long")})


def marked(pages: DataFrame, again: DataFrame, key: str, payload: str) -> DataFrame:
    """Adds digest, bytes, and refers_to: the key of the response for revisits, else null."""
    rows = measured(pages, payload)
    return rows.join(again, rows[key].eqNullSafe(again["_key"]) & (rows["digest"] == again["_digest"]), "left").drop("_key", "_digest")


def record(key: Column, uri: Column, payload: Column, digest: Column, size: Column, refers_to: Column, date: str) -> Column:
    """The text of a record without the blank lines that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    name = lambda k: F.concat(F.lit("<urn:page:"), F.coalesce(k.cast("string"), F.lit("")), F.lit(">"))
    revisit = refers_to.isNotNull()
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(key)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(refers_to)))).otherwise(""),
        line("Content-Type", F.lit("text/html;charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(size.cast("string"))),
        F.lit("\r\n"),
        F.when(revisit, "").otherwise(F.coalesce(payload, F.lit(""))),
    )


def write(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES, date: str | None = None, file_bytes: int = FILE_BYTES, most_bytes: int = MOST_BYTES) -> None:
    """Write deduplicated archives of pages under path. date: WARC-Date, the present time if null."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select(key, uri, payload)
    size = F.coalesce(F.octet_length(payload), F.lit(0)) + F.coalesce(F.octet_length(uri), F.lit(0)) + HEADER
    mean, most = pages.agg(F.avg(size), F.max(size)).first()
    again = written(revisits(pages, key, payload, min_bytes), "revisits")
    bound = int(LARGE * (mean or HEADER))
    for large in (False, True) if (most or 0) > bound else (False,):
        own = pages.where(size > bound if large else size <= bound) if (most or 0) > bound else pages
        rows = marked(own, again, key, payload)
        text = record(F.col(key), F.col(uri), F.col(payload), F.col("digest"), F.col("bytes"), F.col("refers_to"), date)
        records = max(1, min(int(file_bytes // (mean or HEADER)), most_bytes // (most if large else min(bound, most or HEADER))))
        rows.select(text.alias("value")).write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


RECORD = T.StructType([T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("date", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("length", T.LongType()), T.StructField("payload", T.BinaryType())])


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], int, int]]:
    """Headers, and the first and last + 1 byte of the block, of each record of a file."""
    at = 0
    while at < len(data):
        split = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:split].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        end = split + 4 + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's end is missing at byte {end}")
        yield headers, split + 4, end
        at = end + 4


def bare(urn: str | None) -> str | None:
    """The key in <urn:page:key>."""
    return urn.removeprefix("<urn:page:").removesuffix(">") or None if urn else None


def read(spark, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives under path. Response digests are checked against payloads."""
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = RECORD if keep_payload else T.StructType(RECORD.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_buffer().to_pybytes()
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                rows, held = [], 0

                def out() -> pa.RecordBatch:
                    columns = list(zip(*rows)) or [()] * len(schema)
                    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

                for headers, a, b in records_of(data):
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
                    kind = headers["warc-type"]
                    if kind == "response" and hashlib.sha256(data[a:b]).hexdigest() != digest:
                        raise ValueError(f"payload and digest differ: {headers.get('warc-record-id')}")
                    rows.append((bare(headers.get("warc-record-id")), kind, headers.get("warc-target-uri"), headers.get("warc-date"), digest, bare(headers.get("warc-refers-to")), b - a, *([data[a:b]] if keep_payload else [])))
                    held += b - a if keep_payload else 0
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield out()
                        rows, held = [], 0
                yield out()

    return mapped(files, run, schema)


def resolve(records: DataFrame) -> DataFrame:
    """Joins revisit records to the responses of their digest: original (its record_id) and
    payload_bytes are added; both come from the row itself for responses. Headers alone should be
    handed in. A revisit without a response in the archives has a null original."""
    responses = records.where("record_type = 'response'").groupBy("digest").agg(F.min_by("record_id", F.struct(F.col("record_id").cast("long"), "record_id")).alias("_id"), F.max("length").alias("_length"))
    plain = records.where("record_type = 'response'").withColumns({"original": F.lit(None).cast("string"), "payload_bytes": F.col("length")})
    revisits = records.where("record_type = 'revisit'").join(responses, "digest", "left").withColumns({"original": F.col("_id"), "payload_bytes": F.col("_length")}).drop("_id", "_length")
    return plain.unionByName(revisits)


def rewrite(spark, source: str, target: str, min_bytes: int = MIN_BYTES, date: str | None = None, file_bytes: int = FILE_BYTES, most_bytes: int = MOST_BYTES) -> None:
    """Archives to archives: revisits are resolved, equal payloads stored once, headers fresh."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    held = written(read(spark, source, keep_payload=False), "headers")
    headers = resolve(held).select("record_id", "record_type", "uri", "digest", F.coalesce("payload_bytes", "length").alias("bytes"))
    smallest = headers.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(F.struct(F.col("record_id").cast("long").alias("n"), F.col("record_id").alias("id"))).alias("first"))
    kept = headers.join(smallest, "digest", "left").select(F.col("record_id").alias("id"), F.col("uri").alias("target"), "digest", "bytes", F.when(F.col("first.id") != F.col("record_id"), F.col("first.id")).alias("refers_to"))
    # A payload goes to the record that keeps it: by digest from whichever response held it.
    holder = held.where("record_type = 'response'").groupBy("digest").agg(F.min("record_id").alias("held_by"))
    bodies = read(spark, source).where("record_type = 'response'").select("digest", F.col("record_id").alias("held_by"), F.col("payload").cast("string").alias("payload"))
    needed = kept.where("refers_to IS NULL").join(holder, "digest", "left")
    full = needed.join(bodies, ["digest", "held_by"], "left").drop("held_by")
    rows = full.unionByName(kept.where("refers_to IS NOT NULL").withColumn("payload", F.lit(None).cast("string")))
    text = record(F.col("id"), F.col("target"), F.col("payload"), F.col("digest"), F.col("bytes"), F.col("refers_to"), date)
    mean, most = held.agg(F.avg(F.col("length") + HEADER), F.max(F.col("length") + HEADER)).first()
    records = max(1, min(int(file_bytes // (mean or HEADER)), most_bytes // (most or HEADER)))
    rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records).text(target)


def round_trip(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes archives of pages to the shared folder, reads them back and resolves the revisits:
    key, payload_bytes, payload_digest, record_type, refers_to. Archives are unpacked once."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/pagewright/warc-{uuid.uuid4().hex}"
    write(pages, path, key, uri, payload, min_bytes)
    found = resolve(written(read(spark, path, keep_payload=False), "headers"))
    kind = pages.schema[key].dataType
    return found.select(F.col("record_id").cast(kind).alias(key), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", F.coalesce("original", "refers_to")).cast(kind).alias("refers_to"))
