"""WARC archives: a writer with revisit records and a splittable reader.

The reader deals byte ranges of the files to tasks. A task looks for the magic bytes of a gzip member in its range,
takes a candidate for real only if it decompresses to the head of a WARC record, and owns the records whose member
starts inside its range; it reads on behind the range's end to finish the last of them. So one large file is read by many
tasks, and each record is read once.
"""

from __future__ import annotations

import atexit
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, shared_dir, table

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are always stored as responses.
LEAST_REVISIT_BYTES = 100
#: Bytes of compressed records in one written archive, about.
ARCHIVE_BYTES = 32 << 20
#: The table of a folder's archives.
MANIFEST = "manifest.parquet"
RECORD = re.compile(rb"WARC/1\.[01]\r\n")
TAIL = b"\r\n\r\n"

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("archive", T.StringType()),
        T.StructField("start", T.LongType()),
    ]
)
RECORD_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()), ("start", pa.int64())]
)


def build_record(record_id: str, kind: str, uri: str | None, digest: str, size: int, payload: bytes, refers_to: str | None) -> bytes:
    """One gzip member that holds one WARC record. A revisit has no payload but names the record that has it."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: <" + record_id.encode() + b">"]
    if uri is not None:
        lines.append(b"WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", uri).encode())
    lines.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    lines.append(b"X-Payload-Length: " + str(size).encode())
    if refers_to is not None:
        lines.append(b"WARC-Refers-To: <" + refers_to.encode() + b">")
        lines.append(b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(b"Content-Type: text/html; charset=utf-8")
    lines.append(b"Content-Length: " + str(len(payload)).encode())
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(b"\r\n".join(lines) + TAIL + payload + TAIL) + pack.flush()


def parse_record(raw: bytes) -> dict | None:
    """The fields of one record, or None if raw is no whole record."""
    if not RECORD.match(raw):
        return None
    head, gap, rest = raw.partition(TAIL)
    if not gap:
        return None
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower().decode("latin-1")] = value.strip()
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        return None
    if len(rest) < length:
        return None
    bare = lambda k: fields[k].strip(b"<>").decode() if k in fields else None
    return {
        "record_id": bare("warc-record-id"),
        "record_type": bare("warc-type"),
        "target_uri": fields["warc-target-uri"].decode("utf-8", "replace") if "warc-target-uri" in fields else None,
        "refers_to": bare("warc-refers-to"),
        "payload_digest": (bare("warc-payload-digest") or "").rpartition(":")[2] or None,
        "payload_bytes": int(fields.get("x-payload-length", fields["content-length"])),
        "payload": rest[:length],
    }


def is_record_at(data: bytes, at: int) -> bool:
    """Whether a gzip member that starts at this place begins with the head of a WARC record."""
    try:
        head = zlib.decompressobj(31).decompress(data[at : at + 4096], 16)
    except zlib.error:
        return False
    return bool(RECORD.match(head))


def records_from(data: bytes, first: int, bound: int, whole: bool) -> Iterator[tuple[int, dict | None]]:
    """(place, record) of each record whose member starts in [first, bound) of data.

    whole: data reaches the end of the file. Else a member that is cut off is reported with None, so that the caller
    can read more.
    """
    at = first
    while 0 <= (at := data.find(MAGIC, at)) < bound:
        if not is_record_at(data, at):
            at += 1
            continue
        got = inflate(data, at)
        if got is None:
            at += 1
            continue
        raw, end = got
        if end < 0:
            if not whole:
                yield at, None
                return
            at += 1
            continue
        record = parse_record(raw)
        if record is None:
            at += 1
            continue
        yield at, record
        at = end


def inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int] | None:
    """A gzip member's content and the place behind it; -1 for that place if data ends before it; None if damaged."""
    unpack, parts, view = zlib.decompressobj(31), [], memoryview(data)
    while at < len(data):
        piece = view[at : at + step]
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error:
            return None
        at += len(piece)
        if unpack.eof:
            return b"".join(parts), at - len(unpack.unused_data)
    return b"".join(parts), -1


def plan_payloads(pages: DataFrame, key: str = "page_id", body: str = "html", uri: str = "url") -> DataFrame:
    """Digest each payload and find the response that a repeated payload refers to.

    A null payload is empty. The smallest key with a payload is its response. Equal payloads are found by digest:
    the smallest key of each is aggregated before the shuffle, so thousands of copies are a single row in it.
    """
    digests = pages.select(key, F.sha2(F.coalesce(F.col(body), F.lit("")), 256).alias("d"), F.octet_length(F.coalesce(F.col(body), F.lit(""))).cast("long").alias("n"))
    shared = digests.where(F.col("n") >= LEAST_REVISIT_BYTES).groupBy("d").agg(F.min(key).alias("first_key"), F.count("*").alias("c")).where("c > 1").drop("c")
    return (
        pages.select(F.col(key).alias("record_key"), F.col(uri).alias("uri"), F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8").alias("payload"))
        .withColumn("payload_digest", F.sha2("payload", 256))
        .join(shared, F.col("payload_digest") == F.col("d"), "left")
        .select("record_key", "uri", "payload", "payload_digest", F.when(F.col("first_key") != F.col("record_key"), F.col("first_key")).alias("refers_to"))
    )


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", body: str = "html", uri: str = "url") -> str:
    """Write one record per row of pages to *.warc.gz files in folder, a shared folder; return the folder.

    Each task writes its rows in order of key to archives of about ARCHIVE_BYTES, whose names hold its attempt. The table
    MANIFEST in the folder lists the archives of the attempts that Spark committed, so what a lost or repeated attempt
    leaves behind is never read. Null payloads are empty; repeated rows are a record each, and rows that repeat a key may
    refer to each other's record only under another key. A payload of any length is one record. An empty table gives
    an empty list. Other columns are ignored.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, count = TaskContext.get(), io.BytesIO(), 0

        def store() -> pa.RecordBatch:
            nonlocal count
            name = f"part-{context.partitionId():05d}-{count:05d}-{context.taskAttemptId()}.warc.gz"
            store_fs, base = fs.FileSystem.from_uri(folder)
            store_fs.create_dir(base, recursive=True)
            with store_fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(held.getbuffer())
            size, count = held.tell(), count + 1
            held.__init__()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64())], ["archive", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = [batch.column(k)[i].as_py() for k in range(5)]
                revisit = row[4] is not None
                held.write(build_record("" if row[0] is None else str(row[0]), "revisit" if revisit else "response", row[1], row[3], len(row[2]), b"" if revisit else row[2], str(row[4]) if revisit else None))
                if held.tell() >= ARCHIVE_BYTES:
                    yield store()
        if held.tell():
            yield store()

    rows = plan_payloads(pages, key, body, uri).sortWithinPartitions("record_key", "payload_digest")
    rows.mapInArrow(pack, "archive string, bytes long").write.parquet(f"{folder}/{MANIFEST}")
    return folder


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the archives in folder: those that its MANIFEST lists, else all *.warc.gz files."""
    listed = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    if listed.getFileSystem(spark._jsc.hadoopConfiguration()).exists(listed):
        return spark.read.schema("archive string, bytes long").parquet(f"{folder}/{MANIFEST}").select(F.concat(F.lit(f"{folder}/"), "archive").alias("path"), F.col("bytes").alias("length"))
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path", "length")


def read_warc(spark: SparkSession, folder: str, range_bytes: int = 4 << 20) -> DataFrame:
    """One row per record of the archives in folder, read in byte ranges of range_bytes.

    Damaged members and bytes between members are passed over. Payloads of revisits are empty.
    """
    ranges = archives_in(spark, folder).select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("first"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store_fs, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                with store_fs.open_input_file(base) as source:
                    size = range_bytes + max(range_bytes, 1 << 16)
                    while True:
                        source.seek(first)
                        data = source.read(min(size, length - first))
                        found = list(records_from(data, 0, min(range_bytes, length - first), first + len(data) >= length))
                        if not found or found[-1][1] is not None:
                            break
                        size *= 2
                for at in range(0, len(found), 256):
                    rows = [r | {"archive": path, "start": first + p} for p, r in found[at : at + 256]]
                    yield pa.RecordBatch.from_pylist(rows, schema=RECORD_ARROW)

    return ranges.repartition(F.col("path"), F.col("first")).mapInArrow(unpack, RECORD_SCHEMA)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages as WARC, read the archives back, and report one row per page.

    Null html is an empty payload and a small one; equal small payloads are all responses. A null url is left out of the
    record, a null page_id is a response without an id. Columns of pages other than page_id, url and html are ignored.
    """
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    atexit.register(drop, spark, folder)
    records = read_warc(spark, write_archives(table(spark, sf_dir, "pages"), folder))
    whole = F.col("record_type") == "response"
    return records.select(
        F.nullif("record_id", F.lit("")).cast("long").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


#: The same rows by SQL: digests, and the smallest page of each payload of 100 bytes or more.
ORACLE = """
SELECT page_id, CAST(octet_length(encode(b)) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest,
       CASE WHEN octet_length(encode(b)) >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(b)) >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS b, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages)
"""
