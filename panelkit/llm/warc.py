"""Content-addressed web archive.

Payload bytes are stored once, under a strong digest (SHA-256) that is verified again on every read. Record headers
are stored apart, byte for byte as they stand in a WARC file. The original records come back by a join of the two tables
on the digest.

WARC files are written from the two tables and read back by content lengths. A record is one gzip member (or several, of
at most ``MEMBER_BYTES``), so a reader can begin at any record. A gzip member below 16 MiB ends in a zero byte, which is
the line end that the engine's own text writer puts behind each value: so files are written to any shared store by the
engine, with its commit protocol, and hold nothing but members. A revisit has no block; its payload is joined from the
response it refers to.

Defined cases: a null payload is empty; null ids are kept and never become the holder of a payload unless all ids of
that payload are null; repeated rows each have a record (with the same record id), and all rows with the holder's id are
responses; the holder among ties is any of the equal rows; very long payloads are one record of several members; an
empty table gives an empty archive; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import keep, new_path, pick, small_batches

#: Payloads shorter than this are always stored as responses.
MIN_REVISIT_BYTES = 1000
#: The date of all records that are written here; a fixed one, so that reruns give equal bytes.
RECORD_DATE = "1970-01-01T00:00:00Z"
#: Bytes of a record that one gzip member holds at most; below 2**24, see above.
MEMBER_BYTES = 8 << 20
#: Records of a file at most, and bytes of records that a reader hands on at once.
FILE_RECORDS, BATCH_BYTES = 4096, 4 << 20
#: Compressed bytes that go to the decompressor at once.
READ_BYTES = 16 << 10


@dataclass(frozen=True)
class Archive:
    """``payloads``: digest, payload, sha1, n_bytes. ``headers``: page_id, digest, revisit, header."""

    payloads: str
    headers: str


def records_of_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, payload, digest."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pick(pages, page_id=page_id, url=url, html=html).select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest", F.unhex(F.sha2("payload", 256))
    )


def _header(page_id: Column, url: Column, sha1: Column, n_bytes: Column, holder: Column, revisit: Column) -> Column:
    """The exact header block of a record, with the empty line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    known = F.coalesce(page_id.cast("string"), F.lit("null"))
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, line("WARC-Type", F.lit("revisit"))).otherwise(line("WARC-Type", F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), known, F.lit(">"))),
        line("WARC-Date", F.lit(RECORD_DATE)),
        # a line break inside a URL would end the header early
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), holder.cast("string"), F.lit(">"))), line("WARC-Profile", F.lit("identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(n_bytes.cast("string"))),
        F.lit("\r\n"),
    )


def write_archive(records: DataFrame, archive: Archive | None = None) -> Archive:
    """Store each payload once and the header of each record.

    The payloads move through one shuffle, combined per digest before it, so a payload that a third of all pages
    share moves once per task. The headers' join carries no payload, and its hot digests are split by the engine.
    """
    spark = records.sparkSession
    archive = archive or Archive(new_path(spark, "warc-payloads"), new_path(spark, "warc-headers"))
    (
        records.groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.any_value("payload").alias("payload"))
        .withColumns({"sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
        .write.option("compression", "zstd")
        .parquet(archive.payloads)
    )
    held = spark.read.parquet(archive.payloads).select("digest", "holder", "sha1", "n_bytes")
    revisit = (F.col("n_bytes") >= MIN_REVISIT_BYTES) & F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    (
        records.select("page_id", "url", "digest")
        .join(held, "digest")
        .select("page_id", "digest", revisit.alias("revisit"), _header(F.col("page_id"), F.col("url"), F.col("sha1"), F.col("n_bytes"), F.col("holder"), revisit).alias("header"))
        .write.option("compression", "zstd")
        .parquet(archive.headers)
    )
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, revisit, header, payload of each original record; fails on a payload that doesn't match its digest."""
    return spark.read.parquet(archive.headers).join(_payloads(spark, archive), "digest").select("page_id", "revisit", "header", "payload")


def _payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    return spark.read.parquet(archive.payloads).select(
        "digest",
        F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("payload doesn't match its digest "), F.hex("digest"))).cast("binary"))
        .alias("payload"),
    )


def field(name: str) -> Column:
    """The value of a header field, or null."""
    found = F.regexp_extract("header", f"\\r\\n{name}: ([^\\r]*)\\r\\n", 1)
    return F.when(found != "", found)


def members(record: bytes) -> bytes:
    """A record as gzip members."""
    parts = [record[k : k + MEMBER_BYTES] for k in range(0, len(record), MEMBER_BYTES)]
    return b"".join(_member(x) for x in parts)


def _member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


def write_warc_files(spark: SparkSession, archive: Archive, path: str) -> None:
    """WARC files of all records of an archive. Only responses are joined with their payload."""
    small_batches(spark)
    headers = spark.read.parquet(archive.headers)
    responses = headers.where("NOT revisit").join(_payloads(spark, archive), "digest").select("header", "payload")
    records = responses.unionByName(headers.where("revisit").select("header", F.lit(b"").alias("payload")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # without its last byte, a zero, which the writer puts behind it
            packed = [members(h.as_py().encode() + p.as_py() + b"\r\n\r\n")[:-1] for h, p in zip(batch.column("header"), batch.column("payload"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])

    values = records.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    values.write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_warc(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a file of gzip members, by content lengths; one record in memory at a time."""
    rest, at, held = memoryview(content), 0, bytearray()
    while at < len(rest) or held:
        end = held.find(b"\r\n\r\n") + 4
        if end >= 4:
            header = bytes(held[:end])
            stop = end + next(int(x.split(b":", 1)[1]) for x in header.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            if len(held) >= stop + 4:
                if held[stop : stop + 4] != b"\r\n\r\n":
                    raise ValueError("a record doesn't end where its length says")
                yield header, bytes(held[end:stop])
                del held[: stop + 4]
                continue
        if at == len(rest):
            raise ValueError("a record is cut off")
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            if at == len(rest):
                raise ValueError("a member is cut off")
            some = rest[at : at + READ_BYTES]
            held += unpacker.decompress(some)
            at += len(some) - len(unpacker.unused_data)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """header, block of all records of all files below a path."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in parse_warc(content.as_py()):
                    rows.append(row)
                    size += len(row[0]) + len(row[1])
                    if size >= BATCH_BYTES:
                        yield _records(rows)
                        rows, size = [], 0
                yield _records(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "header string, block binary")


def _records(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h.decode() for h, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.binary())], names=["header", "block"])


def resolved(records: DataFrame) -> DataFrame:
    """Of each record of WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    Sizes and digests are those of the blocks that were read; a revisit's are those of the response with its digest.
    """
    number = lambda name: F.regexp_extract(F.coalesce(field(name), F.lit("")), "<urn:page:(-?\\d+)>", 1)
    value = lambda name: F.when(number(name) != "", number(name)).cast("long")
    own = records.select(
        value("WARC-Record-ID").alias("page_id"),
        F.octet_length("block").cast("long").alias("payload_bytes"),
        F.sha1("block").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        value("WARC-Refers-To").alias("refers_to"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("said"),
    )
    own = keep(own, "warc-read")
    responses = own.where("record_type = 'response'").withColumn("verified", F.col("payload_digest") == F.col("said")).drop("said")
    held = responses.groupBy(F.col("payload_digest").alias("said")).agg(F.first("payload_bytes").alias("payload_bytes"))
    revisits = own.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(held, "said", "left")
    revisits = revisits.select("page_id", "payload_bytes", F.col("said").alias("payload_digest"), "record_type", "refers_to", F.col("payload_bytes").isNotNull().alias("verified"))
    return responses.unionByName(revisits)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all ``pages``, write them as WARC files, read the files back, and say what is in them."""
    archive = write_archive(records_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    path = new_path(spark, "warc-files")
    write_warc_files(spark, archive, path)
    return resolved(read_warc_files(spark, path))


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(encode(html), ''::BLOB) AS payload FROM pages
), h AS (
  SELECT page_id, octet_length(payload) AS n, sha1(payload) AS d,
         max(page_id) OVER (PARTITION BY sha1(payload)) AS holder
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND holder IS DISTINCT FROM page_id AND holder IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND holder IS DISTINCT FROM page_id THEN CAST(holder AS BIGINT) END AS refers_to,
       TRUE AS verified
FROM h
"""
