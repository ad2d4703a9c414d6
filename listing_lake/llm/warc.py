"""Stored pages as WARC records in a table of chunks."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
GZIP = 31


def base32_of_hex(value: Column) -> Column:
    """Base32 text of 40 hexadecimal digits: 4 groups of 40 bits, 8 letters each."""
    def letter(i: Column) -> Column:
        group = F.conv(F.substring(value, (F.floor(i / 8) * 10 + 1).cast("int"), F.lit(10)), 16, 10).cast("long")
        # Shift by a column, which the function wrapper does not take.
        five = F.call_function("shiftright", group, (F.lit(35) - (i % 8) * 5).cast("int")).bitwiseAND(F.lit(31))
        return F.substring(F.lit(BASE32), (five + 1).cast("int"), F.lit(1))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), letter), "")


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def chunk_rows(pages: DataFrame, chunk_bytes: int) -> DataFrame:
    """Every payload as rows (`chunk_no`, `data`) of at most `chunk_bytes`, each compressed on its own.

    Payloads are sliced before they leave the JVM, so that a Python worker holds a few chunks at a time. A running SHA-1 goes along
    the chunks of a record: `digest_so_far` of the last chunk is the payload's digest.
    """
    sliced = (
        pages.select("page_id", F.col("url").cast("string").alias("url"), _payload().alias("payload"))
        .withColumn("digest", base32_of_hex(F.sha1("payload")))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / chunk_bytes)).cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("chunk_no"))
        .withColumn("data", F.expr(f"substring(payload, chunk_no * {int(chunk_bytes)} + 1, {int(chunk_bytes)})"))
        .drop("payload")
    )
    schema = StructType([f for f in sliced.schema if f.name != "data"]).add("data", BinaryType()).add("digest_so_far", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = hashlib.sha1()
        for batch in batches:
            data, digests = [], []
            for chunk_no, raw in zip(batch.column("chunk_no").to_pylist(), batch.column("data").to_pylist()):
                if chunk_no == 0:
                    running = hashlib.sha1()
                running.update(raw)
                member = zlib.compressobj(4, zlib.DEFLATED, GZIP)
                data.append(member.compress(raw) + member.flush())
                digests.append(base64.b32encode(running.digest()).decode())
            keep = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(data, pa.binary()), pa.array(digests, pa.string())], names=schema.names)

    return sliced.mapInArrow(run, schema)


def write_archive(pages: DataFrame, path: str, chunk_bytes: int = 1 << 18, least_bytes: int = 0, date: str = "2024-01-31T00:00:00Z") -> None:
    """Writes one WARC record per page as chunk rows to a new folder.

    Among pages of equal payloads of at least `least_bytes`, the one with the largest `page_id` is a response record, the others are revisit
    records that name it and store no payload; smaller payloads are all responses. A row of the table is (`record_id`,
    `page_id`, `chunk_no`, `n_chunks`, `header` at chunk 0, `data`, `digest_so_far`): the header, the chunks' gzip members in order and
    two line ends are a compressed WARC record. `pages` has `page_id`, `url`, `html`; other columns are not stored.

    A null payload is empty. A null url leaves out the target line; blanks and control characters in it are escaped. Pages
    without an id are responses that nothing refers to. Rows that repeat both id and payload are one record. No rows give an
    empty archive.
    """
    # Digests alone find the response of each payload; equal payloads meet as counts before the shuffle.
    firsts = (
        pages.select("page_id", _payload().alias("payload"))
        .where(F.col("page_id").isNotNull() & (F.octet_length("payload") >= least_bytes))
        .select("page_id", base32_of_hex(F.sha1("payload")).alias("digest"))
        .groupBy("digest").agg(F.max("page_id").alias("response"))
    )
    record_id = lambda page: F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(":page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("response").isNotNull() & F.col("page_id").isNotNull() & (F.col("response") != F.col("page_id")) & (
        F.col("payload_bytes") >= least_bytes)
    target = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("is_revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        F.when(F.col("is_revisit"), F.concat(
            line("WARC-Refers-To", record_id(F.col("response"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(F.col("is_revisit"), F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
    )
    (
        chunk_rows(pages, chunk_bytes)
        .join(firsts, "digest", "left")
        .withColumn("is_revisit", revisit)
        .where(~F.col("is_revisit") | (F.col("chunk_no") == 0))
        .withColumn("record_id", record_id(F.col("page_id")))
        .select(
            "record_id", "page_id", "chunk_no", F.when(F.col("is_revisit"), 1).otherwise(F.col("n_chunks")).alias("n_chunks"),
            F.when(F.col("chunk_no") == 0, header).alias("header"),
            F.when(~F.col("is_revisit"), F.col("data")).alias("data"), F.when(~F.col("is_revisit"), F.col("digest_so_far")).alias("digest_so_far"),
        )
        .write.option("compression", "uncompressed").parquet(path)
    )


def _header_value(name: str) -> Column:
    return F.nullif(F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Reads an archive chunk by chunk and measures every record.

    Returns `record_id`, `page_id`, `record_type`, `payload_bytes` and `payload_digest` (of the decompressed chunks; null for
    revisits), `refers_to` (a record id), `stated_digest`. Records of one chunk are measured where they lie; the chunks of longer ones come
    together in order, and only the running digest is kept between them. A chunk whose running digest differs from the stored
    one, or a missing chunk, ends the job with an error.
    """
    rows = spark.read.parquet(path)
    parted = rows.where("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no")
    schema = StructType([rows.schema["record_id"], rows.schema["page_id"]]).add("header", StringType())
    schema = schema.add("payload_bytes", LongType()).add("payload_digest", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, size, running, expected = None, 0, hashlib.sha1(), 0
        for batch in batches:
            out = []
            for record_id, page_id, chunk_no, n_chunks, header, data, so_far in zip(*(c.to_pylist() for c in batch.columns)):
                if chunk_no == 0 and (record_id != record or expected != 1):
                    record, first, size, running, expected = record_id, header, 0, hashlib.sha1(), 0
                if chunk_no == expected - 1 and record_id == record:
                    continue  # a repeated row of the table
                if record_id != record or chunk_no != expected:
                    raise ValueError(f"{record_id}: chunk {expected} is missing")
                expected += 1
                raw = zlib.decompress(data, GZIP) if data is not None else b""
                size += len(raw)
                running.update(raw)
                digest = base64.b32encode(running.digest()).decode()
                if data is not None and digest != so_far:
                    raise ValueError(f"{record_id}: chunk {chunk_no} is damaged")
                if expected == n_chunks:
                    stored = data is not None
                    out.append((record_id, page_id, first, size if stored else None, digest if stored else None))
            kinds = [batch.column(0).type, batch.column(1).type, pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=schema.names)

    names = ["record_id", "page_id", "chunk_no", "n_chunks", "header", "data", "digest_so_far"]
    single = rows.where("n_chunks = 1").select(names).mapInArrow(run, schema)
    measured = single.unionByName(parted.select(names).mapInArrow(run, schema))
    return measured.select(
        "record_id", "page_id", _header_value("WARC-Type").alias("record_type"), "payload_bytes", "payload_digest",
        _header_value("WARC-Refers-To").alias("refers_to"), F.regexp_replace(_header_value("WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
        _header_value("Content-Length").cast("long").alias("stated_bytes"),
    )


def resolve(records: DataFrame) -> DataFrame:
    """Every record with the size and digest of its full payload; a revisit takes those of the response it names.

    Returns `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to` (the response's `page_id`). A response
    whose measures differ from its header, or a revisit without its response, has a null digest.
    """
    responses = records.where("record_type = 'response'").where("payload_bytes = stated_bytes and payload_digest = stated_digest")
    own = responses.groupBy("record_id", "page_id").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    own = own.select("record_id", F.col("page_id").alias("of_page"), "payload_bytes", "payload_digest")
    named = records.select(
        "page_id", "record_id", "record_type", F.coalesce("refers_to", "record_id").alias("at"),
    ).distinct()
    return named.join(own.withColumnRenamed("record_id", "at"), "at", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", F.col("of_page")).alias("refers_to"),
    )
