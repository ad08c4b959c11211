"""Web archives: writing, reading, and resolving revisits by payload digest.

Archives are real WARC/1.1 files, compressed with gzip.  They are written by
Spark's own text sink: a record is its header block, an empty line and its
content block, and the two CRLF that end a record are the sink's line
separator.  So writing stays in the JVM, goes to any file system that Spark
knows, and is committed and retried like any other output.  The sink compresses
files as one gzip member, not one for each record, so readers can't seek to one.

Revisits are found from headers alone (record, digest, length), which are
shuffled by payload digest and pre-aggregated, so that a digest that a third of
all records share costs one row for each task.  Payloads are moved once, by record.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, shared_folder, table, written

#: Payloads below this many bytes are always written in full.
LEAST_BYTES = 100
#: Bytes of payload that an archive is to hold; a reader takes an archive whole.
ARCHIVE_BYTES = 128 << 20
PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def page_records(pages: DataFrame) -> DataFrame:
    """``record, page_id, url, http, payload, payload_digest, payload_bytes, date`` of each page (null html: empty).

    ``record`` names the page and the payload; only rows that repeat both share it.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=UTF-8{EOL}Content-Length: "), F.octet_length(body).cast("string"), F.lit(EOL * 2))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), http.cast("binary").alias("http"), body.alias("payload"), F.sha2(body, 256).alias("payload_digest"), page.alias("_page"))
    record = F.concat(F.lit("<urn:page:"), F.col("_page"), F.lit(":"), F.left("payload_digest", F.lit(16)), F.lit(">"))
    return rows.select(record.alias("record"), "page_id", "url", "http", "payload", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.lit(None).cast("string").alias("date"))


def _kind(records: DataFrame) -> Column:
    return F.col("record_type") if "record_type" in records.columns else F.lit("response")


def headers(records: DataFrame) -> DataFrame:
    """What revisits are found by: no payload."""
    old = F.col("refers_to_record") if "refers_to_record" in records.columns else F.lit(None).cast("string")
    return records.select("record", "page_id", "url", "payload_digest", "payload_bytes", _kind(records).alias("record_type"), old.alias("refers_to_record"))


def find_revisits(found: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``record, payload_digest, record_type, refers_to_record, refers_to_url, n`` of ``headers`` that don't become plain responses.

    Of responses with equal payloads of at least ``least_bytes``, the smallest page_id
    is the original (ties and pages without id: the smallest record; a null page_id is
    an original only where all are null), with all rows of that page_id.  The others become revisits
    of it, and so do old revisits of the same payload, whatever its length.  An old revisit whose
    original isn't there keeps what it refers to.  ``n`` is how many rows share a record.
    """
    response = F.col("record_type") == "response"
    order = F.struct(F.col("page_id").isNull(), "page_id", "record", "url")
    originals = found.where(response).groupBy("payload_digest").agg(F.min(order).alias("o"), F.max("payload_bytes").alias("size"))
    originals = originals.select("payload_digest", "size", F.col("o.page_id").alias("first_page"), F.col("o.record").alias("first"), F.col("o.url").alias("first_url"))
    rows = found.groupBy("record", "page_id", "payload_digest", "record_type", "refers_to_record").agg(F.count("*").alias("n")).join(originals, "payload_digest", "left")
    own = F.coalesce(F.col("page_id") == F.col("first_page"), F.lit(False)) | (F.col("record") == F.col("first"))
    again = response & (F.col("size") >= least_bytes) & ~own
    resolved = ~response & F.col("first").isNotNull()
    refers = F.when(again | resolved, F.col("first")).when(~response, F.coalesce("refers_to_record", F.lit("<urn:page:unknown>")))
    out = rows.select("record", "payload_digest", "record_type", refers.alias("refers_to_record"), F.when(again | resolved, F.col("first_url")).alias("refers_to_url"), "n")
    return out.where("refers_to_record is not null or n > 1").groupBy("record", "payload_digest", "record_type").agg(F.min("refers_to_record").alias("refers_to_record"), F.min("refers_to_url").alias("refers_to_url"), F.sum("n").alias("n"))


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing where the value is null; line ends in it are escaped."""
    value = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def write_records(records: DataFrame, path: str, revisits: DataFrame | None = None, date: str | None = None, records_per_archive: int = 0) -> None:
    """Write each record to gzip archives in ``path``, under fresh headers.

    Those in ``revisits`` become revisit records without payload.  A record's
    ``date`` is kept, ``date`` (or now, if not given) is that of records without one.
    Records that share their name get a number after it, so that ids are unique; what refers to
    them names what they share.  A null url leaves out the target header.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = records.select("record", "url", "http", "payload", "payload_digest", _kind(records).alias("record_type"), F.col("date").cast("string").alias("date"))
    if revisits is None:
        rows = rows.withColumns({"refers_to_record": F.lit(None).cast("string"), "refers_to_url": F.lit(None).cast("string"), "n": F.lit(1)})
    else:
        rows = rows.join(revisits, ["record", "payload_digest", "record_type"], "left")
    is_revisit = F.col("refers_to_record").isNotNull()
    # Records that can't be told apart get any number that nothing else has.
    number = F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"), F.lit(">"))
    name = F.when(F.col("n") > 1, F.concat(F.rtrim(F.col("record"), F.lit(">")), number)).otherwise(F.col("record"))
    rows = rows.withColumn("block", F.concat("http", F.when(is_revisit, F.lit(b"")).otherwise(F.coalesce("payload", F.lit(b"")))))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _header("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", name),
        _header("WARC-Date", F.coalesce("date", F.lit(date))),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _header("WARC-Profile", F.when(is_revisit, PROFILE)),
        _header("WARC-Refers-To", F.col("refers_to_record")),
        _header("WARC-Refers-To-Target-URI", F.col("refers_to_url")),
        F.lit(f"Content-Type: application/http; msgtype=response{EOL}"),
        _header("Content-Length", F.octet_length("block").cast("string")),
        F.lit(EOL),
    )
    text = F.concat(head.cast("binary"), F.col("block")).cast("string")
    rows.select(text.alias("value")).write.option("lineSep", EOL * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_archive).text(path)


def records_per_archive(found: DataFrame, size: int = ARCHIVE_BYTES) -> int:
    """How many records of the mean length an archive of ``size`` bytes holds."""
    mean = found.agg(F.avg(F.coalesce("payload_bytes", F.lit(0)) + 500)).first()[0]
    return max(1, int(size / (mean or size)))


def write_archives(pages: DataFrame, path: str, date: str | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each page (``page_id, url, html``), later repeats of a payload as revisits.

    Null html is an empty payload, and a page's payload may be of any length up to what a
    row can hold; extra columns are ignored.  An empty table writes archives without records.
    """
    records = page_records(pages)
    found = written(headers(records), "headers")
    write_records(records, path, find_revisits(found, least_bytes), date, records_per_archive(found))


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and content block of each record of a plain or gzip stream."""
    buffered = io.BufferedReader(stream)  # type: ignore[type-var]
    source = gzip.GzipFile(fileobj=buffered) if buffered.peek(2)[:2] == b"\x1f\x8b" else buffered
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the start of a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := source.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block = source.read(length)
        if len(block) != length:
            raise EOFError("the archive ends within a record")
        yield headers, block


def _page_of(name: str | None) -> int | None:
    """The page_id in a record's name, if it's one of ours."""
    parts = (name or "").strip("<>").split(":")
    return int(parts[2]) if parts[:2] == ["urn", "page"] and len(parts) > 2 and parts[2].lstrip("-").isdigit() else None


_READ = pa.schema(
    [("record", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to_record", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("date", pa.string())]
    + [("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("http", pa.binary()), ("payload", pa.binary())]
)
_READ_DDL = "record string, page_id long, record_type string, refers_to_record string, refers_to long, url string, date string, payload_digest string, payload_bytes long, http binary, payload binary"


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _READ)], schema=_READ)

    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for fields, block in parse_archive(io.BytesIO(content.as_buffer())):
                kind = fields.get("warc-type")
                if kind not in ("response", "revisit"):
                    continue
                http, mark, body = block.partition(b"\r\n\r\n")
                name, old = fields.get("warc-record-id"), fields.get("warc-refers-to")
                digest, size = fields.get("warc-payload-digest", "").rpartition(":")[2].lower() or None, None
                if kind == "response":
                    size, said = len(body), digest
                    digest = hashlib.sha256(body).hexdigest()
                    # Digests of other kinds, as sha1, are replaced.
                    if said and len(said) == len(digest) and said != digest:
                        raise ValueError(f"payload of {name} has digest {digest}, its header says {said}")
                rows.append((name, _page_of(name), kind, old, _page_of(old), fields.get("warc-target-uri"), fields.get("warc-date"), digest, size, http + mark if with_payload else None, body if with_payload and kind == "response" else None))
                held += len(block) if with_payload else 200
                if held > 8 << 20:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)


def _read_headers(batches):
    return _read(batches, False)


def _read_all(batches):
    return _read(batches, True)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The response and revisit records of the archives in ``path``; other records are passed over.

    Payload digests are computed anew and must equal the headers' where those are
    of the same kind.  Revisits have a digest but neither payload nor payload_bytes; see
    ``resolve_revisits``.  ``page_id`` and ``refers_to`` are null for records that
    weren't written here.  An archive is read by one task, so archives should
    be a few hundred MB at most; ``write_archives`` bounds what it writes.
    """
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read_all if with_payload else _read_headers, _READ_DDL)


def _shared_name(record: str) -> Column:
    """A record's name without the number that tells it from others of that name."""
    return F.regexp_replace(record, r"^(<urn:page:[^:>]*:[^:>]*):[0-9]+>$", "$1>")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit its original's ``payload_bytes``, joined by name and digest.

    A revisit whose original is not there keeps null.  Where the original has
    many revisits, the join's skewed side can be split.
    """
    originals = (
        records.where("record_type = 'response' and record is not null")
        .groupBy(_shared_name("record").alias("refers_to_record"), "payload_digest")
        .agg(F.max("payload_bytes").alias("payload_bytes"))
    )
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(originals, ["refers_to_record", "payload_digest"], "left")
    return records.where("record_type = 'response'").unionByName(revisits)


def deduplicate_archives(spark: SparkSession, source: str, target: str, least_bytes: int = LEAST_BYTES) -> None:
    """Read archives, and write every record again: later repeats of a payload as revisits of the first.

    Revisits stay revisits: those whose payload is there refer to its original, whatever they
    referred to, and the others to what they did.  So there are as many records as before.
    Records without an id get one of their payload.
    """
    read = read_archives(spark, source, with_payload=True)
    records = written(read.withColumn("record", F.coalesce(_shared_name("record"), F.concat(F.lit("<urn:page:none:"), F.left(F.coalesce("payload_digest", F.lit("")), F.lit(16)), F.lit(">")))), "records")
    found = headers(records)
    write_records(records, target, find_revisits(found, least_bytes), None, records_per_archive(found))


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives; see ``write_archives`` for the edge cases."""
    path = shared_folder(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = written(read_archives(spark, path).drop("payload", "http", "url", "date"), "records")
    return resolve_revisits(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), h AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM h
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM m
"""
