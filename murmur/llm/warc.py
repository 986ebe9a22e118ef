"""Web archives: legacy ARC files converted to WARC records, equal payloads written once, archives read back.

An ARC file opens with a "filedesc:" record whose block names the version and the fields of every later header line: five
in version 1 (URL, IP address, date, type, length), ten in version 2 (result code, checksum, location, offset and file name
before the length). A record is its header line, as many bytes as the length declares, and a newline. records_of_arc() reads
these in order; what the header line and the block say becomes the WARC record's fields:

    WARC-Record-ID       a name-based UUID of URL, date and block, so that another run gives the same
    WARC-Date            the 14 digits (shorter ones filled up) as an ISO 8601 time
    WARC-Type            warcinfo for filedesc records, response for HTTP blocks and dns: URLs, else resource
    WARC-Payload-Digest  sha1: and base32, of what follows the HTTP header; WARC-Block-Digest of the whole block

Of responses with equal payloads (digest and length) the first stays a response; the others become revisits, whose block is
the HTTP header alone and which name the first by WARC-Refers-To. Decisions are made on digests: an aggregate per payload,
merged before its shuffle, is joined back to the index of records, whose hot payloads adaptive execution splits as they
only stream past; then records meet their decisions by their own ids, evenly, in as many partitions as keep each archive
near ARCHIVE_BYTES. Every partition becomes one archive through Spark's text writer (each record ends with the newline that
the writer adds), so tasks that fail or run twice leave no half archive; files are compressed as a whole.

read_archives() reads archives as binary files, unpacks them as a stream, and checks digests. resolved() gives revisits
the id and the payload's length of the record they refer to.

Cases: null html is an empty payload, null URLs become "urn:none"; blanks and control characters in URLs are percent-encoded;
a null id is no id: it comes last in its payload's order, so it revisits one that has an id, and where no record has an id all
are responses. Rows that share the smallest id of a payload, repeated rows included, are all responses. Texts are
written whole; an empty table gives no archive and no rows; extra columns are dropped. In ARC files of other makers, lines between records
that are no header line are passed over, and a record that its file cuts short is kept and marked as truncated.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.common import bounded, free, read, shared_dir, written

#: Bytes of an ARC archive made from pages, and of payloads in a WARC archive (before compression), about.
ARC_BYTES, ARCHIVE_BYTES = 8 << 20, 64 << 20
#: Payloads shorter than this are written every time.
LEAST_BYTES = 0
# The fields of a header line by version, and the profile of revisits.
FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "code", "checksum", "location", "offset", "file", "length")}
TITLES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The HTTP header that carries a page's id.
ID_HEADER = "X-Page-Id"
DATE = "20240101000000"

_ID = re.compile(rb"(?im)^" + ID_HEADER.encode() + rb":[ \t]*([^\r\n]*)")


def base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def arc_line(version: int, **fields) -> bytes:
    return (" ".join(str(fields.get(f, "-")) for f in FIELDS[version]) + "\n").encode()


def arc_head(version: int, name: str, date: str) -> bytes:
    """The filedesc record that opens an archive."""
    block = f"{version} 0 murmur\n{TITLES[version]}\n\n".encode()
    return arc_line(version, url=f"filedesc://{name}", ip="0.0.0.0", date=date, mime="text/plain", code=200, offset=0, file=name, length=len(block)) + block + b"\n"


def arc_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """(path, content): pages as ARC archives of bounded size, versions 1 and 2 in turn, each page an HTTP response."""
    bounded(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, k = [], 0, 0
        own = uuid.uuid4().hex
        name = lambda: f"{own}-{k:05d}.arc"
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([name()]), pa.array([b"".join(held)], pa.binary())], ["path", "content"])
        for batch in batches:
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = 1 + k % 2
                if not held:
                    held.append(arc_head(version, name(), date))
                    size = len(held[0])
                mark = b"" if key is None else f"{ID_HEADER}: {key}\r\n".encode()
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (mark, len(html), html)
                safe = re.sub(r"[\x00-\x20\x7f-\xa0]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "urn:none")
                held += [arc_line(version, url=safe, ip="0.0.0.0", date=date, mime="text/html", code=200, offset=size, file=name(), length=len(block)), block, b"\n"]
                size += sum(map(len, held[-3:]))
                if size >= ARC_BYTES:
                    yield pack()
                    held, size, k = [], 0, k + 1
        if held:
            yield pack()

    html = F.coalesce(F.col(html_col).cast("binary"), F.lit(b"").cast("binary"))
    return pages.select(F.col(id_col).cast("string").alias("i"), F.col(url_col).alias("u"), html.alias("h")).mapInArrow(run, "path string, content binary")


def unpacked(content: bytes) -> io.BufferedIOBase:
    """A stream of an archive's bytes, gzip members one after the other unpacked."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def records_of_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of an ARC archive, the filedesc record first; a block shorter than its declared length
    was cut by the archive's end."""
    stream, version = unpacked(content), 1
    while line := stream.readline():
        names = FIELDS[version]
        words = line.rstrip(b"\r\n").split(b" ")
        if line.startswith(b"filedesc:"):
            names = FIELDS[2] if len(words) == len(FIELDS[2]) else FIELDS[1]
        if len(words) < len(names) or not words[-1].isdigit() or b":" not in words[0]:
            continue  # a blank line, or none of this version's
        words = [b"%20".join(words[: len(words) - len(names) + 1]), *words[len(words) - len(names) + 1 :]]  # only URLs hold blanks
        fields = dict(zip(names, (w.decode("utf-8", "replace") for w in words), strict=True))
        block = stream.read(int(fields["length"]))
        if fields["url"].startswith("filedesc:"):
            version = 2 if block.split(b" ", 1)[0].strip() == b"2" else 1
        yield fields, block


def iso(date: str) -> str:
    """A date of 4 to 14 digits as a UTC time; what is not a date as the epoch."""
    d = (date + "00000101000000"[len(date) :])[:14] if date.isdigit() and 4 <= len(date) <= 14 and len(date) % 2 == 0 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


RECORD = [("record_id", pa.string()), ("warcinfo_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("page_id", pa.string()),
          ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block_digest", pa.string()), ("head_digest", pa.string()), ("truncated", pa.bool_())]
BLOCK = [("head", pa.binary()), ("payload", pa.binary())]


def synthesised(fields: dict[str, str], block: bytes, info: str) -> tuple:
    """The values of RECORD and BLOCK for a record of an ARC archive."""
    url, mime = fields["url"], fields["mime"]
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    head, payload = (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)
    whole = base32(block)
    if url.startswith("filedesc:"):
        kind, mime = "warcinfo", "application/warc-fields"
        head, payload = b"", f"software: murmur\r\nformat: WARC File Format 1.1\r\nisPartOf: {url[11:]}\r\ndescription: {block.split(bytes([10]), 1)[0].decode('utf-8', 'replace').strip()}\r\n".encode()
        whole = base32(payload)
    elif end >= 0:
        kind, mime = "response", "application/http; msgtype=response"
    else:
        kind = "response" if url.startswith("dns:") else "resource"
        mime = mime if "/" in mime else "application/octet-stream"
    own = info if kind == "warcinfo" else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join((url, fields['date'], whole)))}>"
    found = _ID.search(head)
    ip = fields["ip"] if fields["ip"] not in ("-", "0.0.0.0") else None
    cut = kind != "warcinfo" and len(block) < int(fields["length"])
    return own, None if kind == "warcinfo" else info, kind, iso(fields["date"]), url, ip, mime, found and found[1].decode(), len(payload), base32(payload), whole, base32(head), cut, head, payload


def convert(archives: DataFrame, blocks: bool = True) -> DataFrame:
    """The WARC records (RECORD, and with blocks the HTTP header and the payload) of ARC archives (path, content), which may be
    packed by gzip as a whole or record by record, as spark.read.format("binaryFile") gives them."""
    bounded(archives.sparkSession)
    columns = RECORD + BLOCK if blocks else RECORD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(columns)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                info = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"
                held, size = [], 0
                for fields, block in records_of_arc(content.as_py()):
                    held.append(synthesised(fields, block, info)[: len(columns)])
                    size += len(block)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.bool_(): "boolean", pa.binary(): "binary"}
    return archives.select("path", "content").mapInArrow(run, ", ".join(f"{c} {kinds[t]}" for c, t in columns))


def revisits(index: DataFrame, order: Column, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(record_id, target, target_uri, target_date) of the responses in an index of records whose payload an earlier one has,
    by an order column; those that share the first place are no revisits, and nulls come last."""
    some = index.where((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes)).withColumn("place", order)
    payload = ("payload_digest", "payload_bytes")
    first = some.groupBy(*payload).agg(F.count("*").alias("n"), F.min("place").alias("first"), F.min_by(F.struct("record_id", "uri", "date"), F.when(F.col("place").isNotNull(), F.struct("place", "record_id"))).alias("t"))
    first = written(first.where("n > 1 and first is not null").select(F.col(payload[0]).alias("d"), F.col(payload[1]).alias("b"), "first", "t"), "warc-first")
    later = some.select("record_id", "place", *payload).join(first, (F.col(payload[0]) == F.col("d")) & (F.col(payload[1]) == F.col("b")))
    return later.where(~F.col("place").eqNullSafe(F.col("first"))).select("record_id", F.col("t.record_id").alias("target"), F.col("t.uri").alias("target_uri"), F.col("t.date").alias("target_date"))


def serialised(revisit: Column) -> Column:
    """A record (RECORD, BLOCK, target columns) as the bytes of a WARC file, without the very last newline."""
    head, payload = F.col("head"), F.col("payload")
    only_http = lambda a, b: F.when(revisit, a).otherwise(b)
    field = lambda name, value, *before: F.concat(F.lit(f"{name}: "), *(F.lit(x) for x in before), value.cast("string"))
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), field("WARC-Type", only_http(F.lit("revisit"), F.col("type"))), field("WARC-Record-ID", F.col("record_id")), field("WARC-Date", F.col("date")),
        F.when(F.col("type") == "warcinfo", field("WARC-Filename", F.substring_index("uri", "/", -1))).otherwise(field("WARC-Target-URI", F.col("uri"))),
        field("WARC-IP-Address", F.col("ip")), field("WARC-Warcinfo-ID", F.col("warcinfo_id")), F.when(F.col("truncated"), F.lit("WARC-Truncated: length")),
        F.when(revisit, F.concat_ws("\r\n", F.lit(f"WARC-Profile: {PROFILE}"), field("WARC-Refers-To", F.col("target")), field("WARC-Refers-To-Target-URI", F.col("target_uri")), field("WARC-Refers-To-Date", F.col("target_date")))),
        field("WARC-Payload-Digest", F.col("payload_digest"), "sha1:"), field("WARC-Block-Digest", only_http(F.col("head_digest"), F.col("block_digest")), "sha1:"),
        field("Content-Type", F.col("mime")), field("Content-Length", F.octet_length(head) + only_http(F.lit(0), F.octet_length(payload))), F.lit("\r\n"),
    )
    return F.concat(lines.cast("binary"), head, only_http(F.lit(b"").cast("binary"), payload), F.lit(b"\r\n\r").cast("binary"))


def write_archives(archives: DataFrame, path: str, order: Column | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """Convert ARC archives to WARC archives in a new folder. order: what makes a response of equal ones the first (by default
    the number in its ID_HEADER)."""
    order = F.expr("try_cast(page_id as bigint)") if order is None else order
    index = written(convert(archives, blocks=False), "warc-index")
    n = ceil(index.agg(F.coalesce(F.sum(F.col("payload_bytes") + 512), F.lit(1))).first()[0] / ARCHIVE_BYTES)
    x = free(index)
    later = revisits(index, order, least_bytes).withColumnRenamed("record_id", f"{x}id").repartition(n, f"{x}id").dropDuplicates([f"{x}id"])
    records = convert(archives).repartition(n, "record_id").join(later.hint("shuffle_hash"), F.col("record_id") == F.col(f"{x}id"), "left")
    records.select(serialised(F.col("target").isNotNull()).cast("string").alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def records_of_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of a WARC archive."""
    stream = unpacked(content)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError(f"record {fields.get('warc-record-id')} ends after {len(block)} of {size} bytes")
        yield fields, block


READ = "record_id string, type string, date string, uri string, page_id string, payload_bytes bigint, payload_digest string, refers_to string, intact boolean"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC archives in a folder. payload_bytes of revisits is null; intact: digests are those of the bytes."""
    bounded(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.string(), pa.bool_()]
        names = [c.split()[0] for c in READ.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in records_of_warc(content.as_py()):
                    end = block.find(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else -1
                    head, payload = (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)
                    again, said = fields["warc-type"] == "revisit", fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    intact = fields.get("warc-block-digest", "").removeprefix("sha1:") == base32(block) and (again or said == base32(payload))
                    found = _ID.search(head)
                    rows.append((fields["warc-record-id"], fields["warc-type"], fields["warc-date"], fields.get("warc-target-uri"), found and found[1].decode(), None if again else len(payload), said, fields.get("warc-refers-to"), intact))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READ)


def resolved(records: DataFrame) -> DataFrame:
    """records (a written table) with target_page: the page id of the response that a revisit refers to, whose payload's
    length it takes. Responses have one row for each record id here, so that none multiplies a revisit."""
    first = records.where("type = 'response'").groupBy(F.col("record_id").alias("__id")).agg(F.first("page_id").alias("target_page"), F.first("payload_bytes").alias("__bytes"))
    both = records.join(written(first, "warc-responses"), F.col("refers_to") == F.col("__id"), "left")
    return both.withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes")).drop("__id", "__bytes")


def op12_warc(spark, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/murmur/warc-{uuid.uuid4().hex}"
    write_archives(arc_archives(read(spark, sf_dir, "pages")), at)
    records = written(read_archives(spark, at).where("type in ('response', 'revisit')"), "warc-records")
    return resolved(records).select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("target_page").cast("long").alias("refers_to"))


SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS first, sha1(h) AS s FROM p)
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, (1 + i // 4 * 5)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f"""
