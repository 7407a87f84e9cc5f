"""WARC archives: writing with revisits and segments, and reading segmented records together again.

A page becomes an HTTP response with chunked transfer framing in a WARC/1.1 response record; a
payload equal to that of another page becomes a revisit record. A record longer than a segment is
cut: the first segment keeps the type, continuation records follow under their own ids and name
the origin, their number and, on the last one, the total length. Archives are gzip text files,
written by Spark to the cluster's shared folder and so safe against lost tasks.

Reading parses each file as a stream of records by their Content-Length, brings the segments of
cut records together by origin, orders them by number, verifies count and total length, and takes
off the chunked framing. Whole records are decoded where they are read.

Defined results: a null html is an empty payload. Pages with the same id and payload are equal in
rank: all copies of the smallest id are responses. A null id cannot be referred to; it sorts after
all others. Extra columns are left out. Records with missing or damaged segments are returned with
a null payload and complete = false, never dropped.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewgraph.llm.batches import bounded_batches
from reviewgraph.llm.store import shared_folder

MIN_REVISIT_BYTES = 100
SEGMENT_BYTES = 32_768
CHUNK_BYTES = 4_096
# How many payload bytes go into one archive file, about.
ARCHIVE_BYTES = 8_000_000
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of about this size that end between UTF-8 characters: archives are text files."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        yield data[at:end]
        at = end


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    return b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cuts(payload, size)) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises ValueError where the framing is unsound."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    told = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"{VERSION}\r\n{told}\r\n".encode() + block + b"\r\n\r\n"


def _uri(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def page_records(page_id: int | None, url: str, payload: bytes, refers_to: int | None,
                 unique: str, segment: int = SEGMENT_BYTES) -> bytes:
    """The records of one page, one after another."""
    digest = hashlib.sha256(payload).hexdigest()
    origin = _uri(unique)
    named = [("WARC-Date", DATE), ("WARC-Target-URI", url.replace("\r", "").replace("\n", "")),
             ("WARC-Payload-Digest", f"sha256:{digest}"),
             ("X-Page-Id", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        return _record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *named,
                        ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", str(refers_to)),
                        ("Content-Type", "application/http; msgtype=response")], block)
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload))
    own = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *named,
           ("Content-Type", "application/http; msgtype=response")]
    parts = list(_cuts(block, segment))
    if len(parts) == 1:
        return _record(own, block)
    out = [_record([*own, ("WARC-Segment-Number", "1")], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if n == len(parts) else []
        out.append(_record([("WARC-Type", "continuation"),
                            ("WARC-Record-ID", _uri(unique, n)), ("WARC-Date", DATE),
                            ("WARC-Segment-Origin-ID", origin),
                            ("WARC-Segment-Number", str(n)), *last], part))
    return b"".join(out)


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, digest and refers_to of the pages that repeat another's payload (page_id, html)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    digests = (pages.where(F.octet_length(payload) >= min_bytes)
               .select("page_id", F.sha2(payload, 256).alias("digest")))
    firsts = (digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"),
                                            F.count(F.lit(1)).alias("n"))
              .where((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n"))
    return (digests.join(firsts, "digest")
            .where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct())


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", segment: int = SEGMENT_BYTES) -> None:
    """Gzip archives of all pages below path."""
    spark = pages.sparkSession
    bounded_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    again = revisits(rows)
    again = again.select(F.col("page_id").alias("again"), F.col("digest").alias("like"),
                         "refers_to")
    typed = (rows.join(again, F.col("page_id").eqNullSafe(F.col("again"))
                       & (F.sha2("html", 256) == F.col("like")), "left")
             .select("page_id", "url", "html", "refers_to", F.expr("uuid()").alias("unique")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                page_id, url, html, refers_to, unique = row
                data = page_records(page_id, url, html.encode("utf-8", "surrogatepass"),
                                    refers_to, unique, segment)
                out.append(data[:-4].decode("utf-8"))  # the line ends are the writer's
                held += len(data)
                if held > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                    out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    records = typed.mapInArrow(run, "value string")
    (records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", 2000).text(path))


def parse_records(data: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of one archive."""
    while True:
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        headers = {}
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, data.read(int(headers["content-length"]))


def _opened(block: bytes) -> bytes | None:
    """The payload of an HTTP response; None where it is cut short or unsound."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    try:
        return unchunked(body)
    except ValueError:
        return None


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(),
             "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


RECORDS = ("origin string, number int, total long, page_id long, record_type string,"
           " refers_to long, told_digest string, told_bytes long, segmented boolean, block binary")
_FIELDS = _names(RECORDS)


def _fields(headers: dict[str, str], block: bytes) -> tuple:
    def number(name: str) -> int | None:
        return int(headers[name]) if headers.get(name) else None

    kind = headers.get("warc-type")
    told = None
    if kind == "revisit":
        for line in block.split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                told = int(line.split(b":")[1])
    return (headers.get("warc-segment-origin-id") or headers.get("warc-record-id"),
            number("warc-segment-number") or 1, number("warc-segment-total-length"),
            number("x-page-id"), kind, number("x-refers-to-page"),
            headers.get("warc-payload-digest", "").partition(":")[2] or None, told,
            "warc-segment-number" in headers, None if kind == "revisit" else block)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each response, revisit and continuation record, segments apart."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow(RECORDS)
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                raw = content.as_py()
                opened = gzip.GzipFile(fileobj=io.BytesIO(raw)) if raw[:2] == b"\x1f\x8b" else \
                    io.BytesIO(raw)
                for headers, block in parse_records(io.BufferedReader(opened, 1 << 16)):
                    rows.append(_fields(headers, block))
                    held += len(block)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(
                            [dict(zip(_FIELDS, r)) for r in rows], schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(_FIELDS, r)) for r in rows], schema)

    return files.mapInArrow(run, RECORDS)


PAGES = ("page_id long, record_type string, refers_to long, payload_bytes long,"
         " payload_digest string, payload binary, complete boolean")


def _page(first: tuple | None, block: bytes | None) -> tuple:
    """The row of a whole record; first has its fields, block all its segments."""
    page_id, kind, refers_to, told_digest, told_bytes = first or (None,) * 5
    if kind == "revisit":
        return page_id, kind, refers_to, told_bytes, told_digest, None, True
    payload = None if block is None else _opened(block)
    if payload is None:
        return page_id, kind or "response", refers_to, None, told_digest, None, False
    digest = hashlib.sha256(payload).hexdigest()
    return (page_id, kind, refers_to, len(payload), digest, payload,
            told_digest in (None, digest))


def reassembled(records: DataFrame) -> DataFrame:
    """A row for each page: its payload out of all its segments and the chunked framing.

    Segments move by origin and number and are streamed in that order, so that a task holds one
    record's segments, however many records one archive or one site has.
    """
    fields = ["origin", "number", "total", "page_id", "record_type", "refers_to", "told_digest",
              "told_bytes", "block"]
    names, schema = _names(PAGES), _arrow(PAGES)

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema)

    def typed(row: dict) -> tuple:
        return tuple(row[x] for x in ("page_id", "record_type", "refers_to", "told_digest",
                                      "told_bytes"))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield frame([_page(typed(r), r["block"]) for r in batch.to_pylist()])

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        origin, held = None, []

        def done() -> tuple:
            numbers = [r["number"] for r in held]
            block = b"".join(r["block"] for r in held)
            sound = (numbers == list(range(1, len(held) + 1)) and held[-1]["total"] == len(block))
            first = typed(held[0]) if numbers[0] == 1 else None
            return _page(first, block if sound else None)

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and row["origin"] != origin:
                    out.append(done())
                    held = []
                origin = row["origin"]
                held.append(row)
            yield frame(out)
        if held:
            yield frame([done()])

    single = records.where(~F.col("segmented")).select(*fields).mapInArrow(whole, PAGES)
    cut = (records.where("segmented").select(*fields).repartition("origin")
           .sortWithinPartitions("origin", "number").mapInArrow(joined, PAGES))
    return single.unionByName(cut)


def archived_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                      html_col: str = "html") -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    path = shared_folder(pages.sparkSession)
    write_archives(pages, path, id_col, url_col, html_col)
    return reassembled(read_records(pages.sparkSession, path))
