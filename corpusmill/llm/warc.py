"""WARC derivatives: metadata and plain-text conversion records of responses.

A response record gives two derivatives. The conversion record holds the
visible text of the payload as UTF-8; the metadata record holds link and size
fields as ``application/warc-fields``. Both carry WARC-Refers-To (the response's
record id), its target URI and date, and a block digest of their own; the
conversion keeps the source's digests and HTTP headers in warcinfo-style fields
of the metadata record. Record ids are name-based; a page's place in the scan is
part of its name, so that repeated rows have ids of their own and a rerun over
the same files gives the same ids.

A payload is read as its headers say: chunks are joined, gzip and deflate are
undone, and text is decoded by the byte order mark, the charset of Content-Type
or of a meta element, and else as UTF-8; what can't be decoded is replaced.

Rows are records; ``serialize`` gives the bytes of WARC/1.1, ``write_files`` and
``read_files`` exchange them with .warc.gz files, one gzip member a record. Files
are read as streams: a task holds one record, not the file.

Defined results: a null page or URL is an empty payload or URI; an empty payload
gives an empty conversion block; repeated rows give records that differ in their
ids alone; fields with line breaks are written with blanks; an encoding that is
unknown or broken leaves the payload as it is. A file that ends inside a record
raises an error.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .html_tree import visible_text

#: Name space of record ids.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
RECORD = "warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block binary, block_digest string, payload_digest string, http_headers string"
FIELDS = [x.split()[0] for x in RECORD.split(", ")]
_SCHEMA = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.string()) for x in RECORD.split(", ")])
CHARSET = re.compile(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
META = re.compile(rb"<meta\b[^>]{0,400}?charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Bytes at the start of a page in which its meta element is looked for.
META_BYTES = 4096
STREAM = 1 << 20
END = b"\r\n\r\n"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, *parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join((kind, *parts)))}>"


def response(page_id: int, url: str, page: str, date: str, row: int = 0) -> dict:
    """A response record of a page, with the HTTP headers that a server would send."""
    body = page.encode("utf-8", "surrogatepass")
    headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}"
    block = headers.encode() + END + body
    return {"warc_type": "response", "record_id": record_id("response", str(page_id), url, sha1(body), str(row)), "refers_to": None, "target_uri": url, "date": date, "content_type": "application/http; msgtype=response", "block": block, "block_digest": sha1(block), "payload_digest": sha1(body), "http_headers": headers}


def unchunked(body: bytes) -> bytes:
    """The body of a chunked message; as it is where a chunk's size is no number or the body ends early."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0], 16)
        except ValueError:
            return body
        if size <= 0:
            return b"".join(out) if size == 0 else body
        if len(body) < end + 2 + size:
            return body
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size
    return body


def unpacked(body: bytes, encoding: str) -> bytes:
    """The body without its content encoding."""
    for name in reversed([x.strip().lower() for x in encoding.split(",") if x.strip()]):
        if name == "identity":
            continue
        if name not in ("gzip", "x-gzip", "deflate"):
            return body
        try:
            body = zlib.decompress(body, 31) if name != "deflate" else zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
        except zlib.error:
            return body
    return body


def page_text(head: str, body: bytes) -> str:
    """The characters of a payload, by its headers."""
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = unchunked(body)
    body = unpacked(body, fields.get("content-encoding", ""))
    found = next((name for mark, name in MARKS if body.startswith(mark)), None)
    if not found and (m := CHARSET.search(fields.get("content-type", ""))):
        found = m[1]
    if not found and (m := META.search(body[:META_BYTES])):
        found = m[1].decode("ascii")
    try:
        return body.decode(codecs.lookup(found or "utf-8").name, "replace")
    except (LookupError, ValueError):  # no charset, or one that gives no text
        return body.decode("utf-8", "replace")


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    head, _, body = source["block"].partition(END)
    page = page_text(head.decode("latin-1"), body)
    links: list[str] = []
    text = visible_text(page, links).encode("utf-8", "surrogatepass")
    shared = {"refers_to": source["record_id"], "target_uri": source["target_uri"], "date": source["date"], "http_headers": source["http_headers"]}
    conversion = {"warc_type": "conversion", "record_id": record_id("conversion", source["record_id"]), "content_type": "text/plain; charset=utf-8", "block": text, "block_digest": sha1(text), "payload_digest": source["payload_digest"], **shared}
    fields = [("source-block-digest", source["block_digest"]), ("source-payload-digest", source["payload_digest"]), ("source-length", str(len(body))), ("conversion-record", conversion["record_id"]), ("text-length", str(len(text)))]
    fields += [("source-header", x) for x in head.decode("latin-1").split("\r\n")] + [("outlink", x) for x in links]
    block = "".join(f"{k}: {_line(v or '')}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    metadata = {"warc_type": "metadata", "record_id": record_id("metadata", source["record_id"]), "content_type": "application/warc-fields", "block": block, "block_digest": sha1(block), "payload_digest": source["payload_digest"], **shared}
    return [metadata, conversion]


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def serialize(record: dict) -> bytes:
    """The bytes of a record, as WARC/1.1."""
    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type")]
    head = ["WARC/1.1"] + [f"{n}: {_line(record[k])}" for n, k in names if record[k] is not None]
    return "\r\n".join([*head, f"Content-Length: {len(record['block'])}"]).encode("utf-8", "surrogatepass") + END + record["block"] + END


class Stream:
    """Bytes of a file of one or many gzip members, or of a plain one, a piece at a time."""

    def __init__(self, source):
        self.source, self.ended, self.first = source, False, True
        self.unzip = None
        self.held = bytearray()
        self.at = 0

    def more(self) -> bool:
        raw = self.source.read(STREAM)
        if not raw:
            if self.unzip is not None and not self.unzip.eof:
                raise ValueError("the file ends inside a record")
            return False
        if self.first:
            self.first = False
            if raw[:2] == b"\x1f\x8b":
                self.unzip = zlib.decompressobj(31)
        if self.at > STREAM:
            del self.held[: self.at]
            self.at = 0
        while self.unzip is not None and raw:
            self.held += self.unzip.decompress(raw)
            raw = self.unzip.unused_data
            if self.unzip.eof and raw:
                self.unzip = zlib.decompressobj(31)
        self.held += raw
        return True

    def upto(self, what: bytes) -> bytes | None:
        """What comes before ``what``, which is skipped; None at the end of the file."""
        seen = self.at
        while (k := self.held.find(what, seen)) < 0:
            behind = len(self.held) - self.at
            if not self.more():
                if behind:
                    raise ValueError("the file ends inside a record")
                return None
            seen = self.at + max(0, behind - len(what) + 1)
        out, self.at = bytes(self.held[self.at : k]), k + len(what)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more():
                raise ValueError("the file ends inside a record")
        out, self.at = bytes(self.held[self.at : self.at + n]), self.at + n
        return out


def parse(source) -> Iterator[dict]:
    """The records of a WARC file, packed or not, from its bytes or an open file."""
    keys = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "date", "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest", "content-type": "content_type"}
    stream = Stream(io.BytesIO(source) if isinstance(source, bytes) else source)
    while (head := stream.upto(END)) is not None:
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not the start of a record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        if stream.take(len(END)) != END:
            raise ValueError("the file ends inside a record")
        http = block.partition(END)[0].decode("latin-1") if fields.get("warc-type") == "response" else None
        yield {f: None for f in FIELDS} | {v: fields.get(k) for k, v in keys.items()} | {"block": block, "http_headers": http}


def _rows(batch: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(batch, schema=_SCHEMA)


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of (page_id, url, html)."""
    common.prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = (b.column(c).to_pylist() for c in ("page_id", "url", "html", "row"))
            yield _rows([response(i, u or "", h or "", date, row) for i, u, h, row in zip(*columns, strict=True)])

    return pages.select("page_id", "url", "html", F.monotonically_increasing_id().alias("row")).mapInArrow(run, RECORD)


def derivatives(records: DataFrame) -> DataFrame:
    """The derivatives of all response records; other records give none."""
    common.prepare(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([d for r in b.to_pylist() for d in derive(r)])

    return records.filter("warc_type = 'response'").select(*FIELDS).mapInArrow(run, RECORD)


def write_files(records: DataFrame, path: str) -> DataFrame:
    """One .warc.gz a partition under ``path`` (a folder that all executors see); returns the files.

    A task writes under a name of its own attempt and renames at its end, so
    that a repeated task leaves one whole file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        context = TaskContext.get()
        where, top = FileSystem.from_uri(path)
        where.create_dir(top, recursive=True)
        name = f"{top}/part-{context.partitionId():05d}.warc.gz"
        own = f"{name}.{context.taskAttemptId()}"
        n = 0
        with where.open_output_stream(own, compression=None) as f:
            for b in batches:
                for r in b.to_pylist():
                    f.write(gzip.compress(serialize(r), 6, mtime=0))
                    n += 1
        where.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    return records.select(*FIELDS).mapInArrow(run, "file string, records bigint")


def read_files(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Records of the .warc and .warc.gz files under ``path``; a file is read by one task.

    Spark lists the files, and a task reads its own as a stream. In a store that
    only Spark's readers open, ``whole`` hands a task the bytes of its file, which
    must fit in memory (packed); its records are unpacked one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        def opened(value):
            if whole:
                return pa.BufferReader(value.as_buffer())
            where, name = FileSystem.from_uri(value.as_py())
            return where.open_input_stream(name, compression=None)

        for b in batches:
            for value in b.column(0):
                held: list[dict] = []
                size = 0
                with opened(value) as f:
                    for r in parse(f):
                        held.append(r)
                        size += len(r["block"])
                        if len(held) == common.BATCH_ROWS or size >= 8 * STREAM:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    common.prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    if whole:
        return files.select("content").mapInArrow(run, RECORD)
    names = files.select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    return names.repartition(max(1, min(files.count(), 10_000))).mapInArrow(run, RECORD)


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Both derivatives of every page."""
    rows = derivatives(responses(common.table(spark, sf_dir, "pages")))
    return rows.select("record_id", "warc_type", "refers_to", "target_uri", "content_type", F.length("block").cast("bigint").alias("content_length"), "block_digest", "payload_digest")
