"""WARC archives: one gzip member per record, written and read in order by the tasks.

The reader inflates one member at a time, takes the header, then counts the block off by its content length while
both digests run along, so its memory does not grow with a record. Archives are plain files below the shared folder;
a task that is run again writes new files, and only files of finished tasks are listed.

Defined results: a missing payload counts as an empty one; of equal payloads of at least ``least_bytes`` the row with
the largest id is a response and the others revisit it, and rows that repeat this id and payload are responses too;
a row without an id revisits the response, or is a response if no equal payload has an id; an empty table gives no
archive and no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import Stage
from panelwright.session import work_folder

ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
END = b"\r\n\r\n"
# Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The uncompressed bytes of a response or revisit record."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}{END.decode()}".encode()
    block = head + (payload if refers_to is None else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest}")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if refers_to is not None:
        source = uuid.uuid5(uuid.NAMESPACE_URL, f"{refers_to} {digest}")
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{source}>"),
                   ("Refers-To-Page-ID", str(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    header = VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return header.encode() + block + END


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class Inflated:
    """The bytes of one gzip member after another; each member is read to its end before the next begins."""

    def __init__(self, source: BinaryIO):
        self.source, self.packed, self.ready, self.unpacker = source, b"", b"", None

    def next_member(self) -> bool:
        if not self.packed:
            self.packed = self.source.read(CHUNK)
        self.unpacker, self.ready = (zlib.decompressobj(31), b"") if self.packed else (None, b"")
        return self.unpacker is not None

    def more(self) -> bytes:
        """Some bytes of the member, empty at its end."""
        while not self.unpacker.eof:
            if not self.packed:
                self.packed = self.source.read(CHUNK)
                if not self.packed:
                    raise ValueError("the archive ends inside a record")
            data = self.unpacker.decompress(self.packed, CHUNK)
            self.packed = self.unpacker.unused_data if self.unpacker.eof else self.unpacker.unconsumed_tail
            if data:
                return data
        return b""

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            data = self.more()
            if not data:
                raise ValueError("a record without a whole header")
            self.ready += data
        found, self.ready = self.ready.split(mark, 1)
        return found

    def counted(self, size: int) -> Iterator[bytes]:
        while size:
            if not self.ready:
                self.ready = self.more()
                if not self.ready:
                    raise ValueError("a record shorter than its content length")
            part, self.ready = self.ready[:size], self.ready[size:]
            size -= len(part)
            yield part

    def rest(self) -> bytes:
        data = self.ready
        while part := self.more():
            data += part
        return data


def fields_of(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines[1:] if ":" in line)}


def read_records(source: BinaryIO) -> Iterator[tuple]:
    """Rows of ``RECORD_SCHEMA``; a digest that does not hold is an error."""
    stream = Inflated(source)
    while stream.next_member():
        fields = fields_of(stream.until(END))
        block, payload = hashlib.sha1(), hashlib.sha1()
        http, inside, size = b"", False, 0
        for part in stream.counted(int(fields["content-length"])):
            block.update(part)
            if not inside:
                http += part
                if END not in http:
                    continue
                http, part = http.split(END, 1)
                inside = True
            payload.update(part)
            size += len(part)
        if stream.rest() != END:
            raise ValueError("a record does not end with two line breaks")
        named = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if base64.b32encode(block.digest()).decode() != fields["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"block digest of {fields['warc-record-id']} does not hold")
        if kind == "response" and base64.b32encode(payload.digest()).decode() != named:
            raise ValueError(f"payload digest of {fields['warc-record-id']} does not hold")
        page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
        # A revisit keeps the HTTP header of the full payload, but not the payload.
        length = size if kind == "response" else int(fields_of(http)["content-length"])
        yield (None if page is None else int(page), fields.get("warc-target-uri"), kind, length, named,
               None if refers is None else int(refers))


def with_roles(pages: DataFrame, page_id: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, refers_to): the response that each revisit refers to."""
    content = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), content.alias("payload"),
        F.unhex(F.sha1(content)).alias("digest"),
    )
    equal = rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1").select("digest", "last")
    last = F.when(F.col("page_id").eqNullSafe(F.col("last")), F.lit(None)).otherwise(F.col("last"))
    return rows.join(equal, "digest", "left").select("page_id", "url", "payload", "digest", last.alias("refers_to"))


def write_archives(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html",
    least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 6,
) -> Stage:
    """Write the pages; the result lists the archives as ``(path, records, bytes)``."""
    folder = work_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        out, path, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for values in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if out is None:
                    system.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, size, count = system.open_output_stream(path, compression=None), 0, 0
                number, address, content, digest, refers = values
                data = member(record(number, address, content, base64.b32encode(digest).decode(), refers), level)
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        for row in done:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["path", "records", "bytes"])

    rows = with_roles(pages, page_id, url, payload, least_bytes)
    return Stage(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "warc-list")


def read_archives(spark: SparkSession, archives: DataFrame, folder_of: str | None = None) -> DataFrame:
    """The records of the listed archives, each archive read in order by one task."""
    from panelwright.session import shared_folder

    shared = folder_of or shared_folder(spark)
    kinds = ["int64", "string", "string", "int64", "string", "int64"]
    names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(shared)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with system.open_input_stream(path, compression=None) as source:
                    for row in read_records(source):
                        rows.append(row)
                        if len(rows) == 1000:
                            yield _rows(rows, names, kinds)
                            rows = []
                if rows:
                    yield _rows(rows, names, kinds)

    # Archives are dealt out evenly; each row is one archive.
    spread = archives.select("path").repartition(max(1, min(archives.count(), 100_000)))
    return spread.mapInArrow(run, RECORD_SCHEMA)


def _rows(rows: list[tuple], names: list[str], kinds: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def payload_facts() -> list[Column]:
    return [F.col(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")]
