"""WARC archives with one gzip member per record and a sidecar offset index.

``normalise`` is the monolithic gzip normaliser: it inflates a whole-file gzip stream (or a
file of any members) once, finds the record borders by the Content-Length headers, rewrites
every record as its own member and lists (offset, length, type, page) of each. It streams:
memory holds one header and one block of bytes, whatever the record's size.

``write_archives`` writes one record per page: a response with the HTTP header and payload,
or, for all but the largest page_id of equal payloads of at least ``min_bytes`` bytes, a
revisit with the HTTP header alone. Equality is decided on the SHA-256 of the payload. Every
task writes one whole-file stream to the shared folder, normalises it and deletes it; names
are unique and listed by a manifest that Spark commits, so retries leave nothing listed twice.

Defined results: null html is an empty payload; empty payloads are equal to one another (with
``min_bytes`` 0); pages with a null page_id revisit the largest page_id and are responses if
there is none; rows that repeat the largest page_id are all responses; control characters and
spaces in URLs are percent-encoded; other columns are ignored; no pages give no archives.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polargrain.llm.chunks import slices
from polargrain.llm.common import LOWER, cut, filesystem, shared_dir, table

BLOCK = 1 << 16
END = b"\r\n\r\n"
PAGE = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page(page_id: int | None) -> str:
    """Record ids name the page, so rows that repeat a page_id share one, and a revisit can name its response."""
    return f"<{PAGE}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_page(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page(refers_to)}"]
    body = http + payload if refers_to is None else http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + END + body + END


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


class Inflated:
    """Bytes of a gzip file of one or more members, inflated as they are asked for."""

    def __init__(self, source: BinaryIO):
        self.source, self.engine, self.held = source, None, bytearray()

    def _more(self) -> bool:
        while True:
            data = self.engine.unused_data if self.engine is not None and self.engine.eof else b""
            data = data or self.source.read(BLOCK)
            if self.engine is None or self.engine.eof:
                data = data.lstrip(b"\0") if self.engine is not None else data
                if not data:
                    if self.engine is None or not self.source.read(1):
                        return False
                    raise ValueError("bytes after the last gzip member")
                self.engine = zlib.decompressobj(31)
            elif not data:
                raise ValueError("the gzip stream ends early")
            out = self.engine.decompress(data)
            if out:
                self.held += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end of the file."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark))
            if not self._more():
                if self.held.strip():
                    raise ValueError("the last record is cut off")
                return None
        out = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in parts."""
        while n:
            if not self.held and not self._more():
                raise ValueError("the last record is cut off")
            part = bytes(self.held[:n])
            del self.held[: len(part)]
            n -= len(part)
            yield part


def normalise(source: BinaryIO, target: BinaryIO, index: BinaryIO, level: int = 6) -> int:
    """Rewrite a gzipped WARC file record by record; the number of records."""
    stream, at, n = Inflated(source), 0, 0
    while (head := stream.until(END)) is not None:
        head = head.lstrip(b"\r\n")
        fields = headers(head)
        squeeze, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for part in chain([head], stream.exactly(int(fields["content-length"]) + len(END)), [None]):
            put = squeeze.flush() if part is None else squeeze.compress(part)
            target.write(put)
            size += len(put)
        page = fields.get("warc-record-id", "").strip("<>").removeprefix(PAGE)
        index.write(f"{at}\t{size}\t{fields.get('warc-type', '')}\t{page}\n".encode())
        at, n = at + size, n + 1
    return n


def read_member(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers and payload of one member."""
    whole = zlib.decompress(data, 31)
    at = whole.index(END)
    fields = headers(whole[:at])
    body = whole[at + len(END) : at + len(END) + int(fields["content-length"])]
    cut_at = body.index(END)
    return fields, headers(body[:cut_at]), body[cut_at + len(END) :]


def _number(page: str) -> int | None:
    return int(page) if page else None


def read_archive(path: str, block: int = 4 << 20) -> Iterator[tuple]:
    """Rows of ``RESULT`` for every record, by the sidecar index; digests are checked."""
    fs, where = filesystem(path)
    with fs.open_input_stream(where + ".idx") as f:
        entries = [(int(a), int(n), kind, page) for a, n, kind, page in (line.split("\t") for line in f.read().decode().splitlines())]
    with fs.open_input_file(where) as f:
        for held in slices(entries, lambda e: e[1], block, 1 << 30):
            first = held[0][0]
            data = f.read_at(held[-1][0] + held[-1][1] - first, first)
            for at, size, kind, page in held:
                fields, http, payload = read_member(data[at - first : at - first + size])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (payload_digest(payload) != digest or len(payload) != int(http["content-length"])):
                    raise ValueError(f"{path}: the record at {at} does not match its digest")
                refers = fields.get("warc-refers-to")
                yield _number(page), int(http["content-length"]), digest, kind, None if refers is None else _number(refers.strip("<>").removeprefix(PAGE)), path, at


def write_archives(pages: DataFrame, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write all pages; (path, records) of every archive."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumn("key", F.sha2("html", 256))
    equal = keyed.filter(F.octet_length("html") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("first_page"), F.count(F.lit(1)).alias("n"))
    leaders = cut(equal.filter("n > 1 and first_page is not null").select("key", "first_page"), "warc-leaders")
    joined = keyed.join(leaders, "key", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_page")), F.col("first_page"))
    ready = joined.select("page_id", "url", "html", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = filesystem(f"{folder}/{uuid.uuid4().hex}.warc.gz")
        squeeze, out = zlib.compressobj(1, zlib.DEFLATED, 31), None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if out is None:
                    fs.create_dir(where.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(where + ".whole")
                out.write(squeeze.compress(record(page_id, url, html.encode(), refers_to)))
        if out is None:
            return
        out.write(squeeze.flush())
        out.close()
        with fs.open_input_stream(where + ".whole") as source, fs.open_output_stream(where, compression=None) as target, fs.open_output_stream(where + ".idx") as index:
            n = normalise(source, target, index, level)
        fs.delete_file(where + ".whole")
        path = f"{folder}/{where.rpartition('/')[2]}"
        yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([n], pa.int64())})

    return cut(ready.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for held in slices(read_archive(path), lambda r: 1, 10_000, 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], kind) for k, kind in enumerate(kinds)], names)

    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return manifest.select("path").repartition(n).mapInArrow(read, RESULT)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = LOWER.upper() + "234567"
_NIBBLES = ", ".join(f"'{k:04b}'" for k in range(16))
_FIVES = ",".join(f"{k:05b}" for k in range(32))
OP1_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS best FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: [{_NIBBLES}][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits FROM h)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', (strpos('{_FIVES}', substr(bits, 5 * i + 1, 5)) - 1) // 6 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM best OR best IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM b
"""
