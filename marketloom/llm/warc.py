"""WARC archives: a writer, and a sequential reader.

One gzip member a record. The reader takes the bytes as they come: it decompresses member after member in small pieces,
frames each block by its Content-Length and verifies block and payload digests. An archive is a row
(archive, content) of a table, so that any file system Spark writes to will do, or a file read by `read_files`.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import NO_ID, materialize, salted_join

ARCHIVE_BYTES = 4 << 20
PIECE = 1 << 16
DATE = "2026-01-01T00:00:00Z"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    target = "".join(c if c.isprintable() and c != " " else "".join(f"%{x:02X}" for x in c.encode()) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target else []), f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", "",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class Inflate:
    """The bytes of one gzip member after another, as they are asked for."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.left, self.have, self.zip = iter(pieces), b"", bytearray(), None

    def next_member(self) -> bool:
        """At the end of the last: is there another member?"""
        self.have.clear()
        while not self.left:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            self.left = piece
        self.zip = zlib.decompressobj(31)
        return True

    def more(self) -> bool:
        """Some more bytes of this member; False at its end."""
        while not self.zip.eof:
            if not self.left:
                self.left = next(self.pieces, b"")
                if not self.left:
                    raise ValueError("the archive ends within a gzip member")
            out = self.zip.decompress(self.left, PIECE)
            self.left = self.zip.unused_data if self.zip.eof else self.zip.unconsumed_tail
            if out:
                self.have += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (i := self.have.find(mark, max(0, at - len(mark)))) < 0:
            at = len(self.have)
            if not self.more():
                raise ValueError("a record's header does not end")
        out = bytes(self.have[:i])
        del self.have[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.more():
                raise ValueError("a record's block is shorter than its Content-Length")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out

    def rest(self) -> bytes:
        while self.more():
            pass
        return bytes(self.have)


def fields(head: str) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:])}


def records(pieces: Iterable[bytes]) -> Iterator[dict]:
    """Each record of an archive: header fields, HTTP header fields, payload, and whether its digests hold."""
    stream = Inflate(pieces)
    while stream.next_member():
        head = fields(stream.until(b"\r\n\r\n").decode())
        block = stream.take(int(head["content-length"]))
        if stream.rest() != b"\r\n\r\n":
            raise ValueError("a record does not end where its Content-Length says")
        http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
        good = head.get("warc-block-digest", "sha1:" + digest(block)) == "sha1:" + digest(block)
        if head["warc-type"] != "revisit":
            good &= head.get("warc-payload-digest", "sha1:" + digest(payload)) == "sha1:" + digest(payload)
        yield {"head": head, "http": fields(http.decode("utf-8", "replace")), "payload": payload, "verified": good}


def firsts(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(id, sum, refers_to): pages (by id and digest) whose payload another, with a smaller id, has too. Payloads are compared by digest; only
    digests move, and a payload that very many pages share is counted map-side and joined back in pieces."""
    sums = pages.select("id", "sum", F.octet_length("html").alias("size")).where(F.col("size") >= min_bytes)
    shared = sums.groupBy("sum").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    return salted_join(sums, shared, "sum", "id").where("id <> refers_to").select("id", "sum", "refers_to").distinct()


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Archives (archive, content) of one record a page; null html is empty, a null id the largest. Rows that repeat an id are each written."""
    table = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    table = table.withColumn("sum", F.sha1("html"))
    joined = table.join(firsts(table, min_bytes), ["id", "sum"], "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, content = None, bytearray()
        done = lambda: pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bytes(content)], pa.binary())], ["archive", "content"])
        for batch in batches:
            ids, urls, refers = (batch.column(c).to_pylist() for c in ("id", "url", "refers_to"))
            html = batch.column("html")
            for i, page_id in enumerate(ids):
                name = name or f"page-{page_id}.warc.gz"
                content += record(page_id, urls[i], html[i].as_py().encode(), refers[i])
                if len(content) >= ARCHIVE_BYTES:
                    yield done()
                    name, content = None, bytearray()
        if content:
            yield done()

    return joined.select("id", "url", "html", "refers_to").mapInArrow(pack, "archive string, content binary")


def read(archives: DataFrame, content_col: str = "content", with_payload: bool = False) -> DataFrame:
    """One row a record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, verified and, if asked for, payload."""
    number = lambda x: int(x.rpartition(":")[2].rstrip(">")) if x and x.startswith("<urn:page:") else None
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("verified", pa.bool_()), *([("payload", pa.binary())] if with_payload else [])])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):
                data, out, held = cell.as_buffer() if cell.is_valid else b"", [], 0
                for r in records(bytes(data[i : i + PIECE]) for i in range(0, len(data), PIECE)):
                    h = r["head"]
                    again = h["warc-type"] == "revisit"
                    out.append({
                        "page_id": None if (own := number(h.get("warc-record-id"))) == NO_ID else own, "payload_bytes": int(r["http"].get("content-length", 0)) if again else len(r["payload"]), "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:"),
                        "record_type": h["warc-type"], "refers_to": number(h.get("warc-refers-to")), "url": h.get("warc-target-uri"), "verified": r["verified"],
                    } | ({"payload": r["payload"]} if with_payload else {}))
                    held += len(r["payload"]) if with_payload else 0
                    if len(out) >= 4096 or held > ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, verified boolean" + ", payload binary" * with_payload
    return archives.select(content_col).mapInArrow(unpack, kinds)


def read_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of *.warc.gz files, each up to 2 GB."""
    return read(spark.read.format("binaryFile").load(path), "content", with_payload)


def round_trip(pages: DataFrame, **columns) -> DataFrame:
    """Archives written to the shared folder, and the records read back from there."""
    return read(materialize(write(pages, **columns), "warc"))
