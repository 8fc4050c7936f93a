"""WARC archives: a writer with one gzip member per record, and a sequential reader."""

from __future__ import annotations

import contextlib
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamplight.llm.common import Scratch, file_system, small

CHUNK = 1 << 16  #: compressed bytes read at once
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
#: What the reader tells of a record; refers_to is a record id.
FIELDS = {"file": pa.string(), "offset": pa.int64(), "page_id": pa.int64(), "record_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "uri": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "error": pa.string()}
SCHEMA = ", ".join(f"{k} {'long' if v == pa.int64() else 'string'}" for k, v in FIELDS.items())


class Broken(ValueError):
    """What is wrong with a record."""


def members(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, pieces of the content) of each gzip member. Pieces are inflated as they are asked for, none above chunk
    bytes; what a caller leaves is read past. After a member that doesn't inflate, the next that begins a record is looked
    for."""
    held, past, at, ended, damaged = b"", b"", 0, False, False  # past: the last bytes read of a member, at most CHUNK

    def pieces() -> Iterator[bytes]:
        nonlocal held, past, at, ended, damaged
        inflate = zlib.decompressobj(wbits=31)
        while not inflate.eof:
            if not held:
                held = stream.read(chunk)
                if not held:
                    ended = True
                    raise Broken("the archive ends within a member")
            try:
                out = inflate.decompress(held, chunk)
            except zlib.error as e:
                damaged = True
                raise Broken(f"not a gzip member: {e}") from e
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            at += len(held) - len(rest)
            past, held = (past + held[: len(held) - len(rest)])[-CHUNK:], rest
            if out:
                yield out

    def resume(begin: int) -> None:
        """Goes on to where a member begins whose content begins a record; begin is where the damaged one began."""
        nonlocal held, at
        held, at = past + held, at - len(past)
        skip = 1 if at == begin else 0
        while True:
            place = held.find(MAGIC, skip)
            if place < 0 or len(held) - place < 1024:
                keep = place if place >= 0 else max(skip, len(held) - 2)
                at, held, skip = at + keep, held[keep:], 0 if place >= 0 else max(0, skip - keep)
                more = stream.read(chunk)
                held += more
                if more:
                    continue
                if place < 0:
                    at, held = at + len(held), b""
                    return
                place = 0
            try:
                if zlib.decompressobj(wbits=31).decompress(held[place : place + 1024], 7) == b"WARC/1.":
                    at, held = at + place, held[place:]
                    return
            except zlib.error:
                pass
            skip = place + 1

    while not ended:
        if not held:
            held = stream.read(chunk)
        if not held:
            return
        begin, past, content = at, b"", pieces()
        yield at, content
        with contextlib.suppress(Broken):  # who left a member unread has told that something is wrong with it
            for _ in content:
                pass
        if damaged:
            damaged = False
            resume(begin)


class _Cursor:
    """Lines and bounded bytes of a member's content."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        piece = next(self.pieces, None)
        self.held += piece or b""
        return piece is not None

    def line(self) -> bytes:
        while b"\r\n" not in self.held:
            if len(self.held) > 1 << 20 or not self.more():
                raise Broken("a header line without an end")
        line, _, self.held = self.held.partition(b"\r\n")
        return line

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise Broken(f"{n} bytes of the block are missing")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            yield part


def _head(cursor: _Cursor) -> dict[str, str]:
    if not (version := cursor.line()).startswith(b"WARC/1."):
        raise Broken(f"no WARC version: {version[:20]!r}")
    out: dict[str, str] = {}
    while line := cursor.line():
        name, _, value = line.decode("utf-8").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _record(pieces: Iterator[bytes]) -> dict:
    cursor = _Cursor(pieces)
    head = _head(cursor)
    block, payload, size, error = hashlib.sha256(), hashlib.sha256(), 0, None
    http, buffer = head.get("content-type", "").startswith("application/http"), b""
    for part in cursor.take(int(head["content-length"])):
        block.update(part)
        if http:  # the payload begins after the protocol's head
            buffer += part
            if b"\r\n\r\n" not in buffer:
                continue
            part, http = buffer.partition(b"\r\n\r\n")[2], False
        payload.update(part)
        size += len(part)
    if cursor.line() or cursor.line():
        error = "no end of record after the block"
    if cursor.held or cursor.more():
        error = "bytes after the record"
    claimed = head.get("warc-payload-digest", "").removeprefix("sha256:")
    revisit = head.get("warc-type") == "revisit"
    if head.get("warc-block-digest", "").removeprefix("sha256:") not in ("", block.hexdigest()):
        error = "the block digest differs"
    elif not revisit and claimed not in ("", payload.hexdigest()):
        error = "the payload digest differs"
    page = head.get("x-page-id")
    return {"page_id": int(page) if page else None, "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "payload_bytes": int(head.get("x-payload-length", size)) if revisit else size, "payload_digest": claimed if revisit else payload.hexdigest(), "error": error}


def read(stream: BinaryIO, chunk: int = CHUNK) -> Iterator[dict]:
    """A dict (FIELDS without file) per record. Blocks stream through the digests and are never held.

    A wrong block or payload digest, a wrong length or bytes after the record are the record's error. A record that cannot be
    read at all is a row of its offset and its error, and reading goes on with the next member.
    """
    for at, pieces in members(stream, chunk):
        try:
            row = _record(pieces)
        except (Broken, KeyError, ValueError) as e:
            row = {"error": f"{type(e).__name__}: {e}"}
        yield dict.fromkeys(list(FIELDS)[1:]) | row | {"offset": at}


def record(kind: str, record_id: str, uri: str, payload: bytes | None, digest: str, refers_to: str | None = None, page_id: int | None = None, length: int | None = None) -> bytes:
    """A record as one gzip member. A revisit has the payload's digest and length, not the payload."""
    length = len(payload or b"") if length is None else length
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {length}\r\n\r\n".encode()
    block += payload or b"" if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}", f"X-Payload-Length: {length}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def _archive(rows: DataFrame, folder: str, kind: str) -> DataFrame:
    """Writes rows (page_id, url, digest, bytes, payload, refers_to) as records of one kind, an archive per task. Returns
    (file, page_id, record_id, digest, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name = None, ""
        try:
            for batch in batches:
                ids = []
                for row in range(batch.num_rows):
                    page, url, digest, size, data, refers = (c[row].as_py() for c in batch.columns)
                    if out is None:
                        files, at = file_system(folder)
                        files.create_dir(at, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = files.open_output_stream(f"{at}/{name}", compression=None)
                    ids.append(f"<urn:uuid:{uuid.uuid4()}>")
                    out.write(record(kind, ids[-1], url.replace("\r", "%0D").replace("\n", "%0A"), data, digest, refers, page, size))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), batch.column(0), pa.array(ids, pa.string()), batch.column(2), batch.column(3)], ["file", "page_id", "record_id", "digest", "bytes"])
        finally:
            if out is not None:
                out.close()

    return rows.select("page_id", "url", "digest", "bytes", "payload", "refers_to").mapInArrow(run, "file string, page_id long, record_id string, digest string, bytes long")


def write(pages: DataFrame, folder: str, scratch: Scratch, revisit_bytes: int = 100) -> DataFrame:
    """Writes an archive per task to the folder, a shared one: responses first, then the revisits that name them. Returns
    (file, page_id, record_id, digest, bytes), written.

    pages: (page_id, url, html); a null html is an empty payload, a null url an empty URI. Of records with equal payloads
    of revisit_bytes or more, those with the smallest page_id are responses and others revisits; smaller payloads and rows
    without a page_id are responses. Every row is a record with an id of its own, repeated rows and page_ids too; of several
    responses with the smallest page_id, revisits name one. Other columns are not read. A task writes under a name of its
    own, so a repeated task leaves a file that no row names. Payloads are shuffled only where digests that repeat are too many
    to broadcast; a revisit needs none.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    repeated = rows.where(F.col("bytes") >= revisit_bytes).groupBy("digest").agg(F.count("page_id").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    repeated = small(scratch.save(repeated.select("digest", "first"), "repeated"), 72)
    marked = rows.join(repeated, "digest", "left").withColumn("again", F.coalesce(F.col("page_id") > F.col("first"), F.lit(False)))
    responses = scratch.save(_archive(marked.where("not again").withColumn("refers_to", F.lit(None).cast("string")), folder, "response"), "responses")
    named = responses.join(repeated, "digest").where(F.col("page_id") == F.col("first")).groupBy("digest").agg(F.min("record_id").alias("refers_to"))
    later = marked.where("again").select("page_id", "url", "digest", "bytes").join(named, "digest").withColumn("payload", F.lit(None).cast("binary"))
    return responses.unionByName(scratch.save(_archive(later, folder, "revisit"), "revisits"))


def scan(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """SCHEMA rows of the archives in names (file), each read from its start to its end by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(FIELDS.items()))
        for batch in batches:
            for name in batch.column(0).to_pylist():
                files, at = file_system(folder)
                rows = []
                with files.open_input_stream(f"{at}/{name}", compression=None) as stream:
                    for row in read(stream):
                        rows.append({"file": name} | row)
                        if len(rows) == 1024:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return names.mapInArrow(run, SCHEMA)


def resolved(back: DataFrame) -> DataFrame:
    """SCHEMA rows with refers_to as the page_id of the response that a revisit names, as read. A revisit whose response is
    missing, or has another digest or length than it claims, has an error."""
    there = back.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("page_id").alias("_page"), F.first("payload_digest").alias("_digest"), F.first("payload_bytes").alias("_bytes"))
    out = back.join(there, "refers_to", "left")
    false = F.when(F.col("_digest").isNull(), "the response is missing").when(F.col("_digest") != F.col("payload_digest"), "the response has another digest").when(F.col("_bytes") != F.col("payload_bytes"), "the response has another length")
    error = F.coalesce("error", F.when(F.col("record_type") == "revisit", false))
    return out.select(*(F.col("_page").alias(c) if c == "refers_to" else error.alias(c) if c == "error" else F.col(c) for c in FIELDS))


def round_trip(pages: DataFrame, revisit_bytes: int = 100) -> DataFrame:
    """Writes the pages as archives, reads these back, and returns per record (page_id, payload_bytes, payload_digest,
    record_type, refers_to, file, offset, record_id, uri, error), all as read; refers_to is the response's page_id. A record
    that was written and isn't read back is a row with an error. See write() for odd rows; an empty table gives no archive and
    no row."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    index = write(pages, folder, scratch, revisit_bytes)
    names = scratch.save(index.select("file").distinct(), "names")
    names = names.repartition(max(1, min(names.count(), 100_000)))  # a task an archive; by number, so that none are put together
    back = scratch.save(resolved(scratch.save(scan(spark, folder, names), "read")), "resolved")
    written = index.select(F.col("file").alias("_file"), F.col("record_id").alias("_id"))
    out = back.join(written, F.col("record_id") == F.col("_id"), "full")
    error = F.coalesce("error", F.when(F.col("record_id").isNull(), "written and not read back"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce("file", "_file").alias("file"), "offset", F.coalesce("record_id", "_id").alias("record_id"), "uri", error.alias("error"))
