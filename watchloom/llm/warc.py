"""WARC archives: a writer, and a sequential reader with one gzip member per record.

Archives are files in the shared folder (or any folder that pyarrow's file systems reach), written and read inside tasks
as streams: the reader decompresses a member in chunks, frames the block by Content-Length and checks
the digests, so a task holds one record at a time, whatever the size of the archive.

A response record's block is an HTTP response with the payload. Records with an equal payload of at
least min_bytes are written once: the one with the largest id is the response, the others are revisit records with
the headers alone, which refer to it.

Defined results: a null payload is empty; a null url leaves the target header out; line ends in a url are percent-encoded;
a null id is smaller than any other; rows that share the largest id and the payload are all responses; an empty table gives
an archive list without rows; other columns are ignored; ids are whole numbers or texts of such. Header bytes that aren't UTF-8
are replaced. A broken member or a wrong digest gives ok = false with
what could be read, and the archive is read on from the next member where it can be found.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, new_path, save, text_or_empty

CHUNK = 1 << 18
#: Fixed value: how a gzip member begins.
MAGIC = b"\x1f\x8b\x08"
ARCHIVES = "path string, records bigint, bytes bigint"
#: Fixed value: the profile of revisits of identical payloads in WARC 1.1.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and its own path of a URI or a local path."""
    if urlsplit(path).scheme:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record, not compressed: a response, or a revisit if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {IDENTICAL}"]
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _writer(folder: str, roll: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, name, n, size = None, "", 0, 0
        for pdf in batches:
            done = []
            for key, url, html, refers in zip(pdf["id"], pdf["url"], pdf["html"], pdf["refers"], strict=True):
                if out is None:
                    # a new name each time: what a lost task has left is in no list
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                data = member(record(f"urn:page:{key}", url, html.encode("utf-8", "surrogatepass"), None if refers is None else f"urn:page:{refers}"))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    out.close()
                    done.append((f"{folder}/{name}", n, size))
                    out = None
            yield pd.DataFrame(done, columns=["path", "records", "bytes"])
        if out is not None:
            out.close()
            yield pd.DataFrame([(f"{folder}/{name}", n, size)], columns=["path", "records", "bytes"])

    return write


def write_warc(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, roll: int = 1 << 25, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives and returns their list: path, records, bytes. roll: compressed bytes at which a new archive begins."""
    bounded_batches(pages.sparkSession)
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(payload_col).alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= min_bytes, F.unhex(F.sha2("html", 256))))
    groups = rows.select("id", "key").filter("key is not null").groupBy("key").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # written, so that the join reads both sides plainly and Spark can split the pages of a very common payload
    groups = save(groups, "warc-groups")
    refers = F.when(~F.col("id").eqNullSafe(F.col("last")), F.col("last"))
    placed = rows.join(groups, "key", "left").select(F.coalesce(F.col("id").cast("string"), F.lit("null")).alias("id"), "url", "html", F.when(F.col("last").isNotNull(), refers).cast("string").alias("refers"))
    return save(placed.mapInPandas(_writer(folder, roll), ARCHIVES), "warc-archives")


def _head(stream: io.BytesIO) -> tuple[str, dict[str, str]]:
    first = stream.readline().strip().decode("utf-8", "replace")
    fields: dict[str, str] = {}
    for line in iter(lambda: stream.readline().rstrip(b"\r\n"), b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return first, fields


def parse(data: bytes) -> dict:
    """The fields of one decompressed record; ok is false if framing or a digest is wrong."""
    stream = io.BytesIO(data)
    version, head = _head(stream)
    length = int(head.get("content-length", "-1")) if head.get("content-length", "-1").isdigit() else -1
    block, end = (stream.read(length), stream.read()) if length >= 0 else (stream.read(), b"")
    ok = version.startswith("WARC/1.") and len(block) == length and end == b"\r\n\r\n"
    ok &= head.get("warc-block-digest", f"sha1:{digest(block)}") == f"sha1:{digest(block)}"
    payload, size = block, len(block)
    if head.get("content-type", "").startswith("application/http"):
        inner = io.BytesIO(block)
        _, http = _head(inner)
        payload = inner.read()
        size = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(payload)
    said = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head.get("warc-type") != "revisit":
        ok &= size == len(payload) and said in ("", digest(payload))
        said = digest(payload)
    return {"record_id": head.get("warc-record-id", "").strip("<>"), "record_type": head.get("warc-type"), "url": head.get("warc-target-uri"), "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None, "payload_bytes": size, "payload_digest": said, "ok": bool(ok), "payload": payload}


def members(stream) -> Iterator[tuple[bytes, bool]]:
    """(bytes, whole) of each gzip member of a stream, decompressed chunk by chunk. Zero bytes between members are padding."""
    rest = b""
    while True:
        rest = rest.lstrip(b"\0")
        while not rest:
            if not (rest := stream.read(CHUNK)):
                return
            rest = rest.lstrip(b"\0")
        unpack, parts, whole = zlib.decompressobj(31), [], True
        try:
            while not unpack.eof:
                if not rest:
                    rest = stream.read(CHUNK)
                    if not rest:
                        whole = False
                        break
                parts.append(unpack.decompress(rest, CHUNK))
                rest = unpack.unconsumed_tail or (unpack.unused_data if unpack.eof else b"")
        except zlib.error:
            whole = False
            at = rest.find(MAGIC, 1)  # the next member's head
            while at < 0:
                more = stream.read(CHUNK)
                if not more:
                    break
                rest = rest[-len(MAGIC) + 1 :] + more  # it may lie across two chunks
                at = rest.find(MAGIC)
            rest = rest[at:] if at >= 0 else b""
        yield b"".join(parts), whole


RECORDS = "record_id string, record_type string, url string, refers_to string, payload_bytes bigint, payload_digest string, ok boolean"


def read_warc(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of archives (path); an archive is read by one task from front to back."""
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                system, own = _open(path)
                with system.open_input_stream(own, compression=None) as stream:
                    rows, held = [], 0
                    for data, whole in members(stream):
                        row = parse(data)
                        row["ok"] &= whole
                        held += len(row["payload"]) if with_payload else 100
                        rows.append([row[x] for x in names])
                        if held > 1 << 24 or len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=names)

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInPandas(read, RECORDS + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, ok."""

    def number(col: str) -> Column:
        return F.expr(f"try_cast(substring_index({col}, ':', -1) as bigint)")

    back = checked_revisits(save(read_warc(write_warc(pages, min_bytes=min_bytes)), "warc-records"))
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "ok")


def checked_revisits(records: DataFrame) -> DataFrame:
    """The records, where a revisit is ok only if a response has the id it refers to, and its digest and length. records: a written table.

    Only the responses that are referred to are joined, one row for each, and many revisits of one response are a key that Spark can split.
    """
    named = records.filter("refers_to is not null").select(F.col("refers_to").alias("own")).distinct()
    responses = records.filter("record_type = 'response' and ok").join(named, F.col("record_id") == F.col("own"), "left_semi")
    # responses may share an id (rows with one id and several payloads): one of them must have the digest and length
    facts = responses.select(F.col("record_id").alias("said"), F.col("payload_digest").alias("said_digest"), F.col("payload_bytes").alias("said_bytes"), F.lit(True).alias("found"))
    facts = save(facts.distinct(), "warc-responses")
    same = (F.col("refers_to") == F.col("said")) & (F.col("payload_digest") == F.col("said_digest")) & (F.col("payload_bytes") == F.col("said_bytes"))
    out = records.join(facts, same, "left")
    return out.withColumn("ok", F.col("ok") & (F.col("refers_to").isNull() | F.col("found").isNotNull())).select(*records.columns)
