"""A data source of text records in files of any size: spark.read.format("watchloom_text"), and readStream.

A file is read in byte ranges of splitBytes; a range begins at the first record that starts in it and reads its last record to the end, so each record is
read by one task, whatever the size of the file. Encodings of two bytes a unit are resynchronised at whole units, which the engine's own text
source can't do. As a stream its offsets are the bookmarks: of each file the bytes that are read, up to the last complete record; a restart from the checkpoint
reads nothing twice.

Options: path (a file or a folder, searched recursively); encoding (utf-8, utf-16-le, utf-16-be, or auto, the default: by the byte order mark, else UTF-8);
kind (lines, the default, or auto: the first record of a file decides between json, csv with a header, and plain; csv records become JSON objects by their header);
splitBytes (64 MiB). Columns: file, start (byte of the record; of a compressed file, in its content), kind, record.

Defined results: records end at \\n or \\r\\n, empty ones are left out, the last one of a file needs no end in a batch read and waits for it in a stream. Bytes that don't
decode are replaced. A file with the suffix .gz is read by one task. A file that has become shorter is read anew. Files whose names begin with . or _ are left out.
"""

from __future__ import annotations

import csv
import gzip
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "watchloom_text"
SCHEMA = "file string, start bigint, kind string, record string"
ARROW = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("record", pa.string())])
SPLIT, CHUNK, BATCH = 64 << 20, 1 << 20, 4 << 20
MARKS = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be", b"\xef\xbb\xbf": "utf-8"}


@dataclass
class Range(InputPartition):
    """Records of a file that start in [lo, hi)."""

    path: str
    lo: int
    hi: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """Size of every file below a path, by its own path."""
    system, own = opened(path)
    info = system.get_file_info(own)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(own, recursive=True, allow_not_found=True))
    scheme = path[: len(path) - len(urlsplit(path).path)] if urlsplit(path).scheme else ""
    visible = (f for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(own) :].strip("/").split("/") if p))
    return {f"{scheme}{f.path}": f.size for f in sorted(visible, key=lambda f: f.path)}


class Records:
    """The records of one file."""

    def __init__(self, path: str, encoding: str = "auto"):
        self.path, (system, own) = path, opened(path)
        self.packed = path.endswith(".gz")
        self.stream = gzip.GzipFile(fileobj=system.open_input_file(own)) if self.packed else system.open_input_file(own)
        head = self.stream.read(3)
        mark = next((m for m in MARKS if head.startswith(m)), b"")
        self.encoding = (MARKS.get(mark) or "utf-8") if encoding == "auto" else encoding
        self.begin = len(mark)
        self.end = "\n".encode(self.encoding)

    def _found(self, data: bytes, at: int, base: int) -> int:
        """Where the next line end lies in data, whose first byte is base; -1 if nowhere. Ends lie at whole units."""
        while (at := data.find(self.end, at)) >= 0 and (base + at) % len(self.end):
            at += 1
        return at

    def between(self, lo: int, hi: int) -> Iterator[tuple[int, str]]:
        """(start, record) of the records that start in [lo, hi)."""
        width = len(self.end)
        lo = max(lo + -lo % width, self.begin)
        at = lo if lo <= self.begin else lo - width  # a record that starts at lo has a line end before it
        self.stream.seek(at)
        data, skip = b"", at < lo
        while True:
            more = self.stream.read(CHUNK)
            done, base, place = not more, at, 0
            data += more
            while (to := self._found(data, place, base)) >= 0 or (done and place < len(data)):
                to = to if to >= 0 else len(data)
                if not skip:
                    if base + place >= hi:
                        return
                    record = data[place:to].decode(self.encoding, "replace").removesuffix("\r")
                    if record:
                        yield base + place, record
                skip, place = False, to + width
            if done:
                return
            at, data = base + min(place, len(data)), data[place:]
            if at >= hi and not skip:
                return

    def complete(self, since: int, size: int) -> int:
        """The end of the last record that has a line end, from since on; since if there is none."""
        hi, tail = size - size % len(self.end), b""
        while hi > since:
            lo = max(since, hi - CHUNK)
            lo += -lo % len(self.end)
            self.stream.seek(lo)
            tail = self.stream.read(hi - lo)
            at = len(tail)
            while (at := tail.rfind(self.end, 0, at)) >= 0:
                if (lo + at) % len(self.end) == 0:
                    return lo + at + len(self.end)
                at += len(self.end) - 1
            hi = lo if lo < hi else since
        return since

    def first(self) -> str:
        return next((r for _, r in self.between(self.begin, 1 << 62)), "")


def kind_of(first: str) -> str:
    """What a file's first record says it is."""
    try:
        if first.lstrip()[:1] in ("{", "["):
            json.loads(first)
            return "json"
    except ValueError:
        pass
    return "csv" if "," in first and not any(c.isdigit() for c in first) else "plain"


def read(span: Range | None, options: dict[str, str]) -> Iterator[pa.RecordBatch]:
    if span is None:  # of no files Spark asks for one empty partition
        return
    records = Records(span.path, options.get("encoding", "auto"))
    kind, header, head = "lines", [], ""
    if options.get("kind", "lines") == "auto":
        head = records.first()
        kind = kind_of(head)
        header = next(csv.reader([head]), []) if kind == "csv" else []
    rows: list[tuple] = []
    held = 0
    for start, record in records.between(span.lo, span.hi):
        if header:
            if start == records.begin and record == head:
                continue
            cells = next(csv.reader(io.StringIO(record)), [])
            record = json.dumps(dict(zip(header, [*cells, *[""] * len(header)], strict=False)), ensure_ascii=False, separators=(",", ":"))
        rows.append((span.path, start, kind, record))
        held += len(record)
        if held >= BATCH or len(rows) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def ranges(path: str, lo: int, hi: int, split: int) -> list[Range]:
    if path.endswith(".gz"):  # its content isn't addressed by the bytes of the file
        return [Range(path, 0, 1 << 62)] if hi > lo else []
    return [Range(path, at, min(at + split, hi)) for at in range(lo, hi, split)]


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Range]:
        split = int(self.options.get("splitbytes", SPLIT))
        return [r for path, size in sizes(self.options["path"]).items() for r in ranges(path, 0, size, split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read(partition, self.options)


class RecordStreamReader(DataSourceStreamReader):
    """Offsets: file → bytes that are read. A file that became shorter has a smaller number and is read from its beginning."""

    def __init__(self, options: dict[str, str]):
        self.options, self.seen = options, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in sizes(self.options["path"]).items():
            known = self.seen.get(path, 0)
            if path.endswith(".gz"):
                self.seen[path] = size
            elif size != known:
                self.seen[path] = Records(path, self.options.get("encoding", "auto")).complete(known if size > known else 0, size)
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        split = int(self.options.get("splitbytes", SPLIT))
        spans = ((path, start.get(path, 0), hi) for path, hi in sorted(end.items()))
        return [r for path, lo, hi in spans for r in ranges(path, lo if lo <= hi else 0, hi, split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read(partition, self.options)

    def commit(self, end: dict) -> None:
        pass


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> RecordReader:
        return RecordReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema: object) -> RecordStreamReader:
        return RecordStreamReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(RecordSource)
