"""Fill-in-middle transformation by secondary-sort assembly.

A document is cut into prefix, middle and suffix at points that hashes of its id name, and each part into pieces of a bounded
number of code points. A piece knows its document and its place in the output. The pieces are dealt out by document and sorted by
place within each partition (repartitionAndSortWithinPartitions, in its DataFrame form: repartition, then sortWithinPartitions), so a
task sees each output from front to back and feeds it, piece by piece, into an incremental digest or into the output text. For
restoration the output is parsed as it streams by: its marks tell where each part begins, the parts' pieces get
their place in the original text, and a second sort within the same partitions brings them there; nothing is shuffled twice.

Forms: plain (the text), psm (mark P, prefix, mark S, suffix, mark M, middle), spm (mark S, suffix, mark P, prefix, mark M, middle).

Defined results: a null text is empty, and an empty one is plain; so is a text that holds a mark. A null id is hashed as \\N. Repeated rows
(same id and text) each get their row, and rows that share an id but not the text are documents of their own; they are kept apart by
the SHA-256 of id and text and by the input partition, so that even a third of all rows may be the same row. An empty table gives
no rows; other columns are ignored. Ids are whole numbers or texts of such. restore() of an output without its marks gives null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, text_or_empty

#: Code points of a piece.
CHUNK = 1 << 15
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The marks of a form in the order of its output.
FORMS = {"plain": (), "psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: The place of a part in the original text.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: The place of a document's last row, which tells its facts.
LAST = 9

KEY = "key binary, part int"
PIECES = f"{KEY}, id string, form string, n bigint, prefix_chars bigint, middle_chars bigint, at bigint, piece string"
PARTS = f"{PIECES}, place int, digest string, copies bigint"
DIGESTS = "id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string"
OUTPUTS = "id string, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
TEXTS = "id string, form string, text string"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _keyed(rows: DataFrame, *content: str) -> DataFrame:
    """Adds key (digest of the id and what the row holds) and part (the input partition): together with the place they order the pieces."""
    fields = F.concat_ws("\0", *(F.coalesce(c, F.lit("\\N")) for c in ("id", *content)))
    return rows.withColumns({"key": F.unhex(F.sha2(fields, 256)), "part": F.spark_partition_id()})


def _numbers(seed: str) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the SHA-256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit("\\N"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]


def plan(text: str, h: tuple[int, int, int, int], plain_from: int = 90, spm_below: int = 20) -> tuple[str, int, int]:
    """(form, end of the prefix, end of the middle) of a text."""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or h[2] % 100 >= plain_from or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", a, b
    return ("spm" if h[3] % 100 < spm_below else "psm"), a, b


def cut(text: str, form: str, a: int, b: int, chunk: int = CHUNK) -> Iterator[str]:
    """The pieces of an output in order; a part's mark leads its first piece."""
    spans = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(text))}
    for mark in FORMS[form] or ("",):
        lo, hi = spans.get(mark, (0, len(text)))
        for at in range(lo, max(hi, lo + 1), chunk):
            yield (mark if at == lo else "") + text[at : min(at + chunk, hi)]


class Parser:
    """Reads an output piece by piece and tells (place, text) of its parts; whole is false until all marks have come."""

    def __init__(self, form: str):
        self.left, self.place, self.held = list(FORMS[form]), 0, ""

    @property
    def whole(self) -> bool:
        return not self.left

    def feed(self, piece: str) -> Iterator[tuple[int, str]]:
        data = self.held + piece
        while self.left and (at := data.find(self.left[0])) >= 0:
            if at:
                yield self.place, data[:at]
            mark = self.left.pop(0)
            self.place, data = PLACE[mark], data[at + len(mark) :]
        keep = len(PREFIX) - 1 if self.left else 0  # a mark may be cut between two pieces
        self.held, data = data[len(data) - keep :] if keep else "", data[: len(data) - keep] if keep else data
        if data:
            yield self.place, data

    def rest(self) -> Iterator[tuple[int, str]]:
        if self.held:
            yield self.place, self.held


def _frames(rows: Iterable[tuple], schema: str, most: int = 20_000, weight: int = 1 << 22) -> Iterator[pd.DataFrame]:
    """The rows as pandas tables of bounded size, whose numbers stay whole beside nulls."""
    numbers = {c: "Int64" for c, kind in (x.split() for x in schema.split(", ")) if kind == "bigint"}
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= weight:
            yield pd.DataFrame(held, columns=_names(schema)).astype(numbers)
            held, size = [], 0
    yield pd.DataFrame(held, columns=_names(schema)).astype(numbers)


def _stage(work: Callable[[Iterator], Iterable[tuple]], schema: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for mapInPandas from one of rows to tuples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(work(row for pdf in batches for row in pdf.itertuples(index=False)), schema)

    return run


def _documents(rows: Iterator) -> Iterator[tuple[tuple, Iterator]]:
    """(key and part) of each document in a sorted stream, with an iterator of its rows; it must be used up before the next."""
    return groupby(rows, key=lambda r: (r.key, r.part))


class Once:
    """A document's sorted rows without the repeated ones that stand side by side at each place; copies says how many the first place had."""

    def __init__(self, rows: Iterator, place: Callable):
        self.rows, self.place, self.copies = rows, place, 0

    def __iter__(self) -> Iterator:
        first = last = None
        for row in self.rows:
            at = self.place(row)
            first = at if first is None else first
            self.copies += at == first
            if at != last:
                yield row
            last = at


def _cut_rows(plain_from: int, spm_below: int) -> Callable[[Iterator], Iterator[tuple]]:
    def run(rows: Iterator) -> Iterator[tuple]:
        for row in rows:
            form, a, b = plan(row.text, (row.h1, row.h2, row.h3, row.h4), plain_from, spm_below)
            sizes = (None, None) if form == "plain" else (a, b - a)
            for at, piece in enumerate(cut(row.text, form, a, b)):
                yield row.key, row.part, row.id, form, len(row.text), *sizes, at, piece

    return run


#: A part's row has no facts, the last row of a document has them.
_NO_FACTS = (None,) * 5


def _assembled(rows: Iterator) -> Iterator[tuple]:
    """Streams outputs into digests and gives the parts that the outputs hold, at their place in the original text."""
    for key, own in _documents(rows):
        own, digest, parser, seq = Once(own, lambda r: r.at), hashlib.sha256(), None, 0
        for row in own:
            digest.update(row.piece.encode())
            parser = parser or Parser(row.form)
            for place, text in parser.feed(row.piece):
                yield *key, *_NO_FACTS, seq, text, place, None, None
                seq += 1
        for place, text in parser.rest():
            yield *key, *_NO_FACTS, seq, text, place, None, None
            seq += 1
        yield *key, row.id, row.form, row.n, row.prefix_chars, row.middle_chars, seq, None, LAST, digest.hexdigest(), own.copies


def _restored(rows: Iterator) -> Iterator[tuple]:
    """Streams the parts of each document, in the order of the original, into a digest."""
    for _, own in _documents(rows):
        digest = hashlib.sha256()
        for row in own:
            if row.place < LAST:
                digest.update(row.piece.encode())
        for _ in range(int(row.copies)):
            yield row.id, row.n, row.form, row.prefix_chars, row.middle_chars, row.digest, digest.hexdigest()


def _outputs(rows: Iterator) -> Iterator[tuple]:
    for _, own in _documents(rows):
        own = Once(own, lambda r: r.at)
        text = "".join([(row := r).piece for r in own])
        for _ in range(own.copies):
            yield row.id, row.n, row.form, row.prefix_chars, row.middle_chars, text


def _parsed(rows: Iterator) -> Iterator[tuple]:
    """The parts of given outputs."""
    for row in rows:
        parser, seq = Parser(row.form), 0
        for at in range(0, len(row.output), CHUNK):
            for place, text in parser.feed(row.output[at : at + CHUNK]):
                yield row.key, row.part, *_NO_FACTS, seq, text, place, None, None
                seq += 1
        for place, text in parser.rest():
            yield row.key, row.part, *_NO_FACTS, seq, text, place, None, None
            seq += 1
        yield row.key, row.part, row.id, row.form, None, None, None, seq, None, LAST, "whole" if parser.whole else "broken", None


def _texts(rows: Iterator) -> Iterator[tuple]:
    for _, own in _documents(rows):
        parts, copies = [], 0
        for row in own:
            if row.place < LAST:
                if not parts or parts[-1][0] != (row.place, row.at):
                    parts.append(((row.place, row.at), row.piece))
            else:
                copies += 1
        text = "".join(p for _, p in parts) if row.digest == "whole" else None
        for _ in range(copies):
            yield row.id, row.form, text


def sorted_pieces(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """The pieces of all outputs, dealt out by document and in the order of the output within each partition.

    Of the numbers below 100 that hashes of the ids give, those from plain_from on leave a text plain, those below spm_below put the suffix first.
    """
    bounded_batches(docs.sparkSession)
    rows = _keyed(docs.select(F.col(id_col).cast("string").alias("id"), text_or_empty(text_col).alias("text")), "text")
    pieces = rows.select("*", *_numbers(seed)).mapInPandas(_stage(_cut_rows(plain_from, spm_below), PIECES), PIECES)
    return pieces.repartition("key", "part").sortWithinPartitions("key", "part", "at")


def digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text restored from it, never held whole."""
    parts = sorted_pieces(docs, text_col, id_col, **options).mapInPandas(_stage(_assembled, PARTS), PARTS)
    out = parts.sortWithinPartitions("key", "part", "place", "at").mapInPandas(_stage(_restored, DIGESTS), DIGESTS)
    return out.select(F.col("id").cast("bigint").alias("doc_id"), *_names(DIGESTS)[1:])


def transform(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: the transformed texts, assembled from the sorted pieces."""
    out = sorted_pieces(docs, text_col, id_col, **options).mapInPandas(_stage(_outputs, OUTPUTS), OUTPUTS)
    return out.select(F.col("id").cast("bigint").alias("doc_id"), *_names(OUTPUTS)[1:])


def restore(outputs: DataFrame, output_col: str = "output", form_col: str = "form", id_col: str = "doc_id") -> DataFrame:
    """doc_id, form, text of a table of outputs: the parts are read off the marks and sorted to their place. A null output is empty."""
    bounded_batches(outputs.sparkSession)
    rows = outputs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(form_col, F.lit("plain")).alias("form"), text_or_empty(output_col).alias("output"))
    parts = _keyed(rows, "form", "output").mapInPandas(_stage(_parsed, PARTS), PARTS).repartition("key", "part")
    out = parts.sortWithinPartitions("key", "part", "place", "at").mapInPandas(_stage(_texts, TEXTS), TEXTS)
    return out.select(F.col("id").cast("bigint").alias("doc_id"), "form", "text")
