"""Conversation structure repair by Four-Russians block tables.

A repaired conversation is empty, or pairs of a user's and an assistant's row after at most one system row. Edits: Keep (0), Rerole to
user or assistant (3), Delete (4; a must for blank and duplicate rows), Insert an empty user or assistant row (3); a truncated row that
stays costs 3 more. Where the repair stands is one of four states, so what the rest of a conversation costs from each state is a vector of
four numbers. Less its last entry such a vector is one of a few dozen: they are numbered, and for every vector and every block of
WIDTH symbols (role and fault of a row) a table made once from the step rule holds the vector before the block and what it adds.

How it runs at any size: rows are put in order by range partitions, not by one task a conversation, and packed to chunks of at most CHUNK
symbols. The chunks of a conversation stream by from the last to the first, by lookups alone, and learn the vector behind them; then
from the first to the last, each block is expanded backward from the vector behind it and traced forward, taking of the edits on a cheapest path the one
whose initial is least. A row costs a byte here. At last rows and edits stream by in order into an incremental digest.

Faults, of which a row's first counts: blank (no character but white space), duplicate (an earlier row of the conversation has its role and text),
truncated (its last character that is no white space isn't one of .!?).

Defined results: rows come by turn (nulls first), then role and text; rows alike in all are copies, all but the first duplicates. A null role or
text is one space. The first character of a role counts (s, u, a, or another, which can't be kept; so can't an empty role). A null
conversation id is a conversation. Rows with copies = 0 aren't there, but their conversation has a row of zeros. An empty table gives no rows; other columns are
ignored. An audit is a string, so a conversation can have 2 ** 31 edits at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, save

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user's, after an assistant's.
START, SYSTEM, USER, DONE = range(4)
#: Where an inserted or reroled row leads, and its role.
LEADS = (USER, USER, DONE, USER)
NAMED = {USER: "user", DONE: "assistant"}
#: state → state of a kept row, for roles that begin with s, u, a or another character.
KEPT = ({START: SYSTEM}, {START: USER, SYSTEM: USER, DONE: USER}, {USER: DONE}, {})
ROLES = "sua"
#: A row's letter: role class + 4 * (0 sound, 1 truncated, 2 to delete).
LETTERS = "abcdefghijkl"
#: Symbols of the tables: 0 to delete, 1 to 4 sound by role class, 5 to 8 truncated.
SYMBOL = {letter: 0 if k >= 8 else k + 1 for k, letter in enumerate(LETTERS)}
SYMBOLS = 9
#: Symbols of a block, and of a chunk.
WIDTH, CHUNK = 4, 4096
END = (0, 6, 3, 0)
SPACES = r"\x20\x09-\x0D"

ORDERED = ("conv", "turn", "role", "text", "fault", "letter", "at", "chunk")
CHUNKS = "conv string, chunk bigint, letters string, behind int, last boolean"
AUDITS = "conv string, chunk bigint, audit string, state int, cost bigint, illegal bigint"
REPORT = "conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
ROWS = "conv string, place bigint, edit string, role string, text string"


def step(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """What the rest costs from each state before a row, from what it costs after it."""
    base = [DELETE + x for x in after]
    if symbol:
        more, role = TRUNCATED * (symbol > 4), (symbol - 1) % 4
        for state in range(4):
            base[state] = min(base[state], REROLE + more + after[LEADS[state]])
            if state in KEPT[role]:
                base[state] = min(base[state], KEEP + more + after[KEPT[role][state]])
    user, done = min(base[USER], INSERT + base[DONE]), min(base[DONE], INSERT + base[USER])
    return min(base[START], INSERT + user), min(base[SYSTEM], INSERT + user), user, done


class Tables:
    """The numbered vectors, and for each and every block of 1 to WIDTH symbols the vector before it and the cost it adds."""

    def __init__(self):
        self.vectors, number = [END], {END: 0}
        before, adds = [], []
        for vector in self.vectors:  # it grows while new vectors are found
            for symbol in range(SYMBOLS):
                found = step(vector, symbol)
                found, more = tuple(x - found[DONE] for x in found), found[DONE]
                if found not in number:
                    number[found] = len(self.vectors)
                    self.vectors.append(found)
                before.append(number[found])
                adds.append(more)
        one, more = np.array(before).reshape(-1, SYMBOLS), np.array(adds).reshape(-1, SYMBOLS)
        self.before, self.adds = {1: one}, {1: more}
        for width in range(2, WIDTH + 1):  # the first symbol of a block is taken last
            rest, cost = self.before[width - 1], self.adds[width - 1]
            self.before[width] = one[rest].transpose(0, 2, 1).reshape(len(one), -1)
            self.adds[width] = (more[rest] + cost[:, :, None]).transpose(0, 2, 1).reshape(len(one), -1)


@cache
def tables() -> Tables:
    return Tables()


def blocks(letters: str) -> list[tuple[int, ...]]:
    symbols = [SYMBOL[x] for x in letters]
    return [tuple(symbols[k : k + WIDTH]) for k in range(0, len(symbols), WIDTH)]


def code(block: tuple[int, ...]) -> int:
    out = 0
    for symbol in block:
        out = out * SYMBOLS + symbol
    return out


def backward(row: list[tuple[int, ...]], behind: int) -> tuple[list[int], int, int]:
    """(number of the vector behind each block, that before the first, cost added) by lookups."""
    table, out, cost = tables(), [], 0
    for block in reversed(row):
        out.append(behind)
        at = code(block)
        behind, cost = int(table.before[len(block)][behind, at]), cost + int(table.adds[len(block)][behind, at])
    return out[::-1], behind, cost


@lru_cache(maxsize=1 << 17)
def trace(block: tuple[int, ...], behind: int, state: int) -> tuple[str, int, int]:
    """(initials of the edits, state after them, their cost) of a block: expanded backward, then traced forward by least initials."""
    rest = [tables().vectors[behind]]
    for symbol in reversed(block):
        rest.append(step(rest[-1], symbol))
    rest.reverse()
    out, spent, at = [], 0, 0
    while at < len(block):
        symbol, here = block[at], rest[at][state]
        more, role = TRUNCATED * (symbol > 4), (symbol - 1) % 4
        moves = [("D", DELETE, at + 1, state), ("I", INSERT, at, LEADS[state])]
        if symbol and state in KEPT[role]:
            moves.append(("K", KEEP + more, at + 1, KEPT[role][state]))
        if symbol:
            moves.append(("R", REROLE + more, at + 1, LEADS[state]))
        edit, cost, at, state = next(m for m in moves if m[1] + rest[m[2]][m[3]] == here)
        out.append(edit)
        spent += cost
    return "".join(out), state, spent


def closing(state: int) -> str:
    """The insertions that end a conversation."""
    return {START: "", SYSTEM: "II", USER: "I", DONE: ""}[state]


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator:
    return (row for pdf in batches for row in pdf.itertuples(index=False))


def _tables_of(rows: Iterator[tuple], schema: str, most: int = 5_000, weight: int = 1 << 22) -> Iterator[pd.DataFrame]:
    names, held, size = [x.split()[0] for x in schema.split(", ")], [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= most or size >= weight:
            yield pd.DataFrame(held, columns=names)
            held, size = [], 0
    yield pd.DataFrame(held, columns=names)


def _stage(work: Callable[[Iterator], Iterator[tuple]], schema: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _tables_of(work(_rows(batches)), schema)

    return run


_NOTHING = object()


def _looked_up(rows: Iterator) -> Iterator[tuple]:
    """Chunks from a conversation's last to its first: the vector behind each."""
    now, behind = _NOTHING, 0
    for row in rows:
        last = row.conv != now
        if last:
            now, behind = row.conv, 0
        _, before, _ = backward(blocks(row.letters), behind)
        yield row.conv, row.chunk, row.letters, behind, last
        behind = before


def _illegal(letters: str, before: str) -> int:
    """Adjacent rows, the one before the chunk with its first, whose initials aren't su, ua or au."""
    roles = [(ROLES + "-")[LETTERS.index(x) % 4] for x in before + letters]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))


def _traced(rows: Iterator) -> Iterator[tuple]:
    """Chunks from a conversation's first to its last: their edits, and the state in which they begin."""
    now, state, before = _NOTHING, START, ""
    for row in rows:
        if row.conv != now:
            now, state, before = row.conv, START, ""
        own, begin, cost, parts = blocks(row.letters), state, 0, []
        behind, _, _ = backward(own, int(row.behind))
        for block, vector in zip(own, behind, strict=True):
            edits, state, spent = trace(block, vector, state)
            parts.append(edits)
            cost += spent
        if row.last:
            parts.append(closing(state))
            cost += INSERT * len(parts[-1])
        yield row.conv, row.chunk, "".join(parts), begin, cost, _illegal(row.letters, before)
        before = row.letters[-1]


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv_id, turn, role, text, copies: the rows with the faults that crc32(conv_id:turn) % 20 names.

    0 drops a row, 1 empties its text, 2 takes its .!? away, 3 repeats it, 4 makes its role user. Nulls are one space.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv_col, turn_col)]
    h = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(h == 0, 0).when(h == 3, 2).otherwise(1)
    return rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(h == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("copies"))


def in_order(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows counted: conv, turn, role, text, copies; the rows with fault, letter, at and chunk, numbered in order), both written once."""
    copies = F.lit(1) if copies_col is None else F.col(copies_col)
    named = rows.select(
        F.col(conv_col).cast("string").alias("conv"),
        F.col(turn_col).cast("bigint").alias("turn"),
        *(F.coalesce(F.col(c), F.lit(" ")).alias(name) for c, name in ((role_col, "role"), (text_col, "text"))),
        copies.cast("bigint").alias("copies"),
    )
    counted = save(named.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")), "conversation-rows")
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    words = F.sha2(F.concat(F.coalesce("conv", F.lit("\\N")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text"), 256)
    there = counted.filter("copies > 0").withColumns({"blank": blank, "words": F.unhex(words), "turns": F.struct(F.col("turn").isNotNull(), "turn")})
    # a group of equal rows may be very large: its least turn is combined before the shuffle, and the join reads a written table
    firsts = save(there.filter("not blank").groupBy("words").agg(F.min("turns").alias("first")), "conversation-firsts")
    each = there.join(firsts, "words", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    fault = F.when(F.col("blank"), "blank").when((F.col("copy") > 1) | (F.col("turns") != F.col("first")), "duplicate")
    fault = fault.when(~F.col("text").rlike(rf"[.!?][{SPACES}]*\z"), "truncated").otherwise("")
    initial = F.substring("role", 1, 1)
    role = F.coalesce(*(F.when(initial == x, k) for k, x in enumerate(ROLES)), F.lit(3))
    weight = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    each = each.withColumn("fault", fault).withColumn("letter", F.substring(F.lit(LETTERS), role + 4 * weight + 1, F.lit(1)))
    keys = ("conv", F.col("turn").asc_nulls_first(), "role", "text", "copy")
    dealt = each.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    # a row that must go needs no text any more
    dealt = dealt.withColumns({"text": F.when(weight < 2, F.col("text")), "chunk": F.floor(F.col("at") / CHUNK)})
    return counted, save(dealt.select(*ORDERED), "conversation-order")


def edits(ordered: DataFrame) -> DataFrame:
    """conv, chunk, audit, state, cost, illegal of every chunk."""
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "")
    chunks = ordered.groupBy("conv", "chunk").agg(letters.alias("letters"))
    looked = chunks.repartition("conv").sortWithinPartitions("conv", F.desc("chunk")).mapInPandas(_stage(_looked_up, CHUNKS), CHUNKS)
    return save(looked.sortWithinPartitions("conv", "chunk").mapInPandas(_stage(_traced, AUDITS), AUDITS), "conversation-edits")


def _replayed(rows: Iterator) -> Iterator[tuple]:
    """Of a stream in order: (conv, facts, None) at a conversation's counts and edits, (conv, None, (edit, role, text)) of every repaired row."""
    state, audit, at = START, "", 0

    def inserted() -> Iterator[tuple]:
        nonlocal state, at
        while at < len(audit) and audit[at] == "I":
            state, at = LEADS[state], at + 1
            yield "I", NAMED[state], ""

    for row in rows:
        if row.kind < 2:
            if row.kind == 1:
                state, audit, at = int(row.state), row.audit, 0
            yield row.conv, row, None
        else:
            edit, at = audit[at], at + 1
            if edit == "K":
                state = KEPT[ROLES.index(row.role[0])][state]
                yield row.conv, None, ("K", row.role, row.text)
            elif edit == "R":
                state = LEADS[state]
                yield row.conv, None, ("R", NAMED[state], row.text)
        if row.kind > 0:
            yield from ((row.conv, None, x) for x in inserted())


def _reported(rows: Iterator) -> Iterator[tuple]:
    now = _NOTHING
    for conv, facts, row in _replayed(rows):
        if conv != now:
            if now is not _NOTHING:
                yield now, *sums, "".join(audit), digest.hexdigest()
            now, sums, audit, digest, first = conv, [0] * 6, [], hashlib.sha256(), True
        if row:
            digest.update(f"{'' if first else chr(10)}{row[1]}:{row[2]}".encode())
            first = False
        elif facts.kind == 0:
            sums = [a + int(b) for a, b in zip(sums, (facts.gaps, facts.blank, facts.duplicate, facts.truncated, 0, 0), strict=True)]
        else:
            sums[4:] = sums[4] + int(facts.illegal), sums[5] + int(facts.cost)
            audit.append(facts.audit)
    if now is not _NOTHING:
        yield now, *sums, "".join(audit), digest.hexdigest()


def _repaired(rows: Iterator) -> Iterator[tuple]:
    now, place = _NOTHING, 0
    for conv, _, row in _replayed(rows):
        if conv != now:
            now, place = conv, 0
        if row:
            yield conv, place, *row
            place += 1


STREAM = {
    **{"kind": "int", "chunk": "bigint", "at": "bigint", "role": "string", "text": "string", "audit": "string", "state": "int", "cost": "bigint", "illegal": "bigint"},
    **{"gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint"},
}


def _stream(counted: DataFrame, ordered: DataFrame) -> DataFrame:
    """Counts of each conversation, then each chunk's edits and its rows, in order within partitions by conversation."""

    def part(df: DataFrame, kind: int, **columns: Column) -> DataFrame:
        columns = {"kind": F.lit(kind)} | columns
        return df.select("conv", *((columns[c] if c in columns else F.lit(None)).cast(t).alias(c) for c, t in STREAM.items()))

    def own(*names: str) -> dict[str, Column]:
        return {c: F.col(c) for c in names}

    turn = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0))
    zero = {c: F.lit(0) for c in ("gaps", "blank", "duplicate", "truncated")} | {"chunk": F.lit(-1)}
    spans = part(counted.groupBy("conv").agg(gaps.alias("gaps")), 0, **zero | own("gaps"))
    faults = ordered.groupBy("conv").agg(*(F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")))
    faults = part(faults, 0, **zero | own("blank", "duplicate", "truncated"))
    audits = part(edits(ordered), 1, **own("chunk", "audit", "state", "cost", "illegal"))
    rows = part(ordered, 2, **own("chunk", "at", "role", "text"))
    together = spans.unionByName(faults).unionByName(audits).unionByName(rows)
    return together.repartition("conv").sortWithinPartitions("conv", "chunk", "kind", "at")


def repair_report(rows: DataFrame, **columns: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation. columns: as in in_order()."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema[columns.get("conv_col", "conv_id")].dataType
    out = _stream(*in_order(rows, **columns)).mapInPandas(_stage(_reported, REPORT), REPORT)
    return out.select(F.col("conv").cast(kind).alias("conv_id"), *[x.split()[0] for x in REPORT.split(", ")[1:]])


def repaired(rows: DataFrame, **columns: str) -> DataFrame:
    """conv_id, place, edit, role, text of every row of the repaired conversations. columns: as in in_order()."""
    bounded_batches(rows.sparkSession)
    kind = rows.schema[columns.get("conv_col", "conv_id")].dataType
    out = _stream(*in_order(rows, **columns)).mapInPandas(_stage(_repaired, ROWS), ROWS)
    return out.select(F.col("conv").cast(kind).alias("conv_id"), "place", "edit", "role", "text")
