"""Removal of repeated substrings by a hash-compared suffix sort, spread over Spark by anchors.

A byte goes if a string of length bytes that covers it starts anywhere else too. Sorting all suffixes of a corpus
in one place doesn't scale, so equal strings are first brought together:

1. Anchors. Of all windows of length bytes, each has one anchor: the gram of gram bytes in it with the least hash
   (the leftmost of equals). Equal windows have equal anchors at the same place, and windows next to
   each other mostly share theirs. So the anchor's hash is a shuffle key under which all copies of a window
   meet. A row is an anchor with the range of window starts it stands for; its context is the bytes of those windows.
2. Anchors whose hash comes once are done. Contexts with equal hashes are taken as copies of the least of them. Neighbouring
   copies make a run, and where the texts are read, the SHA-256 of every run and of what it copies must agree. If one
   doesn't, the whole search is done again with another hash.
3. Where an anchor has different contexts, one occurrence of each is fetched, and what follows and what precedes the
   anchor is suffix-sorted. Two suffixes are compared by their longest common extension, a binary search over prefix
   polynomial hashes, checked byte for byte; the sort is Python's merge sort with that comparison. In sorted order
   the extensions of neighbours tell which windows are equal on both sides.
4. Anchors with more than crowd different contexts (a common line or passage) don't meet in one task: see narrowed().
   Their contexts are dealt anew by the bytes that a range of their windows shares, until at most crowd are left to sort.

Defined results: a null text is empty; matches never cross documents; texts shorter than length lose nothing; repeated rows
repeat each other; ids may be null or repeated (rows are then numbered in a written copy of the table) and must be whole
numbers or texts of such; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cmp_to_key, reduce
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, discard, save, text_or_empty

LENGTH, GRAM = 200, 64
#: Window starts handled at once, so that the arrays of a very long text stay small.
CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15
#: A random odd number for each byte value, so that the polynomial hash has no small coefficients.
VALUES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOW = np.uint64(0xFFFFFFFF)


def _powers(n: int, base: int = BASE) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


#: A place has 10 bits for how many more starts an anchor stands for, and a chunk overlaps the next by a window.
MOST_STARTS, LONGEST = 1 << 10, 1 << 12
POWERS, INVERSE = _powers(CHUNK + LONGEST), _powers(CHUNK + LONGEST, pow(BASE, -1, 1 << 64))


def _valid(length: int, gram: int) -> None:
    if not 1 <= gram <= length < LONGEST or length - gram >= MOST_STARTS:
        raise ValueError(f"needs 1 <= gram <= length < {LONGEST} and length - gram < {MOST_STARTS}")


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes modulo 2**64 of all prefixes, the empty one first; along the last axis."""
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), dtype=np.uint64)
    np.cumsum(VALUES[data] * POWERS[: data.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first and last window start) of each anchor of a text."""
    every = []
    for base in range(0, max(0, len(data) - length + 1), CHUNK):
        part = np.frombuffer(data, dtype=np.uint8)[base : base + CHUNK + length - 1]
        h = prefix_hashes(part)
        h = (h[gram:] - h[:-gram]) * INVERSE[: len(part) - gram + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        order = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
        width, starts = length - gram + 1, len(part) - length + 1
        blocks = np.full(-(-len(order) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        blocks[: len(order)] = order
        blocks = blocks.reshape(-1, width)
        to_end = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        from_start = np.minimum.accumulate(blocks, axis=1).ravel()
        at = (np.minimum(to_end[:starts], from_start[width - 1 : width - 1 + starts]) & LOW).astype(np.int64)
        first = np.concatenate(([0], np.nonzero(np.diff(at))[0] + 1))
        last = np.concatenate((first[1:] - 1, [starts - 1]))
        every.append((h[at[first]], at[first] + base, first + base, last + base))
    if not every:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*every, strict=True))


def _pack(at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First start, number of further starts and the anchor's distance in one long."""
    return first << 20 | (last - first) << 10 | (at - first)


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = place >> 20
    return first + (place & 1023), first, first + (place >> 10 & 1023)


ANCHORS = "gram bigint, ctx bigint, doc bigint, place bigint"


def anchor_rows(docs: DataFrame, length: int, gram: int, salt: int = 0, bits: int = 64) -> DataFrame:
    """gram, ctx, doc, place of every anchor of key, text; ctx is a salted hash of so many bits of the context and its extents."""
    mask = (1 << bits) - 1

    def frame(parts: list) -> pd.DataFrame:
        h, ctx, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"gram": h.view(np.int64), "ctx": ctx.view(np.int64), "doc": doc, "place": place})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                h, at, first, last = anchors(data, length, gram)
                if len(h):
                    place = _pack(at, first, last)
                    seeds = ((place & 0xFFFFF) | salt << 20).tolist()
                    ctx = [xxhash.xxh3_64_intdigest(data[a : b + length], x) & mask for a, b, x in zip(first.tolist(), last.tolist(), seeds, strict=True)]
                    out.append((h, np.array(ctx, dtype=np.uint64), np.full(len(h), key, dtype=np.int64), place))
                if sum(len(x[0]) for x in out) > 200_000:
                    yield frame(out)
                    out = []
            if out:
                yield frame(out)

    return docs.select("key", "text").mapInPandas(run, ANCHORS)


def extension(a: bytes, b: bytes, ha: list[int], hb: list[int]) -> int:
    """Length of the longest common prefix: binary search over prefix hashes, then checked by the bytes."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if ha[mid] == hb[mid]:
            low = mid
        else:
            high = mid - 1
    if a[:low] != b[:low]:  # two different prefixes have one hash
        return next(k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    return low


def suffix_order(parts: list[bytes]) -> tuple[list[int], list[int]]:
    """(the parts in sorted order, each one's common extension with the one before)."""
    wide = max(map(len, parts))
    hashes = prefix_hashes(np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in parts), dtype=np.uint8).reshape(len(parts), wide)).tolist() if wide else [[0]] * len(parts)

    def compare(x: int, y: int) -> int:
        a, b = parts[x], parts[y]
        n = extension(a, b, hashes[x], hashes[y])
        if n == min(len(a), len(b)):
            return len(a) - len(b)
        return a[n] - b[n]

    order = sorted(range(len(parts)), key=cmp_to_key(compare))
    lcp = [0] + [extension(parts[x], parts[y], hashes[x], hashes[y]) for x, y in zip(order, order[1:], strict=False)]
    return order, lcp


def _classes(parts: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """For each length (rows) and part (columns) a number that equal prefixes of that length share."""
    order, lcp = suffix_order(parts)
    out = np.empty((len(lengths), len(parts)), dtype=np.int64)
    out[:, order] = np.cumsum(np.array(lcp)[None, :] < lengths[:, None], axis=1)
    return out


def repeated_starts(lefts: list[bytes], rights: list[bytes], length: int) -> np.ndarray:
    """[back, context]: whether the window that starts back bytes before the anchor is in another context too."""
    most = max(map(len, lefts))
    back = np.arange(most + 1)
    both = _classes([x[::-1] for x in lefts], back) * (len(lefts) + 2) + _classes(rights, length - back)
    has = (back[:, None] <= np.array([len(x) for x in lefts])) & (length - back[:, None] <= np.array([len(x) for x in rights]))
    both = np.where(has, both, -1 - np.arange(len(lefts)))
    order = np.argsort(both, axis=1, kind="stable")
    ranked = np.take_along_axis(both, order, axis=1)
    same = np.zeros(both.shape, dtype=bool)
    equal = ranked[:, 1:] == ranked[:, :-1]
    same[:, 1:] |= equal
    same[:, :-1] |= equal
    out = np.zeros(both.shape, dtype=bool)
    np.put_along_axis(out, order, same, axis=1)
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true."""
    edges = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.nonzero(edges == 1)[0].tolist(), (np.nonzero(edges == -1)[0] - 1).tolist(), strict=True))


SPANS = "doc bigint, start bigint, stop bigint"
CONTEXTS = "key bigint, doc bigint, place bigint, alone boolean, region binary"


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text the wanted contexts, with their bytes."""
    for pdf in batches:
        rows = []
        for doc, text, wanted in zip(pdf["key"], pdf["text"], pdf["wanted"], strict=True):
            data = text.encode("utf-8", "surrogatepass")
            for w in wanted:
                _, first, last = _unpack(w["place"])
                rows.append((w["gram"], doc, w["place"], w["alone"], data[first : last + w["length"]]))
        yield pd.DataFrame(rows, columns=["key", "doc", "place", "alone", "region"])


def _compare(length: int):
    """Spans repeated between the contexts of a key; rows come sorted by key."""

    def spans(group: list[tuple[int, int, bool, bytes]]) -> Iterator[tuple[int, int, int]]:
        marks = []
        for doc, place, alone, region in group:
            at, first, _ = _unpack(place)
            marks.append((doc, at, alone, region[: at - first], region[at - first :]))
        found = repeated_starts([m[3] for m in marks], [m[4] for m in marks], length)
        for k, (doc, at, alone, _, _) in enumerate(marks):
            if alone:  # the others are repeated wholly
                for a, b in _runs(found[:, k]):
                    yield doc, at - b, at - a + length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = [], None
        for pdf in batches:
            rows = []
            for k, *row in zip(pdf["key"].tolist(), pdf["doc"].tolist(), pdf["place"].tolist(), pdf["alone"].tolist(), pdf["region"], strict=True):
                if k != key and held:
                    rows += spans(held)
                    held = []
                key = k
                held.append(tuple(row))
            yield pd.DataFrame(rows, columns=["doc", "start", "stop"])
        if held:
            yield pd.DataFrame(list(spans(held)), columns=["doc", "start", "stop"])

    return run


def wanted_rows(docs: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """CONTEXTS rows of contexts (gram, n, one: doc and place of an occurrence), read from the texts."""
    w = F.struct("gram", "one.place", (F.col("n") == 1).alias("alone"), F.lit(length).alias("length"))
    lists = contexts.groupBy(F.col("one.doc").alias("key")).agg(F.collect_list(w).alias("wanted"))
    return docs.select("key", "text").join(lists, "key").mapInPandas(_fetch, CONTEXTS)


def narrowed(rows: DataFrame, length: int, gram: int, crowd: int, ways: int = 4) -> tuple[DataFrame, DataFrame]:
    """(spans, rows left to sort) of CONTEXTS rows whose keys have too many contexts for one task.

    A window is back bytes in front of its anchor, 0 <= back <= length - gram. All windows with back in low ... high hold the same
    bytes from low in front of the anchor to length - high behind its start. So the contexts of a key are cut to ranges of back and dealt
    anew by a hash of these common bytes: equal windows still meet, contexts that differ there part. Ranges shrink by ways each round. Of the
    contexts of a range, equal ones (same extents, same SHA-256 of their bytes) become one row, and each such copy is a span. A
    key with at most crowd rows is left to sort. At ranges of one window, all rows of a key are equal, but for collisions of its hash.
    """
    width, spans, left = length - gram + 1, [], []
    rows = save(rows.withColumn("low", F.lit(0)), "substring-crowded")
    while True:
        step = -(-width // ways)
        back, more = F.expr("place & 1023"), F.expr("shiftright(place, 10) & 1023")
        cut = rows.withColumns({"back": back, "least": back - more}).withColumn("low", F.explode(F.sequence(F.col("low"), F.col("low") + width - 1, F.lit(step))))
        cut = cut.withColumns({"b1": F.greatest("low", "least"), "b2": F.least(F.col("low") + step - 1, F.col("back"))}).filter("b1 <= b2")
        common = F.substring("region", F.col("back") - F.col("low") + 1, F.lit(length - step + 1))
        own = F.substring("region", F.col("back") - F.col("b2") + 1, length + F.col("b2") - F.col("b1"))
        start = F.shiftright("place", 20) + F.col("back") - F.col("b2")
        place = F.expr("shiftleft(start, 20) | shiftleft(b2 - b1, 10) | b2")
        cut = cut.withColumns({"start": start, "stop": start + F.col("b2") - F.col("b1") + length, "key": F.xxhash64("key", "low", common), "own": own})
        cut = cut.select("key", "low", "b1", "b2", "doc", "start", "stop", place.alias("place"), "alone", "own", F.unhex(F.sha2("own", 256)).alias("digest"))
        same = ["key", "low", "b1", "b2", "digest"]
        one = F.min(F.struct("doc", "place", "own")).alias("one")
        merged = save(cut.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.bool_and("alone").alias("alone"), one), "substring-narrowed")
        copies = merged.filter("n > 1").select(*same)
        spans.append(save(cut.filter("alone").join(copies, same, "left_semi").select("doc", "start", "stop"), "substring-copies"))
        # written, so that the join reads both sides plainly and Spark can split a key with very many rows
        sizes = save(merged.groupBy("key", "low").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "substring-sizes")
        held = merged.join(sizes, ["key", "low"]).select("key", "low", "one.doc", "one.place", (F.col("alone") & (F.col("n") == 1)).alias("alone"), F.col("one.own").alias("region"), "size")
        held = save(held, "substring-held")
        few = (F.col("size") <= crowd) | F.lit(step == 1)
        # ranges of one anchor are sorted apart
        left.append(held.filter(few).select(F.xxhash64("key", "low").alias("key"), "doc", "place", "alone", "region"))
        rows, width = held.filter(~few).drop("size"), step
        if step == 1 or rows.isEmpty():
            return reduce(DataFrame.unionByName, spans), reduce(DataFrame.unionByName, left)


def copied_runs(found: DataFrame, contexts: DataFrame, length: int) -> DataFrame:
    """doc, start, stop, of, shift: maximal runs of contexts in doc that copy, by their hash, document of at start + shift."""
    alike = found.join(contexts.filter("n > 1").select("gram", "ctx", "one"), ["gram", "ctx"])
    first, more = F.shiftright("place", 20), F.expr("shiftright(place, 10) & 1023")
    rows = alike.select("doc", first.alias("first"), (first + more).alias("last"), F.col("one.doc").alias("of"), (F.shiftright("one.place", 20) - first).alias("shift"))
    w = Window.partitionBy("doc").orderBy("first")
    joins = (F.lag("last").over(w) + 1 == F.col("first")) & (F.lag("of").over(w) == F.col("of")) & (F.lag("shift").over(w) == F.col("shift"))
    rows = rows.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    return rows.groupBy("doc", "run").agg(F.min("first").alias("start"), (F.max("last") + length).alias("stop"), F.min("of").alias("of"), F.min("shift").alias("shift"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = 256, salt: int = 0, bits: int = 64) -> DataFrame:
    """doc, start, stop, of, origin, gone for docs: key (unique), text.

    Rows with gone are spans to remove (they may overlap). Where of is given, the span is a copy, by its hash, of as many bytes of
    document of from origin on; these bytes have a row too, without gone. Both must prove equal.
    """
    _valid(length, gram)
    every = save(anchor_rows(docs, length, gram, salt, bits), "substring-anchors")
    grams = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("lo"), F.max("ctx").alias("hi"))
    again = save(grams.filter("n > 1").select("gram", (F.col("lo") != F.col("hi")).alias("mixed")), "substring-grams")
    found = save(every.join(again, "gram"), "substring-found")
    discard(every)
    contexts = found.groupBy("gram", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "place")).alias("one"), F.first("mixed").alias("mixed"))
    contexts = save(contexts.filter("mixed or n > 1"), "substring-contexts")
    mixed = contexts.filter("mixed")
    crowded = save(mixed.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > crowd).select("gram"), "substring-crowds")
    none = [F.lit(None).cast("bigint").alias(c) for c in ("of", "origin")]
    # read once from the texts, for both ways of sorting
    rows, others = save(wanted_rows(docs, mixed, length), "substring-regions"), []
    if not crowded.isEmpty():
        named = crowded.withColumnRenamed("gram", "key")
        spans, rest = narrowed(rows.join(named, "key", "left_semi"), length, gram, crowd)
        others, rows = [spans.select("*", *none, F.lit(True).alias("gone"))], rows.join(named, "key", "left_anti").unionByName(rest)
    sorted_out = rows.repartition("key").sortWithinPartitions("key").mapInPandas(_compare(length), SPANS).select("*", *none, F.lit(True).alias("gone"))
    runs = copied_runs(found, contexts, length)
    own = F.struct("doc", "start", "stop", F.when((F.col("of") != F.col("doc")) | (F.col("shift") != 0), F.col("of")).alias("of"), (F.col("start") + F.col("shift")).alias("origin"), F.lit(True).alias("gone"))
    source = F.struct(F.col("of").alias("doc"), (F.col("start") + F.col("shift")).alias("start"), (F.col("stop") + F.col("shift")).alias("stop"), "of", (F.col("start") + F.col("shift")).alias("origin"), F.lit(False).alias("gone"))
    both = F.array_compact(F.array(own, F.when((F.col("of") != F.col("doc")) | (F.col("shift") != 0), source)))
    return reduce(DataFrame.unionByName, [runs.select(F.explode(both).alias("r")).select("r.*"), sorted_out, *others])


def keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """key, text where ids are unique; else doc_id, text, key of a written copy, in which rows are numbered."""
    ids = docs.groupBy(F.col(id_col).cast("bigint").alias("key")).count().filter("key is null or count > 1")
    if ids.isEmpty():
        return docs.select(F.col(id_col).cast("bigint").alias("key"), text_or_empty(text_col).alias("text"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return save(rows.withColumn("key", F.monotonically_increasing_id()), "substring-rows")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the spans; touching ones are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


RESULT = "key bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, checks array<struct<of:bigint,origin:bigint,size:bigint,digest:binary>>"


def _finish(with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text, spans in zip(pdf["key"], pdf["text"], pdf["spans"], strict=True):
                data, spans = text.encode("utf-8", "surrogatepass"), spans if spans is not None else ()
                runs = merged([(s["start"], s["stop"]) for s in spans if s["gone"]])
                checks = [{"of": s["of"], "origin": s["origin"], "size": s["stop"] - s["start"], "digest": hashlib.sha256(data[s["start"] : s["stop"]]).digest()} for s in spans if s["of"] is not None]
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                row = (key, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), checks)
                rows.append((*row, rest) if with_text else row)
            yield pd.DataFrame(rows, columns=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "checks", *["kept"] * with_text])

    return run


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text_col: str = "text", id_col: str = "doc_id", crowd: int = 256, with_text: bool = False, hash_bits: tuple[int, ...] = (64, 64, 64)) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds the kept bytes.

    hash_bits: width of the context hash of each try, 64 bits from then on; another is needed only if different contexts of an anchor had one hash. It goes
    on until all copies are proved.
    """
    bounded_batches(docs.sparkSession)
    rows = keyed(docs, text_col, id_col)
    texts = rows.select("key", "text")
    for salt, bits in enumerate(chain(hash_bits, repeat(64))):
        # a set: what many documents copy is asked for once
        spans = repeated_spans(texts, length, gram, crowd, salt, bits).groupBy(F.col("doc").alias("key")).agg(F.collect_set(F.struct("start", "stop", "of", "origin", "gone")).alias("spans"))
        done = save(texts.join(spans, "key", "left").mapInPandas(_finish(with_text), RESULT + ", kept binary" * with_text), "substring-result")
        proofs = done.select(F.explode("checks").alias("c")).groupBy("c.of", "c.origin", "c.size").agg(F.min("c.digest").alias("lo"), F.max("c.digest").alias("hi"))
        if proofs.filter("lo <> hi").isEmpty():
            named = done.drop("checks")
            named = named.withColumn("doc_id", F.col("key")) if rows.columns[0] == "key" else named.join(rows.select("key", "doc_id"), "key")
            return named.select("doc_id", *[c for c in done.columns if c not in ("key", "checks")])
