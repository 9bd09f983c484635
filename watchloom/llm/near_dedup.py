"""SimHash near-deduplication with Golay-code fuzzy hashing.

Candidate search: fingerprints that differ in at most 4 bits agree wholly in one of five segments of 13
or 12 bits (pigeonhole). The other 51 or 52 bits hold two words of 23 bits, one of which has at most 2 of the
errors. So for each segment and word, the key is the segment's bits with the index of a Golay codeword near the
word (one or six of them): 10 tables, some 53 keys for a fingerprint, and no pair within 4 bits
is missed. Fingerprints with a common key are compared bit by bit.

Work inside a key's bucket: small buckets compare by shifting, larger ones grow trees that visit each fingerprint
once, so a bucket of n similar fingerprints gives n - 1 links and not n * n. A bucket with more than
split fingerprints is cut again by five blocks of its free bits, on one of which any linked pair agrees, and so on
with the bits that are still free, until its buckets are small enough.

Defined results: a null or blank text has the fingerprint zero, which is linked like any other; texts of
fewer than n words are one shingle; null ids are never the least of a component unless all are null; repeated
rows stay; ids are whole numbers or texts of such; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golay
from ._shared import bounded_batches, save
from .components import components

ERRORS, BITS = 4, 64
#: (first bit, width) of the segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """A bit is 1 if it is set in over half of the XXH64 of the n-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, ASCII white space splits
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-n])).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a : b - 1], seed) for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = np.array([fingerprint(t, n) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": pdf["id"], "fp": fps.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "id string, fp bigint").select(F.col("id").cast("bigint").alias("doc_id"), "fp")


def _bits(fps: np.ndarray, places: list[int]) -> np.ndarray:
    """The bits of the fingerprints at the given places, as one number."""
    out = np.zeros(len(fps), dtype=np.int64)
    for k, place in enumerate(places):
        out |= ((fps >> np.uint64(place)) & np.uint64(1)).astype(np.int64) << k
    return out


def _free(segment: int) -> list[int]:
    first, width = SEGMENTS[segment]
    return [b for b in range(BITS) if not first <= b < first + width]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key: table, bits of the segment and codeword index in one long."""
    rows, out = [], []
    for segment, (first, width) in enumerate(SEGMENTS):
        exact = ((fps >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.int64)
        free = _free(segment)
        for half in (0, 1):
            row, index = golay.keys(_bits(fps, free[23 * half : 23 * half + 23]))
            rows.append(row)
            out.append((np.int64(2 * segment + half) << np.int64(26)) | (exact[row] << np.int64(12)) | index)
    return np.concatenate(rows), np.concatenate(out)


def _grow(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """A forest of links in a bucket: each fingerprint is visited once, linked ones leave the rest at once."""
    a, b, left = [], [], fps
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= ERRORS
            if near.any():
                found = left[near]
                a += [int(x)] * len(found)
                b += found.tolist()
                front += list(found)
                left = left[~near]
    return a, b


def _links(group: np.ndarray, fps: np.ndarray, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by group."""
    starts = np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1, [len(group)]))
    sizes = np.diff(starts)
    a, b = [], []
    few = np.repeat((sizes > 1) & (sizes <= small), sizes)
    g, f = group[few], fps[few]
    for step in range(1, min(small, len(g))):
        same = g[step:] == g[:-step]
        if not same.any():
            break
        near = same & (np.bitwise_count(f[step:] ^ f[:-step]) <= ERRORS)
        a.append(f[:-step][near])
        b.append(f[step:][near])
    for k in np.nonzero(sizes > small)[0]:
        x, y = _grow(fps[starts[k] : starts[k + 1]])
        a.append(np.array(x, dtype=np.uint64))
        b.append(np.array(y, dtype=np.uint64))
    empty = np.zeros(0, dtype=np.uint64)
    return np.concatenate([*a, empty]), np.concatenate([*b, empty])


LINKS = "a bigint, b bigint, crowded boolean"


def _scanner(split: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Finds links in a partition sorted by key. Groups over split rows come out as (key, fp, crowded) instead."""

    def frame(a: np.ndarray, b: np.ndarray, crowded: bool) -> pd.DataFrame:
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64), "crowded": crowded}).drop_duplicates()

    def sized(k: np.ndarray, f: np.ndarray) -> Iterator[pd.DataFrame]:
        if split is not None and len(k):
            starts = np.concatenate(([0], np.nonzero(np.diff(k))[0] + 1, [len(k)]))
            over = np.repeat(np.diff(starts) > split, np.diff(starts))
            if over.any():
                yield frame(k[over], f[over], True)
                k, f = k[~over], f[~over]
        yield frame(*_links(k, f), False)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_k, held_f = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        known = None  # a crowded key whose rows go on
        for pdf in batches:
            k = np.concatenate((held_k, pdf["key"].to_numpy(np.int64)))
            f = np.concatenate((held_f, pdf["fp"].to_numpy(np.int64).view(np.uint64)))
            if not len(k):
                continue
            if known is not None and (more := int(np.searchsorted(k, known, "right"))):
                yield frame(k[:more], f[:more], True)
                k, f = k[more:], f[more:]
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if split is not None and len(k) - cut > split:
                known, cut = k[-1], len(k)
            if cut:
                yield from sized(k[:cut], f[:cut])
            held_k, held_f = k[cut:], f[cut:]
        if len(held_k):
            yield from sized(held_k, held_f)

    return scan


#: Bits of a deeper key that are a hash; those above hold the path: the segment, then the block of each cut.
HASH_BITS = 42
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def free_bits(path: tuple[int, ...]) -> list[int]:
    """The bits that don't yet agree in a bucket that was cut along path: its segment, then a block (every fifth free bit) each time."""
    free = _free(path[0])
    for block in path[1:]:
        free = [x for k, x in enumerate(free) if k % 5 != block]
    return free


def _paths(level: int) -> list[tuple[int, ...]]:
    return list(itertools.product(range(len(SEGMENTS)), *[range(5)] * level))


def _cutter(level: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Five rows for each row (key, fp) of a crowded bucket of a level: keys of the level below."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            key, fp = pdf["key"].to_numpy(np.int64), pdf["fp"].to_numpy(np.int64).view(np.uint64)
            path = key >> 27 if level == 0 else key >> HASH_BITS
            for p in np.unique(path).tolist():
                own, bits = path == p, free_bits(_paths(level)[p])
                for block in range(5):
                    mask = np.uint64(sum(1 << x for x in bits[block::5]))
                    h = (key[own].view(np.uint64) + np.uint64(block)) * MIX[0] ^ (fp[own] & mask) * MIX[1]
                    h = (h ^ (h >> np.uint64(32))) * MIX[0]
                    below = np.uint64(5 * p + block) << np.uint64(HASH_BITS) | h >> np.uint64(64 - HASH_BITS)
                    yield pd.DataFrame({"key": below.view(np.int64), "fp": fp[own].view(np.int64)})

    return cut


def links(fps: DataFrame, split: int = 4096) -> DataFrame:
    """a, b of fingerprints (fp, distinct) within 4 bits: a forest of every bucket, so all that is linked is connected."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            f = pdf["fp"].to_numpy(np.int64)
            for k in range(0, len(f), 20_000):
                row, key = keys(f[k : k + 20_000].view(np.uint64))
                yield pd.DataFrame({"key": key, "fp": f[k : k + 20_000][row]})

    schema, rows, found, level = "key bigint, fp bigint", fps.mapInPandas(spread, "key bigint, fp bigint"), [], 0
    while True:
        # with so few free bits a bucket can't hold more than split (or five, the least that is cut) fingerprints
        last = len(free_bits((0, *[0] * level))) <= max(5, split.bit_length() - 1)
        scanned = rows.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_scanner(None if last else split), LINKS)
        scanned = save(scanned, "near-links")
        found.append(scanned.filter(~F.col("crowded")).select("a", "b"))
        crowd = scanned.filter("crowded").select(F.col("a").alias("key"), F.col("b").alias("fp"))
        if last or crowd.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows, level = crowd.mapInPandas(_cutter(level), schema), level + 1


def near_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 4, split: int = 4096) -> DataFrame:
    """A row for each document: doc_id, fingerprint, component_id (the least id that it is linked with, itself included)."""
    marked = save(fingerprints(docs, text_col, id_col, n), "near-fingerprints")
    # copies meet before the search: each fingerprint is searched once
    distinct = save(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "near-distinct")
    roots = components(links(distinct.select("fp"), split))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = save(named.join(least, "root").select("fp", "component_id"), "near-components")
    return marked.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_near(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", n: int = 4) -> DataFrame:
    """The input's rows that stay, one document (the least id) of each component, with all their columns."""
    kept = near_dedup(docs, text_col, id_col, n).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep"))
    return docs.join(kept, docs[id_col].cast("bigint").eqNullSafe(F.col("__keep")), "left_semi")
