"""Exact deduplication against an index of historical digests, held in minimal perfect hash shards.

The index has a row for each shard of digests. A shard's minimal perfect hash is a cascade of bit
arrays: a key takes the bit it hits alone, the others go on to the next array, and the rank of the
bit is the key's slot. A slot holds the whole digest, the locator (id) of the winner and the number
of rows seen. A lookup compares all 32 bytes of the digest, so a key that is no member never passes.

Defined results: a null text counts as empty; of equal texts the row with the largest id stays (null
ids are smaller than any other; if all are null, keep_id is null and every such row is kept); rows
that share both id and text are one document and are kept or dropped together; ids are whole numbers or texts of
such; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import save, text_or_empty

INDEX = "shard int, bits array<binary>, digests binary, ids array<bigint>, sizes array<bigint>"
ODD = np.uint64(0x9E3779B97F4A7C15)


def _words(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, dtype="<u8").reshape(-1, 4)


def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of each key in the bit array of a level; all 256 bits of the digest take part."""
    with np.errstate(over="ignore"):
        x = words[:, 0] + np.uint64(level) * ODD
        for k in (1, 2, 3):
            x = (x ^ (x >> np.uint64(29))) * ODD + words[:, k] * np.uint64(2 * level + 1)
        x = (x ^ (x >> np.uint64(32))) * ODD
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


def build_hash(digests: bytes) -> list[bytes]:
    """The bit arrays of a minimal perfect hash over distinct digests of 32 bytes each."""
    left, out = _words(digests), []
    while len(left):
        size = -(-max(64, 2 * len(left)) // 8) * 8
        at = _place(left, len(out), size)
        alone = np.bincount(at, minlength=size) == 1
        out.append(np.packbits(alone).tobytes())
        left = left[~alone[at]]
    return out


def slots(bits: list[bytes], digests: bytes) -> np.ndarray:
    """The slot of each digest; keys that were not built in may get any slot or -1."""
    words = _words(digests)
    found, left, before = np.full(len(words), -1, dtype=np.int64), np.arange(len(words)), 0
    for level, packed in enumerate(bits):
        array = np.unpackbits(np.frombuffer(packed, dtype=np.uint8))
        rank = np.cumsum(array)
        at = _place(words[left], level, len(array))
        hit = array[at] == 1
        found[left[hit]] = before + rank[at[hit]] - 1
        before += int(rank[-1])
        left = left[~hit]
    return found


def lookup(bits: list[bytes], held: bytes, digests: bytes) -> np.ndarray:
    """The slot of each digest that is a member, byte for byte, else -1."""
    found = slots(bits, digests)
    if not held:
        return np.full(len(found), -1, dtype=np.int64)
    same = (_words(held)[np.maximum(found, 0)] == _words(digests)).all(axis=1)
    return np.where(same, found, -1)


def digest_of(text: str | Column) -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def groups_of(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each distinct text: digest, largest id, number of rows. Combined before the shuffle."""
    rows = docs.select(digest_of(text_col).alias("digest"), F.col(id_col).cast("bigint").alias("id"))
    return rows.groupBy("digest").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("size"))


def _shard(n: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int").alias("shard")


def build_index(groups: DataFrame, n_shards: int) -> DataFrame:
    """A minimal perfect hash with its slots for each shard of the historical groups."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        digests = b"".join(pdf["digest"])
        bits = build_hash(digests)
        order = np.argsort(slots(bits, digests))
        ids = [None if pd.isna(x) else int(x) for x in pdf["id"].to_numpy()[order]]
        held = _words(digests)[order].tobytes()
        return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "bits": bits, "digests": held, "ids": ids, "sizes": pdf["size"].to_numpy()[order].tolist()}])

    return groups.select(_shard(n_shards), "digest", F.col("id").cast("string"), "size").groupBy("shard").applyInPandas(build, INDEX)


def probe(index: DataFrame, arrivals: DataFrame, n_shards: int) -> DataFrame:
    """digest, id, size, member: the slots of the index, and every arrival, a member if its digest is in a slot byte for byte."""

    def find(history: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        digests, ids, sizes, member = new["digest"].tolist(), new["id"].tolist(), new["size"].tolist(), [False] * len(new)
        if len(history):
            row = history.iloc[0]
            bits, held = list(row["bits"]), row["digests"]
            if len(new):
                member = (lookup(bits, held, b"".join(digests)) >= 0).tolist()
            digests += [bytes(held[k : k + 32]) for k in range(0, len(held), 32)]
            ids += [None if pd.isna(x) else str(int(x)) for x in row["ids"]]
            sizes += list(row["sizes"])
            member += [True] * len(row["sizes"])
        return pd.DataFrame({"digest": digests, "id": pd.Series(ids, dtype=object), "size": sizes, "member": member})

    new = arrivals.select(_shard(n_shards), "digest", F.col("id").cast("string"), "size")
    out = index.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(find, "digest binary, id string, size bigint, member boolean")
    return out.withColumn("id", F.col("id").cast("bigint"))


#: Rows of a digest that arrive at a shard, at most.
ARRIVALS = 64


def winners(docs: DataFrame, historical: Column, text_col: str = "text", id_col: str = "doc_id", shard_rows: int = 32768) -> DataFrame:
    """digest, keep_id, group_size of every distinct text.

    Rows for which historical holds are indexed first, the others arrive later. Copies among the arrivals of a digest are combined to
    at most 64 rows before they look it up. Members then raise the size and the winner of their slot, nonmembers are grouped apart. shard_rows is
    the mean number of rows in a shard, of the larger of both sides (digests in the history, combined arrivals), which bounds what a task holds.
    """
    past = F.coalesce(historical, F.lit(False))
    history = save(groups_of(docs.filter(past), text_col, id_col), "exact-history")
    rows = docs.filter(~past).select(digest_of(text_col).alias("digest"), F.col(id_col).cast("bigint").alias("id"))
    parts = rows.groupBy("digest", F.pmod(F.xxhash64("id"), F.lit(ARRIVALS)).alias("part"))
    new = save(parts.agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("size")).drop("part"), "exact-arrivals")
    n = max(1, -(-max(history.count(), new.count()) // shard_rows))
    index = save(build_index(history, n), "exact-index")
    found = save(probe(index, new, n), "exact-probed")
    grouped = lambda part: part.groupBy("digest").agg(F.max("id").alias("keep_id"), F.sum("size").alias("group_size"))
    return save(grouped(found.filter("member")).unionByName(grouped(found.filter("not member"))), "exact-winners")


def exact_dedup(docs: DataFrame, historical: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    if historical is None:
        historical = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
    won = winners(docs, historical, text_col, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), digest_of(text_col).alias("digest"))
    return rows.join(won, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_exact(docs: DataFrame, historical: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The input's rows that stay, with all their columns. Texts travel by id, so no group of copies meets in a task."""
    if historical is None:
        historical = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0
    won = winners(docs, historical, text_col, id_col).select(F.col("keep_id").alias("__keep"), F.col("digest").alias("__digest"))
    return docs.join(won, docs[id_col].cast("bigint").eqNullSafe(F.col("__keep")) & (digest_of(docs[text_col]) == F.col("__digest")), "left_semi")
