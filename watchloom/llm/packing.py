"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two in n (2048 as often as
it goes), longest first. Each piece is a sequence of its own, so no sequence crosses documents and
none needs padding; pieces of equal length form a bucket and are batched together.

Defined results: a null or empty text is the end token alone; repeated rows and null ids are packed
like any other, each row by itself; ids are whole numbers or texts of such; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._shared import bounded_batches

#: The word pattern of byte-level splitting, and what it comes to where no two white-space
#: characters are side by side.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORDS_APART = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
RUN = re.compile(r"\s\s")


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _listed(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The parts of data after all merges of a rank under below, the least rank first, the leftmost of equals."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(x + y, below), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@cache
def ranks_of(path: str) -> dict[bytes, int] | None:
    """bytes → id if the tokenizer is one whose merges are told by the ids alone, else None.

    That is so for a byte-level BPE without options that change merging, whose merged ids ascend and in which each token, encoded by ranks under
    its own, comes to the two parts of its listed merge. (Two neighbours that make up the token stood alone until its turn came, so they
    are what those bytes come to by themselves: the listed parts. Merging by rank is then merging by list.)
    """
    spec = json.loads(Tokenizer.from_file(path).to_str())
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(spec.get(k) for k in ("normalizer", "truncation", "padding")) or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk")):
        return None
    chars, vocab = _byte_chars(), model["vocab"]
    special = {t["content"] for t in spec.get("added_tokens") or []}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocab.get("".join(m), -1) for m in pairs]
    if made != sorted(set(made)) or set(chars) - set(vocab) or len(made) + len(chars) != len(set(vocab) - special):
        return None
    ranks = {bytes(chars[c] for c in token): k for token, k in vocab.items() if token not in special}
    for (x, y), k in zip(pairs, made, strict=True):
        if _listed(bytes(chars[c] for c in x + y), ranks, k) != [bytes(chars[c] for c in part) for part in (x, y)]:
            return None
    return ranks


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them, as little-endian unsigned 32-bit bytes.

    Where the merges are told by the ids alone (ranks_of), tiktoken encodes with the table of ranks, several times faster. Texts with an added
    token's string, and other tokenizers, go to the tokenizers library.
    """

    def __init__(self, path: str, ranks: dict[bytes, int] | None) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in json.loads(self.tokenizer.to_str()).get("added_tokens") or []]
        self.tight = self.any = None
        if ranks is not None:
            self.any, self.tight = (tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={}).encode_ordinary for p in (WORDS, WORDS_APART))

    def __call__(self, text: str) -> bytes:
        if self.any is None or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.any(text) if RUN.search(text) else self.tight(text)
        return np.array(ids, dtype="<u4").tobytes()


ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, ranks: dict[bytes, int] | None) -> Encoder:
    """Made once in each worker process."""
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path, ranks)
    return ENCODERS[path]


def piece_lengths(n: int, longest: int = 2048) -> list[int]:
    """The powers of two that make up n, the longest as often as it goes."""
    out = [longest] * (n // longest)
    left = n % longest
    return out + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, longest: int = 2048, with_ids: bool = False, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket.

    longest must be a power of two. with_ids adds the token ids themselves. bucket is the log2 of the
    length. sequence_id is unique and made without a shuffle.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    bounded_batches(docs.sparkSession)
    schema = PIECES + (", ids array<bigint>" if with_ids else "")
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    ranks = docs.sparkSession.sparkContext.broadcast(ranks_of(path))  # proved here once; as many entries as the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, ranks.value)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = encode(text or "") + end
                n, start = len(ids) // 4, 0
                for size in piece_lengths(n, longest):
                    piece = ids[4 * start : 4 * (start + size)]
                    row = (None if doc_id is None else int(doc_id), start, size, zlib.crc32(piece), n)
                    rows.append((*row, np.frombuffer(piece, dtype="<u4").astype(np.int64)) if with_ids else row)
                    start += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    pieces = source.mapInPandas(run, schema)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), _log2("length").cast("int").alias("bucket"))


def _log2(col: str) -> Column:
    return F.length(F.bin(F.col(col))) - 1


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes the sequences to a folder for each length, so that batches are made of equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
