"""Secret scans over an incremental ledger of blobs.

A blob is a text, addressed by the SHA-256 of its UTF-8 bytes; versions of a file that are equal, under whatever path,
are one blob. The ledger has a row for each (blob, rule version) that was scanned, with the findings.
A run scans only pairs that the ledger lacks, appends them, and joins the findings back to every path.

Base rules: assign, access and hex. The method adds key (PEM private key headers) and web (three-part signed web tokens).

Defined results: a null text is the empty blob; offsets count code points, the end is exclusive; a blob
without findings has a ledger row too, so it isn't scanned again; repeated rows and null ids each get their row;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, save, text_or_empty

#: kind → (version, pattern, group whose length counts, least length); kinds in the order of ties
RULES = {
    "assign": (1, re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    "access": (1, re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (1, re.compile(r"[0-9a-f]{16,}"), 0, 16),
    "key": (1, re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"), 0, 1),
    "web": (1, re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII), 0, 1),
}
BASE = ("assign", "access", "hex")
LEDGER = "blob string, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def find(kind: str, text: str) -> list[tuple[int, int]]:
    """Spans of one rule, leftmost and without overlap; matches under the least length are dropped."""
    _, pattern, group, least = RULES[kind]
    return [m.span() for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for blob, text, kinds in zip(pdf["blob"], pdf["text"], pdf["kinds"], strict=True):
            for kind in kinds:
                spans = [{"start": a, "end": b} for a, b in find(kind, text)]
                rows.append((blob, kind, RULES[kind][0], spans))
        yield pd.DataFrame(rows, columns=["blob", "kind", "version", "spans"])


def _current() -> Column:
    """Whether a ledger row is of a rule's present version."""
    out = F.lit(False)
    for kind, rule in RULES.items():
        out = out | ((F.col("kind") == kind) & (F.col("version") == rule[0]))
    return out


def scan_unseen(docs: DataFrame, ledger: DataFrame | None, text_col: str = "text") -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that the ledger lacks, written once.

    Copies of a blob are combined before the shuffle, so each blob's text travels and is scanned once.
    """
    bounded_batches(docs.sparkSession)
    every = F.array(*(F.lit(kind) for kind in RULES))
    blobs = docs.select(F.sha2(text_or_empty(text_col), 256).alias("blob"), text_or_empty(text_col).alias("text")).dropDuplicates(["blob"])
    if ledger is None:
        todo = blobs.withColumn("kinds", every)
    else:
        seen = ledger.filter(_current()).groupBy("blob").agg(F.collect_set("kind").alias("seen"))
        kinds = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
        todo = blobs.join(seen, "blob", "left").select("blob", "text", kinds.alias("kinds")).filter(F.size("kinds") > 0)
    return save(todo.mapInPandas(_scan, LEDGER), "secret-ledger")


def at_paths(docs: DataFrame, ledger: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, blob, found (kind → spans) of every path, from a ledger that holds its blob."""
    found = ledger.filter(_current() & (F.size("spans") > 0)).groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("kind", "spans"))).alias("found"))
    # written, so that the join reads both sides plainly and Spark can split a blob with very many paths
    found = save(found, "secret-findings")
    paths = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text_or_empty(text_col), 256).alias("blob"))
    return paths.join(found, "blob", "left")


def scan(docs: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(findings for every path, the new ledger rows)."""
    new = scan_unseen(docs, ledger, text_col)
    return at_paths(docs, new if ledger is None else ledger.select(*new.columns).unionByName(new), text_col, id_col), new


def scan_in_steps(docs: DataFrame, historical: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Findings for every path of a table whose historical rows (half of the ids, if not given) are in the ledger before the others come."""
    past = F.coalesce(F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0 if historical is None else historical, F.lit(False))
    ledger = scan_unseen(docs.filter(past), None, text_col)
    return at_paths(docs, ledger.unionByName(scan_unseen(docs.filter(~past), ledger, text_col)), text_col, id_col)


def _entries(rank: int, kind: str):
    """(start, rank of the kind, kind:start:end) of each span of a kind."""
    spans = F.coalesce(F.try_element_at("found", F.lit(kind)), F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("text")))


def _joined(kinds: tuple[str, ...]):
    """kind:start:end of the given kinds by start, then kind, comma-joined."""
    parts = [_entries(rank, kind) for rank, kind in enumerate(RULES) if kind in kinds]
    return F.array_join(F.transform(F.sort_array(F.concat(*parts)), lambda s: s["text"]), ",")


def report(paths: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans from scan()'s findings."""
    count = [F.when(F.try_element_at("found", F.lit(k)).isNull(), 0).otherwise(F.size(F.try_element_at("found", F.lit(k)))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return paths.select("doc_id", *count, F.sha2(F.coalesce(_joined(BASE), F.lit("")), 256).alias("base_sha256"), F.coalesce(_joined(tuple(RULES)), F.lit("")).alias("spans"))


def blob_id(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
