"""Approximate nearest neighbours by an inverted file: vectors are kept by the cell of their nearest centre, and a query looks into a few cells.

The centres are fitted by k-means over a bounded sample of the rows, but every row is in the index. A cell's rows lie in blocks of bounded
size, so a cell that holds a third of all rows is many blocks; queries meet blocks in an equi-join on the cell of two written tables. Work grows with rows
times queries times probes / cells, not with their product. recall() measures a result against the exact search, and tuned_probes() finds the
number of cells to look into. search.vector_topk stays the exact way.

Defined results: as in search.vector_topk: null, empty and odd vectors are left out, a vector of zeros is similar to nothing, ids may be null on the side of
the rows, equals go by id. An index holds vectors of one length, which is that of most rows unless it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.landing import stored
from .search import HITS, _ids, _merged, _near, _numbered, _whole, vector_topk

#: Cells at most, rows of the sample for each cell, and numbers in the sample at most: the bounds of what the driver fits.
CELLS, SAMPLE, NUMBERS = 4096, 32, 1 << 24
#: Rows of a block, and queries of one.
ROWS, QUERIES = 8192, 512
#: Numbers that a worker holds of rows until they fill a block, and of products and copies at once.
HELD, AT_ONCE = 1 << 22, 1 << 20
BLOCKS = "cell int, ids binary, known binary, vs binary"
ASKING = "asked int, queries binary, qs binary"


def unit(vectors: list | pd.Series) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    size = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(size > 0, size, 1)


def k_means(v: np.ndarray, cells: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Unit centres of unit vectors: each moves to the direction of the mean of its own; one without any takes the vector farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = v[rng.choice(len(v), size=min(cells, len(v)), replace=False)]
    for _ in range(rounds):
        near, own = np.empty(len(v)), np.empty(len(v), np.int64)
        for lo in range(0, len(v), 4096):  # the whole product would be rows times cells
            part = v[lo : lo + 4096] @ centres.T
            own[lo : lo + 4096], near[lo : lo + 4096] = part.argmax(axis=1), part.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        alone = np.flatnonzero(size[:, 0] == 0)
        centres = sums / np.where(size > 0, size, 1)
        centres[alone] = v[np.argsort(near)[: len(alone)]]
    return centres


@dataclass
class Index:
    """centres: one row a cell. blocks: cell, ids, known, vs (a block of its rows)."""

    centres: np.ndarray
    blocks: DataFrame


def build(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, length: int | None = None, seed: int = 0) -> Index:
    """The index of every row. cells: about the root of the number of rows if not given, CELLS at most; fitted on about SAMPLE rows for each, by a hash of the row."""
    rows = vectors.select(_numbered(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(_whole("v"))
    if length is None:
        top = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        length = top["n"] if top else 1
    rows = rows.filter(F.size("v") == length)
    n = rows.count()
    cells = max(1, min(CELLS, cells or int(np.sqrt(n)), n))
    most = max(cells, min(cells * SAMPLE, NUMBERS // length))
    share = min(1.0, most / max(n, 1))
    point = F.pmod(F.xxhash64(F.lit(seed), "id", F.col("v").cast("string")), F.lit(1 << 40)) / float(1 << 40)
    # equal rows have one hash: distinct, so that a very large group of copies can't fill the sample
    sample = rows.filter(point < share).select("v").distinct().limit(2 * most).toPandas()["v"]
    centres = k_means(unit(sample), cells, seed=seed) if len(sample) else np.zeros((1, length))
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # CELLS vectors at most

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of a task by cell; a cell's rows leave as soon as they fill a block."""
        held: dict[int, list[tuple]] = {}
        count = 0

        def packed(cells: list[int]) -> Iterator[pd.DataFrame]:
            for cell in cells:
                ids, known, v = (np.concatenate(x) for x in zip(*held.pop(cell), strict=True))
                yield pd.DataFrame([(cell, ids.tobytes(), known.tobytes(), v.tobytes())], columns=[x.split()[0] for x in BLOCKS.split(", ")])

        most = max(1, AT_ONCE // len(centres))
        for pdf in batches:
            for start in range(0, len(pdf), most):  # the whole product would be rows times cells
                few = pdf.iloc[start : start + most]
                v = unit(few["v"])
                (ids, known), own = _ids(few["id"]), (v @ shared.value.T).argmax(axis=1)
                for cell in np.unique(own).tolist():
                    at = np.flatnonzero(own == cell)
                    for lo in range(0, len(at), ROWS):
                        part = at[lo : lo + ROWS]
                        held.setdefault(cell, []).append((ids[part], known[part], v[part]))
                        if sum(len(x[0]) for x in held[cell]) >= ROWS:
                            yield from packed([cell])
                count += len(few)
                if count * length > HELD:  # all that is held goes, so a task holds a bounded number of rows
                    yield from packed([*held])
                    count = 0
        yield from packed([*held])

    return Index(centres, stored(rows.mapInPandas(assign, BLOCKS), "vector-index"))


def search(index: Index, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """query, id, similarity, rank of the k most similar rows in the probes cells nearest to each query (query, vector)."""
    length, probes = index.centres.shape[1], min(probes, len(index.centres))
    asked = queries.select(_numbered("query").alias("id"), F.col("vector").cast("array<double>").alias("v")).filter(_whole("v")).filter("id is not null")
    shared, cells_in_all = queries.sparkSession.sparkContext.broadcast(index.centres), len(index.centres)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        most = max(1, AT_ONCE // max(probes * length, cells_in_all))
        for pdf in batches:
            for lo in range(0, len(pdf), most):  # a query is copied for each cell that it looks into
                part = pdf.iloc[lo : lo + most]
                near = unit(part["v"]) @ shared.value.T
                cells = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
                yield pd.DataFrame({"asked": cells.ravel(), "id": np.repeat(part["id"].to_numpy(), probes), "v": [v for v in part["v"] for _ in range(probes)]})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cell, own in pdf.groupby("asked"):
                for lo in range(0, len(own), QUERIES):
                    part = own.iloc[lo : lo + QUERIES]
                    out.append((cell, _ids(part["id"])[0].tobytes(), unit(part["v"]).tobytes()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ASKING.split(", ")])

    each = asked.filter(F.size("v") == length).mapInPandas(probe, "asked int, id string, v array<double>")
    # queries of a cell side by side; a cell that very many ask is split by the queries' ids
    packed = stored(each.repartition("asked", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("asked").mapInPandas(pack, ASKING), "vector-queries")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                ids, known, q, vs, qs = (np.frombuffer(batch.column(c)[b].as_buffer(), kind) for c, kind in (("ids", np.int64), ("known", bool), ("queries", np.int64), ("vs", float), ("qs", float)))
                yield from _near(qs.reshape(len(q), length), q, vs.reshape(len(ids), length), ids, known, k)

    pairs = index.blocks.join(packed, F.col("cell") == F.col("asked")).drop("cell", "asked")
    return _merged(pairs.mapInArrow(score, HITS), k, 9).select("query", "id", F.col("score").alias("similarity"), "rank")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, recall: of the exact hits (query, id, similarity), the share for whose rank a hit as similar (to 6 digits) was found."""
    near = found.select("query", "rank", F.col("similarity").alias("got"))
    both = exact.select("query", "rank", "similarity").join(near, ["query", "rank"], "left")
    hit = F.coalesce(F.col("got") >= F.col("similarity") - 1e-6, F.lit(False))
    return both.agg(F.count_distinct("query").alias("queries"), F.try_divide(F.count_if(hit), F.count(F.lit(1))).alias("recall"))


def tuned_probes(index: Index, vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """The number of probes, doubled from 1, with which the recall over the given queries (a bounded set) reaches the least; all cells if none below does."""
    exact, probes = stored(vector_topk(vectors, queries, k, id_col, vector_col), "vector-exact"), 1
    while probes < len(index.centres):
        share = recall(search(index, queries, k, probes), exact).first()["recall"]
        if share is None or share >= least:
            return probes
        probes *= 2
    return len(index.centres)
