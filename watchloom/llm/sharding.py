"""Extendible hashing: a directory indexed by the leading bits of a key's hash.

A bucket is the set of rows whose hash starts with the same bits. A bucket over the byte limit
splits on one more bit, no other bucket does, so a shard is the shortest prefix whose rows fit. Sizes
add up, hence all depths are summed at once instead of splitting round by round: rows are first
summed to cells of D bits (D from the total size), and the cells are rolled up to every shorter prefix. Cells
that are still over the limit at D bits are summed again at the full 60 bits and rolled up from there.

Only DataFrame functions run here. Defined results: a null key hashes as the text \\N; a null text
has 0 bytes; a row whose 60 bits are shared with rows that together exceed the limit (one long
text, or repeated keys) gets the shard of all 60 bits or the shallowest prefix that holds no other
hash, and fits is false; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_name, save

BITS = 60


def key_hash(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\\N"))), 1, 15), 16, 10).cast("bigint")


def _leaves(cells: DataFrame, width: int, limit: int, shortest: int) -> DataFrame:
    """cell, depth, bucket, bytes, n: for each cell the least depth at which its prefix fits or holds a single hash. Cells without one are left out."""
    every = cells.select("cell", "bytes", "n", "lo", "hi", F.explode(F.sequence(F.lit(shortest), F.lit(width))).alias("depth"))
    every = every.withColumn("bucket", F.expr(f"shiftright(cell, {width} - depth)"))
    sums = every.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    good = sums.filter((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))).drop("lo", "hi")
    # merged, as Spark would judge the exploded cells by their size before, and broadcast them
    least = every.select("cell", "depth", "bucket").hint("merge").join(good.hint("merge"), ["depth", "bucket"]).groupBy("cell").agg(F.min(F.struct("depth", "bucket", "bytes", "n")).alias("b"))
    return least.select("cell", "b.*")


def _cells(rows: DataFrame, cell: Column) -> DataFrame:
    return rows.groupBy(cell.alias("cell")).agg(F.sum("__bytes").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("__h").alias("lo"), F.max("__h").alias("hi"))


def entries(rows: DataFrame, limit: int, slack_bits: int = 4) -> tuple[DataFrame, DataFrame | None, int]:
    """The directory of rows (__h: 60-bit hash, __bytes) as (entries by cell, entries by whole hash, bits of a cell).

    An entry is cell, depth, bucket, bytes, n. Only cells that hold rows have one. Where cells are still over the limit, the
    hashes in them have an entry each in the second table.
    """
    total = rows.agg(F.coalesce(F.sum("__bytes"), F.lit(0))).first()[0]
    width = min(BITS, max(1, math.ceil(math.log2(max(1.0, total / limit))) + slack_bits))
    cell = F.shiftright("__h", BITS - width)
    cells = save(_cells(rows, cell), "shard-cells")
    top = save(_leaves(cells, width, limit, 0), "shard-entries")
    crowded = save(cells.filter((F.col("bytes") > limit) & (F.col("lo") < F.col("hi"))).select("cell"), "shard-crowded")
    if width == BITS or crowded.isEmpty():
        return top, None, width
    deep = _cells(rows.withColumn("__cell", cell).join(crowded.withColumnRenamed("cell", "__cell"), "__cell", "left_semi"), F.col("__h"))
    return top, save(_leaves(save(deep, "shard-deep"), BITS, limit, width + 1), "shard-deep-entries"), width


def directory(rows: DataFrame, limit: int, slack_bits: int = 4) -> DataFrame:
    """The buckets of rows (__h, __bytes): depth, bucket (the prefix), bytes, n, fits."""
    top, deep, _ = entries(rows, limit, slack_bits)
    found = top.drop("cell") if deep is None else top.drop("cell").unionByName(deep.drop("cell"))
    return found.distinct().withColumn("fits", F.col("bytes") <= limit)


def _hashed(docs: DataFrame, key_col: str, text_col: str, *keep: Column) -> DataFrame:
    return docs.select(*keep, key_hash(F.col(key_col)).alias("__h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("__bytes"))


def _placed(rows: DataFrame, slim: DataFrame, limit: int) -> DataFrame:
    """rows (with __h) and their __depth, __bucket, __size, __n. slim: __h, __bytes of the same rows.

    Each row looks its cell up. The entries are a written table whose size Spark knows: it is broadcast while that is small, else both sides are
    shuffled by cell, where a cell with very many rows can be split.
    """
    top, deep, width = entries(slim, limit)
    named = lambda t: t.select(F.col("cell").alias("__cell"), F.col("depth").alias("__depth"), F.col("bucket").alias("__bucket"), F.col("bytes").alias("__size"), F.col("n").alias("__n"))
    out = rows.withColumn("__cell", F.shiftright("__h", BITS - width)).join(named(top), "__cell")
    if deep is not None:
        out = out.unionByName(rows.withColumn("__cell", F.col("__h")).join(named(deep), "__cell"))
    return out.drop("__cell")


def _bits() -> Column:
    return F.when(F.col("__depth") == 0, "").otherwise(F.expr("right(lpad(bin(__bucket), 60, '0'), __depth)"))


def shard(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 26) -> DataFrame:
    """Every row's place: key_col, bytes, shard (its bits as 0/1 text), depth, shard_bytes, shard_rows, fits.

    limit: bytes of text in a shard at most.
    """
    rows = _hashed(docs, key_col, text_col, F.col(key_col).alias("__key"))
    found = _placed(rows, rows.drop("__key"), limit)
    return found.select(F.col("__key").alias(key_col), F.col("__bytes").alias("bytes"), _bits().alias("shard"), F.col("__depth").cast("int").alias("depth"), F.col("__size").alias("shard_bytes"), F.col("__n").alias("shard_rows"), (F.col("__size") <= limit).alias("fits"))


def write_shards(docs: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", limit: int = 1 << 26) -> None:
    """Writes the rows, repeated keys too, to one folder for each shard: shard=..., with an underscore more where that is a column already."""
    name = free_name(docs, "shard")
    rows = _hashed(docs, key_col, text_col, *(F.col(f"`{c}`") for c in docs.columns))
    found = _placed(rows, _hashed(docs, key_col, text_col), limit).withColumn(name, F.concat(F.lit("b"), _bits()))
    found.select(*(f"`{c}`" for c in docs.columns), name).repartition(name).write.partitionBy(name).parquet(path)
