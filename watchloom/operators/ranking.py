"""Ranks, top-k, pages, sequences and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prioritise_events(scored: DataFrame, by: list[str], score: str = "combined_score", tie: str = "id") -> DataFrame:
    """rank by falling score within the given keys (a tenant, a day): one global rank would need a single task."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)))


def rank_threats(threats: DataFrame, by: list[str], tie: str = "id") -> DataFrame:
    total = 0.4 * F.coalesce("anomaly_score", F.lit(0.0)) + 0.3 * F.coalesce("pattern_score", F.lit(0.0)) + 0.3 * 100 * F.coalesce("similarity", F.lit(0.0))
    return prioritise_events(threats.withColumn("combined_rank_score", total), by, "combined_rank_score", tie)


def top_n(df: DataFrame, score: str, n: int, tie: str, lowest: bool = False) -> DataFrame:
    return df.orderBy(F.asc(score) if lowest else F.desc(score), tie).limit(n)


def latest_n(df: DataFrame, n: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def fingerprint(timestamp: Column, rule: Column, agent: Column, message: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in (timestamp, rule, agent, F.substring(message, 1, 100))))


def first_by_fingerprint(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each key: an aggregation, so copies are dropped before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def sequence_intervals(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """Observed numbers merged into closed intervals."""
    islands = df.select(*by, F.col(seq).alias("s")).distinct().withColumn("__g", F.col("s") - F.row_number().over(Window.partitionBy(*by).orderBy("s")))
    return islands.groupBy(*by, "__g").agg(F.min("s").alias("first"), F.max("s").alias("last")).drop("__g")


def sequence_gaps(df: DataFrame, by: list[str], seq: str, size: Column | None = None) -> DataFrame:
    """Missing ranges between the intervals; with size also before the first and after the last, up to size - 1."""
    spans = sequence_intervals(df, by, seq)
    w = Window.partitionBy(*by).orderBy("first")
    inner = spans.withColumn("next", F.lead("first").over(w)).filter(F.col("next") > F.col("last") + 1).select(*by, (F.col("last") + 1).alias("first"), (F.col("next") - 1).alias("last"))
    if size is None:
        return inner
    ends = spans.groupBy(*by).agg(F.min("first").alias("lo"), F.max("last").alias("hi"))
    head = ends.filter("lo > 0").select(*by, F.lit(0).cast("bigint").alias("first"), (F.col("lo") - 1).alias("last"))
    tail = ends.filter(F.col("hi") < size - 1).select(*by, (F.col("hi") + 1).alias("first"), (size - 1).cast("bigint").alias("last"))
    return reduce(DataFrame.unionByName, (inner, head, tail))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """Rows of a page with total, the count of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def sort_fields(df: DataFrame, fields: list[str], allowed: list[str]) -> DataFrame:
    """fields: +name or -name."""
    order = []
    for f in fields:
        name = f.lstrip("+-")
        if name not in allowed:
            raise ValueError(f"{name} can't be sorted by")
        order.append(F.desc(name) if f.startswith("-") else F.asc(name))
    return df.orderBy(*order)


def prefix_page(kv: DataFrame, prefix: str, number: int, size: int) -> DataFrame:
    return kv.filter(F.col("key").startswith(prefix)).orderBy("key").offset((number - 1) * size).limit(size)


def merge_daily(parts: list[DataFrame]) -> DataFrame:
    """Union by name; merge_knowledge for tables that lack some of the columns."""
    return reduce(DataFrame.unionByName, parts)


def merge_knowledge(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def group_intersection(groups: Column, suspicious: list[str]) -> Column:
    return F.size(F.array_intersect(groups, F.array(*map(F.lit, suspicious))))


def snapshot_except(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys), keys, "left_anti")
