"""Incremental reading by bookmarks, for batch runs; streams keep their own in a checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def high_water_mark_filter(objects: DataFrame, processed: DataFrame) -> DataFrame:
    """objects, processed: name, created. Newer than the newest processed; at the same time only unseen names."""
    top = processed.agg(F.max("created").alias("__top"))
    newer = objects.crossJoin(F.broadcast(top)).filter(F.col("__top").isNull() | (F.col("created") >= F.col("__top"))).drop("__top")
    return newer.join(processed.select("name", "created"), ["name", "created"], "left_anti")


def already_processed_filter(objects: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    return objects.join(processed.select(*keys), keys, "left_anti")


def processed_window_filter(objects: DataFrame, bounds: DataFrame, desired: Column, modified: str = "modified") -> DataFrame:
    """Modified since desired and outside the processed window (one row: lo, hi)."""
    m = F.col(modified)
    inside = F.coalesce(m.between(F.col("lo"), F.col("hi")), F.lit(False))
    return objects.crossJoin(F.broadcast(bounds.select("lo", "hi"))).filter((m >= desired) & ~inside).drop("lo", "hi")


def widened_window(bounds: DataFrame, read: DataFrame, modified: str = "modified") -> DataFrame:
    seen = read.agg(F.min(modified).alias("lo"), F.max(modified).alias("hi"))
    return bounds.select("lo", "hi").unionByName(seen).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def merge_range_bookmark(stored: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """keys, token, start_time, end_time: least start, greatest end, the newer token."""
    a = stored.select(*keys, *(F.col(c).alias(f"a_{c}") for c in ("token", "start_time", "end_time")))
    b = read.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ("token", "start_time", "end_time")))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("b_token", "a_token").alias("token"), F.least("a_start_time", "b_start_time").alias("start_time"), F.greatest("a_end_time", "b_end_time").alias("end_time"))


def retain_last_n(processed: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(key))
    return processed.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def last_key(processed: DataFrame, by: list[str], key: str, prefix: str = "") -> DataFrame:
    return processed.filter(F.col(key).startswith(prefix)).groupBy(*by).agg(F.max(key).alias(key))


def path_date(path: Column) -> Column:
    part = lambda k: F.regexp_extract(path, r"/(\d{4})/(\d{1,2})/(\d{1,2})/", k).try_cast("int")
    return F.when(path.rlike(r"/\d{4}/\d{1,2}/\d{1,2}/"), F.make_date(part(1), part(2), part(3)))


def path_date_filter(objects: DataFrame, path: str, since: str) -> DataFrame:
    return objects.withColumn("path_date", path_date(F.col(path))).filter(F.col("path_date") >= F.lit(since).cast("date")).orderBy("path_date", path)
