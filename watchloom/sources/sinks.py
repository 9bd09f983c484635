"""Sinks for alerts: files, named indexes, routed outputs, archives, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_NAME = r"^wl-[a-z0-9.-]+$"


def append_file_sink(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def index_sink(df: DataFrame, path: str, index: str | Column, pattern: str = INDEX_NAME) -> DataFrame:
    """Writes rows to a folder for each index and returns the rows whose index name is not allowed."""
    named = df.withColumn("index_name", F.lit(index) if isinstance(index, str) else index)
    fits = F.coalesce(F.col("index_name").rlike(pattern), F.lit(False))
    named.filter(fits).write.mode("append").partitionBy("index_name").json(path)
    return named.filter(~fits)


def routed(df: DataFrame, outputs: dict[str, Column]) -> DataFrame:
    """A row for each output whose check holds."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in outputs.items())))
    return df.withColumn("output", F.explode(names))


def routed_outputs(df: DataFrame, path: str, outputs: dict[str, Column]) -> None:
    routed(df, outputs).write.mode("append").partitionBy("output").json(path)


def enriched_alert_sink(df: DataFrame, original: list[str], analysis: list[str], path: str) -> None:
    df.select(F.struct(*original).alias("original_alert"), F.struct(*analysis).alias("ai_analysis"), F.current_timestamp().alias("processed_at")).write.mode("append").json(path)


def daily_snapshot_sink(new: DataFrame, seen: DataFrame | None, fingerprint: str, day: Column, path: str) -> None:
    rows = new.dropDuplicates([fingerprint])
    if seen is not None:
        rows = rows.join(seen.select(fingerprint), fingerprint, "left_anti")
    rows.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def raw_archive_sink(df: DataFrame, raw: str, day: Column, path: str) -> None:
    df.filter(F.length(raw) > 0).select(F.col(raw).alias("value"), day.alias("day")).write.mode("append").partitionBy("day").text(path)


def expired_days(spark: SparkSession, path: str, today: str, keep_days: int) -> list[str]:
    """Day partitions older than keep_days + 1, by name; a listing of folders, not of rows."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
    from datetime import date, timedelta

    limit = (date.fromisoformat(today) - timedelta(days=keep_days + 1)).isoformat()
    return sorted(n for n in names if n.startswith("day=") and n[4:] < limit)


def retention_delete(spark: SparkSession, path: str, today: str, keep_days: int) -> list[str]:
    gone = expired_days(spark, path, today, keep_days)
    for name in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone
