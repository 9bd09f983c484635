"""A landing folder for raw files, below the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one if that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return spark.conf.get("spark.checkpoint.dir")


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder below the shared one."""
    return f"{shared_folder(spark)}/watchloom/landing/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, text: Column, name: str) -> str:
    """Writes a text of each row, which may be several lines, to new files and returns their folder."""
    path = new_folder(df.sparkSession, name)
    df.select(text.alias("value")).write.text(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it again: it is computed once, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes all that was written below the shared folder, once the results that read it are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/watchloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
