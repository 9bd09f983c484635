"""Tables in the shared folder, and small helpers that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words; every other character belongs to one.
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode a temporary one if that is unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='spark-')}")
    return spark.conf.get("spark.checkpoint.dir")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/watchloom/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, lost executors cost nothing. codec: of the files, if not the session's."""
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table of save() that nothing reads any more."""
    files = df.inputFiles()
    if files and "/watchloom/" in files[0]:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that save() has left below the shared folder, once the results that read it are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/watchloom")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name with as many underscores at its end as make it new to the table."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Bytes of rows that go to a Python worker at once, where the session has Spark's own limit.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches by bytes: ten thousand long texts in one batch would fill a worker's memory.

    It sets the session's limit, and only where that is Spark's default: the plans that need it run later, when their rows are asked for.
    """
    key, usual = "spark.sql.execution.arrow.maxBytesPerBatch", (str(64 << 20), f"{64 << 20}b")
    if spark.conf.get(key) in usual:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from MD5 over the parts (nulls as \\N), the same in every SQL engine."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
