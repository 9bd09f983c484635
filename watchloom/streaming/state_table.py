"""A keyed table that a stream keeps up to date: foreachBatch into hash buckets, with a manifest that names each bucket's files and the last batch.

A batch reads and rewrites only the buckets that its keys fall in, into a folder of its own, and then replaces the manifest in one rename. So a reader sees a
batch whole or not at all; a batch that was cut off leaves files that no manifest names and that its repetition overwrites; a batch that the manifest already holds
changes nothing. Rows carry an order (an offset or a time): of a key the greatest wins, whatever the order of arrival, and a deletion stays as
a row that readers don't see, so a late older change doesn't bring the key back.

Defined results: null keys are a key; of changes with one order the last operation by its name and fields wins, in any batch; an empty batch only moves the manifest on.
The driver holds the manifest: a number for each bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

BUCKET, DELETED = "__bucket", "__deleted"


class StateTable:
    """path: a folder that all executors share. order: the column by which changes of a key follow each other. fields: all other columns of the table."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, schema: str | StructType, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.schema = spark.createDataFrame([], schema).schema
        jvm = spark.sparkContext._jvm
        self._file = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._system = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """batch: the last one that is in, -1 at first; versions: bucket → the batch that wrote it."""
        found = [p for p in ("manifest", "manifest.old") if self._system.exists(self._file(p))]
        if not found:
            return {"batch": -1, "versions": {}, "buckets": self.buckets}
        text = self.spark.read.text(f"{self.path}/{found[0]}", wholetext=True).first()[0]
        held = json.loads(text)
        if held["buckets"] != self.buckets:
            raise ValueError(f"the table has {held['buckets']} buckets")
        return held

    def _put(self, manifest: dict) -> None:
        """Writes the manifest beside the old one; between the two renames a reader takes the old one."""
        new, now, old = (self._file(f"manifest{s}") for s in (".new", "", ".old"))
        out = self._system.create(new, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._system.delete(old, False)
        if self._system.exists(now):
            self._system.rename(now, old)
        self._system.rename(new, now)

    def _stored(self) -> StructType:
        return StructType([*self.schema.fields]).add(DELETED, "boolean").add(BUCKET, "integer")

    def _rows(self, versions: dict[str, int]) -> DataFrame:
        paths = [f"{self.path}/data/batch={v}/{BUCKET}={b}" for b, v in versions.items()]
        if not paths:
            return self.spark.createDataFrame([], self._stored())
        return self.spark.read.schema(self._stored()).option("basePath", f"{self.path}/data").parquet(*paths).select(*self._stored().names)

    def read(self) -> DataFrame:
        """The rows of the table as the last batch left it."""
        return self._rows(self.manifest()["versions"]).filter(f"not {DELETED}").drop(DELETED, BUCKET)

    def apply(self, changes: DataFrame, batch: int, deleted: str = "false") -> bool:
        """Merges a batch of rows of the table; deleted: a condition on them. False if the batch is in already."""
        held = self.manifest()
        if batch <= held["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("\0null")) for k in self.keys)), F.lit(self.buckets)).cast("int")
        rows = changes.withColumn(DELETED, F.coalesce(F.expr(deleted), F.lit(False))).select(*self.schema.names, DELETED).withColumn(BUCKET, bucket)
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # as many numbers as there are buckets at most
        if touched:
            before = self._rows({b: v for b, v in held["versions"].items() if int(b) in touched})
            fields = [c for c in self._stored().names if c not in (*self.keys, BUCKET)]
            best = F.max(F.struct(self.order, *[c for c in fields if c != self.order])).alias("best")
            merged = before.unionByName(rows).groupBy(BUCKET, *self.keys).agg(best).select(*self.keys, *(F.col(f"best.{c}").alias(c) for c in fields), BUCKET)
            merged.select(*self._stored().names).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/batch={batch}")
        versions = held["versions"] | {str(b): batch for b in touched}
        self._put({"batch": batch, "versions": versions, "buckets": self.buckets})
        return True

    def follow(self, stream: DataFrame, checkpoint: str, deleted: str = "false", trigger: dict | None = None) -> StreamingQuery:
        """Starts a stream of changes into the table; by default it ends with what is there."""
        write: Callable[[DataFrame, int], bool] = lambda df, batch: self.apply(df, batch, deleted)
        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def vacuum(self) -> list[int]:
        """Deletes the folders of batches that the manifest doesn't name any more, when no reader needs them; their numbers."""
        held, folder = self.manifest(), self._file("data")
        if not self._system.exists(folder):
            return []
        used, gone = set(held["versions"].values()), []
        for status in self._system.listStatus(folder):
            number = int(status.getPath().getName().removeprefix("batch="))
            if number not in used and number <= held["batch"]:
                self._system.delete(status.getPath(), True)
                gone.append(number)
        return sorted(gone)
