"""Seen items against a very long history: a Bloom filter for each hash bucket, stored beside the history and extended by each run.

An arriving item meets the filter of its bucket. What the filter doesn't know is new for sure; only the possible members are joined, and of the history only
their buckets are read. So the history is never shuffled or scanned as a whole: a run costs its arrivals, the filters, and the buckets of possible
members. False alarms of the filter cost a join, never a row: what the join doesn't find is new too.

Layout below the folder: keys/run=…/bucket=… (Parquet of the keys that a run added) and filters/run=… (one row a bucket: the bits). A run writes both under its own number
and then a mark; files of a run without a mark aren't read and are overwritten when the run is repeated.

Defined results: null keys are an item; equal items of one run are all reported as new but kept once; an empty table adds nothing. A filter holds SIZE bits and serves some
SIZE / 10 keys at a false alarm rate of about one in a hundred; fuller ones only alarm more often. More buckets keep filters small.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .landing import stored

#: Bits of a bucket's filter, and hashes of a key.
SIZE, HASHES = 1 << 20, 7
FILTERS = "bucket int, bits binary"


def positions(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key, [key, HASHES], from its 64-bit hash by double hashing."""
    h = hashes.astype(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return ((low[:, None] + np.arange(HASHES, dtype=np.uint64) * high[:, None]) % np.uint64(size)).astype(np.int64)


class History:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64, size: int = SIZE):
        self.spark, self.path, self.keys, self.buckets, self.size = spark, path.rstrip("/"), keys, buckets, size
        jvm = spark.sparkContext._jvm
        self._file = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._system = self._file("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        """The runs that are marked as complete."""
        if not self._system.exists(self._file("done")):
            return []
        return sorted(s.getPath().getName() for s in self._system.listStatus(self._file("done")))

    def _hash(self) -> Column:
        parts = [F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in self.keys]
        return F.xxhash64(*parts)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("hash", self._hash()).withColumn("bucket", F.pmod(F.col("hash"), F.lit(self.buckets)).cast("int"))

    def filters(self) -> DataFrame:
        """bucket, bits: a row for each bucket and run; the bits of a bucket are the union of its rows."""
        paths = [f"{self.path}/filters/run={r}" for r in self.runs()]
        return self.spark.read.schema(FILTERS).parquet(*paths) if paths else self.spark.createDataFrame([], FILTERS)

    def possible(self, rows: DataFrame) -> DataFrame:
        """rows with hash, bucket, possible: whether the filter of the bucket knows the key.

        A bucket's filters come first in its part of the sorted stream, so a task holds one filter and a batch of hashes.
        """
        placed = stored(self._placed(rows), "history-arrivals")
        size = self.size

        def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, known = None, np.zeros(size, bool)
            for pdf in batches:
                out = []
                for bucket, own in pdf.groupby("bucket", sort=False):
                    if bucket != now:
                        now, known = bucket, np.zeros(size, bool)
                    for bits in own.loc[own["kind"] == 0, "bits"]:
                        known |= np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
                    hashes = own.loc[own["kind"] == 1, "hash"].to_numpy(np.int64)
                    if len(hashes):
                        out.append(pd.DataFrame({"hash": hashes, "possible": known[positions(hashes, size)].all(axis=1)}))
                yield pd.concat(out) if out else pd.DataFrame({"hash": np.empty(0, np.int64), "possible": np.empty(0, bool)})

        asked = placed.select("bucket", "hash").distinct()
        stream = self.filters().select("bucket", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("hash"), "bits")
        stream = stream.unionByName(asked.select("bucket", F.lit(1).alias("kind"), "hash", F.lit(None).cast("binary").alias("bits")))
        told = stream.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInPandas(test, "hash bigint, possible boolean")
        return placed.join(stored(told, "history-told"), "hash")

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is in no complete run, with all their columns."""
        marked = stored(self.possible(rows), "history-marked")
        maybe = marked.filter("possible")
        used = sorted(r[0] for r in maybe.select("bucket").distinct().collect())  # as many as there are buckets at most
        paths = [p for r in self.runs() for b in used if self._system.exists(self._file(p := f"keys/run={r}/bucket={b}"))]
        if not paths:
            return marked.select(*rows.columns)
        seen = self.spark.read.schema(rows.select(*self.keys).schema).parquet(*(f"{self.path}/{p}" for p in paths))
        seen = seen.select(*(F.col(k).alias(f"seen_{k}") for k in self.keys))
        same = [F.col(k).eqNullSafe(F.col(f"seen_{k}")) for k in self.keys]
        return marked.filter("not possible").select(*rows.columns).unionByName(maybe.join(seen, same, "left_anti").select(*rows.columns))

    def extend(self, rows: DataFrame, run: str | None = None) -> None:
        """Adds the keys of rows under a run's name; a run that is complete isn't added again."""
        run = run or uuid.uuid4().hex
        if run in self.runs():
            return
        keys = self._placed(rows.select(*self.keys).distinct())
        keys.select(*self.keys, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/run={run}")
        size = self.size

        def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, known = None, np.zeros(size, bool)
            for pdf in batches:
                done = []
                for bucket, own in pdf.groupby("bucket", sort=False):
                    if bucket != now:
                        if now is not None:
                            done.append((now, np.packbits(known).tobytes()))
                        now, known = bucket, np.zeros(size, bool)
                    known[positions(own["hash"].to_numpy(np.int64), size).ravel()] = True
                yield pd.DataFrame(done, columns=["bucket", "bits"])
            if now is not None:
                yield pd.DataFrame([(now, np.packbits(known).tobytes())], columns=["bucket", "bits"])

        dealt = keys.select("bucket", "hash").repartition("bucket").sortWithinPartitions("bucket")
        dealt.mapInPandas(build, FILTERS).write.mode("overwrite").parquet(f"{self.path}/filters/run={run}")
        self._system.create(self._file(f"done/{run}"), True).close()

    def false_alarms(self, rows: DataFrame) -> float | None:
        """Of rows that are in no run, the share that the filters take for possible members."""
        marked = self.possible(rows)
        new = self.unseen(rows).select(*self.keys).distinct()
        known = marked.join(new.select(*(F.col(k).alias(f"new_{k}") for k in self.keys)), [F.col(k).eqNullSafe(F.col(f"new_{k}")) for k in self.keys], "left_semi")
        return known.agg(F.avg(F.col("possible").cast("double"))).first()[0]
