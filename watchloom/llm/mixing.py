"""Mixing sources to target weights by Poisson replication.

A source with n rows and weight w gets the mean repetition rate w * total / n. A row is repeated as
often as a Poisson distribution with that mean says at the row's own point of [0, 1), which is a hash
of the seed and the row's id: the same seed gives the same mixture on any cluster. Rows are then put in
the order of a second hash, which is a global shuffle by range partitions.

Defined results: a null source is a source of its own; rows with the same id get the same count; a weight of 0
or a source that is missing from the weights drops its rows (that is what the weight says); null texts
and other columns are carried along, whatever their names; an empty table gives no rows. A row can have 2 ** 31 - 1 copies at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import free_name, save, unit_hash


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 0.5, total: int | None = None) -> DataFrame:
    """source, n, rate of each source. Weights are given, or in proportion to n ** temperature."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        cases = F.lit(0.0)
        for name, w in weights.items():
            cases = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(cases)
        weighed = counts.withColumn("w", cases)
    sums = weighed.agg(F.sum("w").alias("sum_w"), F.sum("n").alias("sum_n"))
    goal = F.lit(total) if total is not None else F.col("sum_n")
    return weighed.join(F.broadcast(sums)).select("source", "n", F.coalesce(F.try_divide(F.col("w") * goal, F.col("sum_w") * F.col("n")), F.lit(0.0)).alias("rate"))


def poisson_cdf(per: DataFrame) -> DataFrame:
    """per (source, rate, ...) with first and cdf: P(X <= first), P(X <= first + 1), ... for X ~ Poisson(rate), null where the rate is 0.

    Only numbers within 12 standard deviations and 40 of the rate are listed: a double has no mass for the others. They are rows that a window sums
    up, so the work is in proportion to the root of the rate. The first term is exact for first = 0, else Stirling's series, exact to a double from 30 on.
    """
    spread = 12 * F.sqrt("rate") + 40
    low = F.floor(F.col("rate") - spread)
    spans = per.filter("rate > 0").select("source", "rate", F.when(low < 30, 0).otherwise(low).cast("bigint").alias("first"), F.ceil(F.col("rate") + spread).cast("bigint").alias("last"))
    each = spans.select("source", "rate", "first", F.explode(F.sequence("first", "last")).alias("k"))
    x = F.greatest(F.col("first"), F.lit(1)).cast("double")  # where first is 0 it isn't used
    log_factorial = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    start = F.when(F.col("first") == 0, -F.col("rate")).otherwise(x * F.log("rate") - F.col("rate") - log_factorial)
    upto = Window.partitionBy("source").orderBy("k")
    term = F.sum(F.when(F.col("k") == F.col("first"), start).otherwise(F.log("rate") - F.log(F.col("k").cast("double")))).over(upto)
    sums = each.withColumn("term", term).withColumn("p", F.sum(F.exp("term")).over(upto))
    cdf = F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda e: e["p"])
    lists = sums.groupBy(F.col("source").alias("__of")).agg(F.min("first").alias("first"), cdf.alias("cdf"))
    return per.join(lists, per["source"].eqNullSafe(F.col("__of")), "left").drop("__of")


def poisson_count(rate: Column, first: Column, cdf: Column, u: Column) -> Column:
    """The least k with P(X <= k) > u for X ~ Poisson(rate), from poisson_cdf()."""
    return F.when(rate <= 0, F.lit(0).cast("bigint")).otherwise(first + F.least(F.size(F.filter(cdf, lambda p: p <= u)), F.size(cdf) - 1))


#: Copies that one row makes at once; of rows with more, each run of so many is dealt out by itself.
RUN = 4096


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str | None, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: int = 17, numbered: bool = True) -> DataFrame:
    """The mixed rows with all their columns in shuffled order; numbered adds copy_no and shuffle_key.

    shuffle_key is the 60-bit key of the global order, so a reader can restore or cut it. Where the table has columns of these names, the new ones
    have an underscore more. Keys are evenly spread hashes, so their leading bits deal the rows out in order, without a sample of them.
    """
    own = {c: free_name(docs, c) for c in ("__u", "__source", "__rate", "__first", "__cdf", "__k", "__run", "__copy", "__key")}
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a row for each source: a written table, so that its size is known and Spark picks the join by it
    per = save(poisson_cdf(rates(docs, source_col, weights, temperature, total)), "mix-rates")
    most = per.agg(F.max("rate")).first()[0] or 0.0
    per = per.select(*(F.col(c).alias(own[f"__{c}"]) for c in ("source", "rate", "first", "cdf")))
    seeded = docs.withColumn(own["__u"], unit_hash(F.lit(seed), F.col(id_col)))
    joined = seeded.join(per, seeded[source_col].eqNullSafe(F.col(own["__source"])))
    count = poisson_count(*(F.col(own[c]) for c in ("__rate", "__first", "__cdf", "__u")))
    out = joined.withColumn(own["__k"], count).filter(F.col(own["__k"]) > 0).drop(*(own[c] for c in ("__u", "__source", "__rate", "__first", "__cdf")))
    k, run = F.col(own["__k"]), F.col(own["__run"])
    out = out.withColumn(own["__run"], F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((k - 1) / RUN).cast("bigint"))))
    if most > RUN:  # some rows make very many copies: their runs go to different tasks before they are made
        out = out.repartition(parts, run, F.col(id_col))
    number = F.explode(F.sequence((run * RUN + 1).cast("int"), F.least(k, (run + 1) * RUN).cast("int")))
    out = out.withColumn(own["__copy"], number).drop(own["__k"], own["__run"])
    copy = F.col(own["__copy"])
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("\\N")), copy))
    out = out.withColumn(own["__key"], F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint"))
    # 30 of the key's 60 bits, so that the product stays a long
    place = F.shiftright(F.shiftright(F.col(own["__key"]), 30) * F.lit(parts), 30).cast("int")
    out = out.repartitionById(parts, place).sortWithinPartitions(own["__key"], id_col)
    if not numbered:
        return out.drop(own["__copy"], own["__key"])
    return out.withColumnsRenamed({own["__copy"]: free_name(docs, "copy_no"), own["__key"]: free_name(docs, "shuffle_key")})


def expected_rows(n: int, rate: float) -> tuple[float, float]:
    """Mean and standard deviation of the rows that a source of n rows gives."""
    return n * rate, math.sqrt(n * rate)
