"""Process trees over re-used process numbers, and the episodes made of them.

A process number is valid on its host until the next process gets it, so a process's parent is the latest one with its parent number that began before it.
That search runs in time buckets: a row looks in its own bucket and in the summaries of the buckets before, so one host and number with very many rows is
not one task. Roots and depths come by pointer doubling: each round an ancestor pointer jumps to the pointer of the ancestor, which takes
as many rounds as the depth has binary digits. Each round is an equi-join of written tables.

Defined results: a process whose parent was never seen is a root of depth 1. Equal times go by id; ids are unique. Rows without host, number or time have no parent
and are no parent. A process that names its own number as parent is a child of an earlier one with that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.landing import stored

#: Seconds of a time bucket.
BUCKET = 3600
#: Words in a message that point to an indicator.
INDICATOR_WORDS = {
    "suspicious_command": ("powershell", "cmd", "encoded", "base64"),
    "privilege_escalation": ("privilege", "escalation", "sudo", "su"),
    "process_injection": ("injection", "dll", "process"),
}
#: Techniques of an indicator, and what a host's name says of its environment.
TECHNIQUES = {"process_injection": "technique:T1055", "privilege_escalation": "technique:T1068"}
ENVIRONMENTS = {"environment:production": ("prod",), "environment:development": ("dev", "test")}


def with_parents(events: DataFrame) -> DataFrame:
    """events: id, host, pid, ppid, ts. Adds parent, the id of the process that started it, or null."""
    order, bucket = F.struct("ts", "id"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / BUCKET)
    named = events.filter("host is not null and ts is not null").select("id", "host", "ts", "pid", "ppid", bucket.alias("bucket"))
    # at one time and id the row that asks comes before the row that answers: no process starts itself
    answers = named.filter("pid is not null").select("host", F.col("pid").alias("number"), "bucket", "ts", "id", F.lit(1).alias("kind"), order.alias("at"))
    asks = named.filter("ppid is not null").select("host", F.col("ppid").alias("number"), "bucket", "ts", "id", F.lit(0).alias("kind"), F.lit(None).cast(answers.schema["at"].dataType).alias("at"))
    rows = stored(answers.unionByName(asks), "process-rows")
    own = Window.partitionBy("host", "number", "bucket").orderBy("ts", "id", "kind").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("host", "number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = rows.filter("kind = 1").groupBy("host", "number", "bucket").agg(F.max("at").alias("last"))
    every = rows.select("host", "number", "bucket").distinct().join(summary, ["host", "number", "bucket"], "left")
    ahead = every.select("host", "number", "bucket", F.max("last").over(before).alias("ahead"))
    found = rows.withColumn("near", F.max("at").over(own)).filter("kind = 0").join(ahead, ["host", "number", "bucket"])
    parents = found.select(F.col("id").alias("__child"), F.coalesce("near", "ahead")["id"].alias("parent")).filter("parent is not null")
    return events.join(parents, F.col("id") == F.col("__child"), "left").drop("__child")


def roots(linked: DataFrame) -> DataFrame:
    """linked: id, parent. id, root, depth (1 for a root) of every row with an id."""
    state = stored(linked.filter("id is not null").select("id", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("dist")), "process-pointers")
    while not state.filter("root is null").isEmpty():
        to = state.select(F.col("id").alias("at"), F.col("up").alias("at_up"), F.col("root").alias("at_root"), F.col("dist").alias("at_dist"))
        moved = state.filter("root is null").join(to, F.col("up") == F.col("at"), "left")
        # a parent that isn't in the table is a root itself
        root = F.when(F.col("at").isNull(), F.col("up")).otherwise(F.col("at_root"))
        moved = moved.select("id", F.when(F.col("at_root").isNull() & F.col("at").isNotNull(), F.col("at_up")).alias("up"), root.alias("root"), (F.col("dist") + F.coalesce("at_dist", F.lit(0))).alias("dist"))
        state = stored(state.filter("root is not null").unionByName(moved), "process-pointers")
    return state.select("id", "root", (F.col("dist") + 1).alias("depth"))


def indicators(message: Column, unsigned: Column | None = None) -> Column:
    """The indicators of one event, by the words in its message; unsigned: whether it is of a process without a signature."""
    low = F.lower(message)
    named = [F.when(low.rlike("|".join(words)), F.lit(name)) for name, words in INDICATOR_WORDS.items()]
    return F.array_compact(F.array(*named, *([] if unsigned is None else [F.when(unsigned, F.lit("unsigned_process"))])))


def tree_episodes(events: DataFrame, message: Column, unsigned: Column | None = None) -> DataFrame:
    """events: id, host, pid, ppid, ts. Of each tree: root, host, process_count, depth, start, end, indicators and tags.

    Its members are rows of roots(), not a list: a tree may hold any share of all events.
    """
    named = events.withColumns({"__what": indicators(message, unsigned)})
    linked = stored(with_parents(named), "process-links")
    placed = linked.join(stored(roots(linked), "process-roots"), "id")
    kinds = [*INDICATOR_WORDS, "unsigned_process"]
    flags = [F.coalesce(F.bool_or(F.array_contains("__what", k)), F.lit(False)).alias(f"__{k}") for k in kinds]
    out = placed.groupBy("root").agg(F.min("host").alias("host"), F.count(F.lit(1)).alias("process_count"), F.max("depth").alias("depth"), F.min("ts").alias("start"), F.max("ts").alias("end"), *flags)
    found = F.array_compact(F.array(*(F.when(F.col(f"__{k}"), F.lit(k)) for k in kinds)))
    host = F.lower(F.col("host").cast("string"))
    place = F.coalesce(*(F.when(host.rlike("|".join(words)), F.lit(tag)) for tag, words in ENVIRONMENTS.items()))
    techniques = [F.when(F.col(f"__{k}"), F.lit(tag)) for k, tag in TECHNIQUES.items()]
    n = F.size("indicators")
    severity = F.when(n > 2, "severity:high").when(n > 0, "severity:medium").otherwise("severity:low")
    tags = F.array_compact(F.array(F.lit("process_episode"), place, *techniques, severity))
    return out.withColumn("indicators", found).withColumn("tags", tags).select("root", "host", "process_count", "depth", "start", "end", "indicators", "tags")
