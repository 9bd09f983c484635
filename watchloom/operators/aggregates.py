"""Aggregations: log and score summaries, time series, episodes, check roll-ups, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import one_row, percentiles

LEVELS = ("info", "error", "critical", "warning", "debug")


def log_summary(logs: DataFrame, tag: str = "tag", level: str = "level") -> DataFrame:
    """Per tag: all and the count of each level, ordered by tag."""
    counts = [F.count_if(F.lower(level) == x).alias(x) for x in LEVELS]
    return logs.groupBy(F.col(tag).alias("tag")).agg(F.count(F.lit(1)).alias("all"), *counts).orderBy("tag")


def alerts_by_level(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("level").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("level"))


def top_groups(alerts: DataFrame, k: int = 15) -> DataFrame:
    return alerts.select(F.explode("groups").alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "group").limit(k)


def score_statistics(scores: DataFrame, score: str = "score", threshold: float = 62) -> DataFrame:
    """One row; the median is found by refined histograms, so no task holds the scores."""
    hits, middle = F.count_if(F.col(score) >= threshold), F.lit(percentiles(scores, score, [0.5])[0]).cast("double")
    return scores.agg(F.avg(score).alias("mean"), middle.alias("median"), F.min(score).alias("least"), F.max(score).alias("most"), hits.alias("anomalies"), F.try_divide(hits, F.count(score)).alias("rate"), F.count_if(F.col(score) >= 70).alias("high"))


def score_histogram(scores: DataFrame, score: str = "score", width: int = 10) -> DataFrame:
    return scores.groupBy((F.floor(F.col(score) / width) * width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def model_health_flags(statistics: DataFrame) -> DataFrame:
    """messages of a score_statistics row: limits of the mean and rate, and no high score."""
    tests = (("mean score is high", F.col("mean") > 60), ("mean score is low", F.col("mean") < 20), ("anomaly rate is high", F.col("rate") > 0.25), ("anomaly rate is low", F.col("rate") < 0.05), ("no high scores", F.col("high") == 0))
    return statistics.withColumn("messages", F.array_compact(F.array(*(F.when(p, F.lit(m)) for m, p in tests))))


def class_metrics(scored: DataFrame, threshold: float = 62) -> DataFrame:
    """One row: mean, greatest and least score of each class, detection and false-positive rate in percent, separation."""
    attack, clean = F.col("is_attack"), ~F.col("is_attack")

    def of(p: Column, name: str) -> list[Column]:
        s = F.when(p, F.col("score"))
        rate = 100 * F.count_if(p & (F.col("score") >= threshold)) / F.nullif(F.count_if(p), F.lit(0))
        return [F.count(s).alias(f"{name}_n"), F.avg(s).alias(f"{name}_avg"), F.max(s).alias(f"{name}_max"), F.min(s).alias(f"{name}_min"), rate.alias(f"{name}_rate")]

    return scored.agg(*of(attack, "attack"), *of(clean, "clean")).withColumn("separation", F.col("attack_avg") - F.col("clean_avg"))


#: Upper ends of the score bands.
BANDS = ((20, "LOW"), (40, "MODERATE"), (60, "ELEVATED"), (80, "HIGH"))


def score_band(score: Column) -> Column:
    out = F.lit("SEVERE")
    for top, name in reversed(BANDS):
        out = F.when(score < top, name).otherwise(out)
    return out


def score_bands(scored: DataFrame) -> DataFrame:
    return scored.groupBy(score_band(F.col("score")).alias("band")).agg(F.count_if("is_attack").alias("attack"), F.count_if(~F.col("is_attack")).alias("clean"))


def per_rule_breakdown(scored: DataFrame, threshold: float = 62) -> DataFrame:
    rate = F.floor(100 * F.count_if(F.col("score") >= threshold) / F.count(F.lit(1)))
    return scored.groupBy("rule_description").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_score"), F.max("score").alias("max_score"), rate.alias("detection")).orderBy(F.desc("avg_score"), "rule_description")


def verdict(metrics: DataFrame) -> DataFrame:
    good = (F.col("separation") >= 30) & (F.col("attack_rate") >= 50)
    return metrics.withColumn("verdict", F.when(good, "GOOD").when(F.col("separation") >= 15, "FAIR").otherwise("POOR"))


def calibration_percentiles(raw: DataFrame, score: str = "raw") -> DataFrame:
    """One row: score_min and score_max, the 2nd and 98th percentile."""
    low, high = percentiles(raw, score, [0.02, 0.98])
    return one_row(raw, score_min=low, score_max=high)


def anomaly_threshold(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row: threshold, the 90th percentile as a whole number, 40 at least."""
    top = percentiles(scores, score, [0.9])[0]
    return one_row(scores, threshold=max(40, int(top)) if top is not None else 40)


def collection_status(rows: DataFrame, day: Column) -> DataFrame:
    """One row: days, total and the readiness tier by the total."""
    per = rows.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    tier = F.when(total < 100, "insufficient").when(total < 1000, "minimal").when(total < 10000, "good").otherwise("excellent")
    return per.agg(F.count(F.lit(1)).alias("days"), total.alias("total"), tier.alias("tier"))


def hourly_average(events: DataFrame, ts: str = "ts") -> DataFrame:
    """hour 0..23: mean count over the days seen, rounded down; interactions = number of days."""
    per = events.groupBy(F.to_date(ts).alias("day"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    days = events.agg(F.count_distinct(F.to_date(ts)).alias("interactions"))
    hours = events.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    sums = hours.join(per.groupBy("hour").agg(F.sum("n").alias("n")), "hour", "left")
    return sums.crossJoin(F.broadcast(days)).select("hour", F.coalesce(F.floor(F.col("n") / F.col("interactions")), F.lit(0)).alias("average"), "interactions")


def weekly_average(events: DataFrame, ts: str = "ts") -> DataFrame:
    """weekday (1 = Sunday) × hour: mean count over the weekdays seen, rounded down."""
    spine = events.sparkSession.range(7 * 24).select((F.floor(F.col("id") / 24) + 1).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    per = events.groupBy(F.dayofweek(ts).alias("weekday"), F.hour(ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    days = events.groupBy(F.dayofweek(ts).alias("weekday")).agg(F.count_distinct(F.to_date(ts)).alias("interactions"))
    out = spine.join(per, ["weekday", "hour"], "left").join(days, "weekday", "left")
    return out.select("weekday", "hour", F.coalesce(F.floor(F.col("n") / F.col("interactions")), F.lit(0)).alias("average"), F.coalesce("interactions", F.lit(0)).alias("interactions"))


def hourly_totals(alerts: DataFrame, ts: str = "ts") -> DataFrame:
    """Per hour: counts, and the count of each (rule, level) as a sorted list."""
    hour = F.date_trunc("hour", ts).alias("hour")
    per = alerts.groupBy(hour, "rule_id", "level").agg(F.count(F.lit(1)).alias("times"))
    return per.groupBy("hour").agg(F.sum("times").alias("total_alerts"), F.sort_array(F.collect_list(F.concat_ws("-", "rule_id", "level", "times"))).alias("alerts"))


def hourly_statistics(events: DataFrame, is_alert: Column, is_syscheck: Column, is_firewall: Column, ts: str = "ts") -> DataFrame:
    """Per hour of all events: hour, alerts (structs of sigid, level, times), total_alerts, events, syscheck, firewall; events: rule_id, level, ts."""
    flags = {"a": is_alert, "s": is_syscheck, "f": is_firewall}
    named = events.select(F.date_trunc("hour", ts).alias("hour"), "rule_id", "level", *(F.coalesce(c, F.lit(False)).alias(f"__{k}") for k, c in flags.items()))
    # one row for each rule and level of an hour: lists are bounded by the rules
    per = named.groupBy("hour", "rule_id", "level").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(f"__{k}").alias(k) for k in flags))
    alert = F.when(F.col("a") > 0, F.struct(F.col("rule_id").alias("sigid"), "level", F.col("a").alias("times")))
    totals = {"total_alerts": "a", "events": "n", "syscheck": "s", "firewall": "f"}
    return per.groupBy("hour").agg(F.sort_array(F.collect_list(alert)).alias("alerts"), *(F.sum(c).alias(name) for name, c in totals.items()))


def distinct_values(rows: DataFrame, array: str, name: str) -> DataFrame:
    """Set of the elements of an array column: rule groups, tags of a compliance framework."""
    return rows.select(F.explode(array).alias(name)).distinct()


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def process_episode(events: DataFrame) -> DataFrame:
    """events: id, ts, pid, ppid, user, host. The largest group by parent id, else own id; ties by the least key: tree, process_count, start, end, users, hosts.

    Groups are counted first, and only the largest is described. Its events are rows of process_episode_refs.
    """
    grouped = events.withColumn("tree", F.coalesce("ppid", "pid")).filter("tree is not null")
    top = grouped.groupBy("tree").agg(F.count(F.lit(1)).alias("process_count")).orderBy(F.desc("process_count"), "tree").limit(1)
    own = grouped.join(top, "tree")
    sets = {name: F.sort_array(F.collect_set(c)).alias(name) for name, c in (("users", "user"), ("hosts", "host"))}
    return own.groupBy("tree", "process_count").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), *sets.values())


def process_episode_refs(events: DataFrame) -> DataFrame:
    """tree, id of every event of the largest group."""
    grouped = events.withColumn("tree", F.coalesce("ppid", "pid")).filter("tree is not null")
    top = grouped.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tree").limit(1)
    return grouped.join(top.select("tree"), "tree", "left_semi").select("tree", "id")


def sessions(events: DataFrame, key: str, gap_seconds: int, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Adds session: a running number of pauses over the gap, for each key."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    pause = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp")) > gap_seconds * 1_000_000
    return events.withColumn("__new", F.coalesce(pause.cast("int"), F.lit(0))).withColumn("session", F.sum("__new").over(w)).drop("__new")


def auth_episodes(events: DataFrame, key: str, failed: Column, mfa: Column, gap_seconds: int = 300) -> DataFrame:
    """Attempts, failures and MFA of each session; over five failures are tagged as brute force of high severity."""
    out = sessions(events, key, gap_seconds).groupBy(key, "session").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(failed).alias("failed"), F.bool_or(mfa).alias("mfa"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    many = F.col("failed") > 5
    return out.withColumn("tags", F.when(many, F.array(F.lit("T1110"), F.lit("brute_force"))).otherwise(F.array().cast("array<string>"))).withColumn("severity", F.when(many, "high").otherwise("low"))


def network_episodes(events: DataFrame, key: str, port: Column, sent: Column, received: Column, gap_seconds: int = 300) -> DataFrame:
    out = sessions(events, key, gap_seconds).groupBy(key, "session").agg(F.count(F.lit(1)).alias("connections"), F.count_distinct(port).alias("ports"), F.sum(sent).alias("bytes_sent"), F.sum(received).alias("bytes_received"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return out.withColumn("tags", F.when(F.col("ports") > 10, F.array(F.lit("T1046"))).otherwise(F.array().cast("array<string>")))


def alert_severity(level: Column) -> Column:
    return F.when(level >= 12, "critical").when(level >= 10, "high").when(level >= 7, "medium").otherwise("low")


def alert_episode(alerts: DataFrame, correlated: DataFrame) -> DataFrame:
    """alerts: id, level. With the ids of correlated events in order of rank."""
    lists = correlated.groupBy(F.col("alert_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"]).alias("raw_refs"))
    return alerts.join(lists, "id", "left").withColumn("severity", alert_severity(F.col("level")))


def entity_sets(events: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(*(F.sort_array(F.collect_set(k)).alias(k) for k in kinds))


def check_conditions(results: DataFrame) -> DataFrame:
    """results: check_id, condition (all, any, none), result (Found, NotFound, Invalid). A deciding result beats an invalid one."""
    found, missing, invalid = (F.bool_or(F.col("result") == r) for r in ("Found", "NotFound", "Invalid"))
    out = results.groupBy("check_id", "condition").agg(found.alias("f"), missing.alias("m"), invalid.alias("i"))
    rules = {"all": ("m", "Failed", "Passed"), "any": ("f", "Passed", "Failed"), "none": ("f", "Failed", "Passed")}
    status = F.lit(None).cast("string")
    for name, (deciding, then, other) in rules.items():
        status = F.when(F.col("condition") == name, F.when(F.col(deciding), then).when(F.col("i"), "Not applicable").otherwise(other)).otherwise(status)
    return out.select("check_id", "condition", status.alias("status"))


def invalid_reasons(results: DataFrame) -> DataFrame:
    """Reasons of invalid results joined by line ends, in rule order."""
    rows = results.filter("result = 'Invalid'").groupBy("check_id")
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rule_no", "reason"))), lambda x: x["reason"]), "\n").alias("reasons"))


def row_checksum(*cols: Column) -> Column:
    """SHA-1 of the fields joined by colons, missing ones empty."""
    return F.sha1(F.array_join(F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), ":"))


def table_checksum(rows: DataFrame, by: list[str], checksum: str = "checksum") -> DataFrame:
    """SHA-1 over the checksums of each table in their order. Only for small tables: a task holds one whole."""
    return rows.groupBy(*by).agg(F.sha1(F.array_join(F.sort_array(F.collect_list(checksum)), "")).alias("table_checksum"), F.count(F.lit(1)).alias("n"))


def table_checksum_levels(rows: DataFrame, by: list[str], checksum: str = "checksum", digits: int = 2) -> DataFrame:
    """A checksum for each leading-digit bucket, then over the buckets. The number of buckets is fixed: checksum_tree bounds their size."""
    inner = table_checksum(rows.withColumn("__bucket", F.substring(checksum, 1, digits)), [*by, "__bucket"], checksum)
    pair = F.sort_array(F.collect_list(F.concat("__bucket", "table_checksum")))
    return inner.groupBy(*by).agg(F.sha1(F.array_join(pair, "")).alias("table_checksum"), F.sum("n").alias("n"))


def checksum_tree(rows: DataFrame, by: list[str], checksum: str = "checksum", bucket_rows: int = 4096, digits: int = 3) -> DataFrame:
    """table_checksum, n of tables of any size: a checksum for each bucket, rolled up level by level, so no task holds a table.

    Buckets are the leading digits of the SHA-1 of the row's checksum, so many for each level. The levels, at most three, follow from the number of
    distinct checksums, which bounds the mean size of a bucket. Copies of a checksum enter as one with their count.
    """
    each = rows.groupBy(*by, F.col(checksum).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    levels = F.least(F.lit(3), F.greatest(F.lit(0), F.ceil(F.log(F.count(F.lit(1)) / bucket_rows) / F.log(F.lit(float(16**digits)))))).cast("int")
    sized = each.groupBy(*by).agg(levels.alias("depth")).select(*(F.col(c).alias(f"__{c}") for c in by), "depth")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    bucket = F.expr(f"substring(sha1(coalesce(c, '')), 1, {digits} * depth)")
    item = F.concat_ws(":", F.col("c"), F.col("k").cast("string"))
    out = each.join(sized, same).groupBy(*by, "depth", bucket.alias("b")).agg(F.sha1(F.array_join(F.sort_array(F.collect_list(item)), ",")).alias("c"), F.sum("k").alias("n"))
    for level in (3, 2, 1):
        deep = F.col("depth") >= level
        upper = F.when(deep, F.substring("b", 1, digits * (level - 1))).otherwise(F.col("b")).alias("b")
        rolled = F.when(deep, F.sha1(F.array_join(F.sort_array(F.collect_list(F.concat("b", "c"))), ""))).otherwise(F.max("c"))
        out = out.groupBy(*by, "depth", upper).agg(rolled.alias("c"), F.sum("n").alias("n"))
    return out.select(*by, F.col("c").alias("table_checksum"), "n")


def max_version(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def range_bounds(rows: DataFrame, ts: str) -> DataFrame:
    return rows.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))


def rows_per_group(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def entry_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("inode", "device").alias("inodes"))
