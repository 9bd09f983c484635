"""Features, isolation forest, attack patterns, assessment and retrieval."""

from __future__ import annotations

import itertools
import math
from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import percentiles

#: Groups that hint at an attack.
SUSPICIOUS_GROUPS = ("authentication_failed", "authentication_failures", "invalid_login", "attack", "exploit", "web_attack", "sql_injection", "recon", "malware", "rootcheck")
FEATURES = ("words", "log_size", "failures", "hour", "off_hours", "ips", "ports", "processes", "level", "rule_id", "techniques", "suspicious", "data_fields")


def count_of(text: Column, word: str) -> Column:
    """Number of times a literal word is in a text."""
    return F.size(F.split(text, "\\Q" + word + "\\E")) - 1


def event_features(alerts: DataFrame) -> DataFrame:
    """Adds 13 numeric features. alerts: rule_id, level, groups, techniques, agent_ip, data map, full_log, message, ts."""
    log = F.lower(F.coalesce(F.nullif("full_log", F.lit("")), F.col("message"), F.lit("")))
    hour = F.coalesce(F.hour("ts"), F.lit(12))
    data = F.coalesce("data", F.create_map().cast("map<string,string>"))
    named = lambda k: F.coalesce((F.try_element_at(data, F.lit(k)) != "").cast("int"), F.lit(0))
    ports = named("srcport") + named("dstport")
    values = {
        "words": F.size(F.filter(F.split(log, r"\s+"), lambda w: w != "")),
        "log_size": F.octet_length(F.to_json(F.struct("rule_id", "level", "groups", "data", "full_log"))),
        "failures": count_of(log, "failed") + count_of(log, "denied") + count_of(log, "invalid") + count_of(log, "error"),
        "hour": hour,
        "off_hours": hour.between(2, 6).cast("int"),
        "ips": F.coalesce((F.col("agent_ip") != "").cast("int"), F.lit(0)) + named("srcip"),
        "ports": F.least(F.when(ports > 0, ports).otherwise(count_of(log, " port ")), F.lit(10)),
        "processes": F.least(count_of(log, "process") + count_of(log, "exec"), F.lit(5)),
        "level": F.coalesce("level", F.lit(0)),
        "rule_id": F.coalesce(F.col("rule_id").try_cast("int"), F.lit(0)),
        "techniques": F.greatest(F.size(F.coalesce("techniques", F.array().cast("array<string>"))), F.lit(0)),
        "suspicious": F.size(F.array_intersect(F.coalesce("groups", F.array().cast("array<string>")), F.array(*map(F.lit, SUSPICIOUS_GROUPS)))),
        "data_fields": F.size(data),
    }
    return alerts.withColumn("features", F.array(*(values[f].cast("double") for f in FEATURES)))


def standardise(train: DataFrame, rows: DataFrame, features: str = "features", n: int = len(FEATURES)) -> DataFrame:
    """Zero mean and unit variance as in train; a constant feature is only shifted. The moments are one row."""
    moments = train.agg(*(F.avg(F.col(features)[i]).alias(f"m{i}") for i in range(n)), *(F.stddev_pop(F.col(features)[i]).alias(f"s{i}") for i in range(n)))
    scaled = F.array(*((F.col(features)[i] - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) for i in range(n)))
    return rows.crossJoin(F.broadcast(moments)).withColumn(features, scaled).drop(*(f"{p}{i}" for p in "ms" for i in range(n)))


def _mean_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree over n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


NODES = "tree int, node int, feature int, cut double, left int, right int, depth double"


def isolation_forest_fit(train: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42, row_id: str = "id") -> DataFrame:
    """The node table of the forest. Each tree gets about sample rows by a seeded hash of the row's id, and is grown in its own group.

    A tree's group has at most some hundred rows, whatever the size of the training table. A row is drawn before it is repeated: one hash inverts the
    binomial distribution of the number of its trees, and only so many are made.
    """
    n = max(1, train.count())
    share = min(1.0, 1.5 * sample / n)
    unit = lambda *of: F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) / float(1 << 52)
    rows = train.select(F.col("features"), F.col(row_id).alias("rid"))
    if share == 1.0:  # a small table: each row in each tree
        each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    else:
        sums = list(itertools.accumulate(math.exp(math.lgamma(trees + 1) - math.lgamma(k + 1) - math.lgamma(trees - k + 1) + k * math.log(share) + (trees - k) * math.log1p(-share)) for k in range(trees)))
        drawn = rows.withColumn("k", F.size(F.filter(F.array(*map(F.lit, sums)), lambda p: p <= unit("rid")))).filter("k > 0")
        # k hashes name its trees; a tree that is named twice counts once
        named = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("k")), lambda j: F.pmod(F.xxhash64(F.lit(seed), F.lit("tree"), "rid", j), F.lit(trees)).cast("int")))
        each = drawn.withColumn("tree", F.explode(named)).drop("k")
    picked = each.withColumn("u", unit("tree", "rid", F.lit("order")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "rid"]).head(sample)
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        x = np.vstack(pdf["features"].to_numpy())
        limit = math.ceil(math.log2(max(2, len(x))))
        nodes: list[tuple] = []

        def build(rows: np.ndarray, depth: int) -> int:
            own = len(nodes)
            nodes.append(())
            spread = x[rows].max(axis=0) > x[rows].min(axis=0)
            if depth >= limit or len(rows) <= 1 or not spread.any():
                nodes[own] = (tree, own, -1, 0.0, -1, -1, depth + _mean_path(len(rows)))
                return own
            f = int(rng.choice(np.nonzero(spread)[0]))
            values = x[rows, f]
            cut = float(rng.uniform(values.min(), values.max()))
            below = values < cut
            if not below.any():
                below = values <= values.min()
            left, right = build(rows[below], depth + 1), build(rows[~below], depth + 1)
            nodes[own] = (tree, own, f, cut, left, right, 0.0)
            return own

        build(np.arange(len(x)), 0)
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in NODES.split(", ")])

    return picked.groupBy("tree").applyInPandas(grow, NODES)


def isolation_forest_score(rows: DataFrame, nodes: DataFrame, sample: int = 256, contamination_offset: float = -0.5) -> DataFrame:
    """Adds raw: mean path score minus the offset, negative for anomalies. The forest has at most trees * 2 * sample nodes and is sent to the tasks."""
    model = nodes.toPandas().sort_values(["tree", "node"])
    starts = model.groupby("tree").size().cumsum().shift(1, fill_value=0).to_numpy()
    sizes = model.groupby("tree").size().to_numpy()
    shift = np.repeat(starts, sizes)
    table = {
        "roots": starts,
        "feature": model["feature"].to_numpy(np.int64),
        "cut": model["cut"].to_numpy(),
        "left": model["left"].to_numpy(np.int64) + shift,
        "right": model["right"].to_numpy(np.int64) + shift,
        "depth": model["depth"].to_numpy(),
    }
    shared = rows.sparkSession.sparkContext.broadcast(table)
    norm = _mean_path(sample)

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        t = shared.value
        if not len(features) or not len(t["roots"]):
            return pd.Series(np.zeros(len(features)))
        x = np.vstack(features.to_numpy())
        total = np.zeros(len(x))
        for root in t["roots"]:
            at = np.full(len(x), root)
            while True:
                f = t["feature"][at]
                inner = np.nonzero(f >= 0)[0]
                if not len(inner):
                    break
                low = x[inner, f[inner]] < t["cut"][at[inner]]
                at[inner] = np.where(low, t["left"][at[inner]], t["right"][at[inner]])
            total += t["depth"][at]
        return pd.Series(-(2.0 ** (-total / len(t["roots"]) / norm)) - contamination_offset)

    return rows.withColumn("raw", score("features"))


def contamination_offset(scored: DataFrame, contamination: float = 0.05) -> float:
    """The quantile of the raw scores below which the given share of the training rows lies."""
    return percentiles(scored, "raw", [contamination])[0]


def score_normalise(raw: Column, low: Column, high: Column) -> Column:
    """(high - raw) / range * 100 as a whole number in 0..100, 50 if the range is 0."""
    scaled = F.when(high > low, (high - raw) / (high - low) * 100).otherwise(50.0)
    return F.greatest(F.lit(0), F.least(F.lit(100), scaled.cast("int")))


def time_score(hour: Column) -> Column:
    return F.when(hour.between(2, 6), 30).when((hour >= 22) | (hour <= 2), 20).when(hour.between(8, 18), 5).otherwise(0)


def multi_dimensional_score(anomaly: Column, hour: Column, failures: Column, ips: Column) -> Column:
    """Struct of time, frequency, network and combined score; without an address the network score is 0."""
    t, f, n = time_score(hour), F.least(failures * 10, F.lit(50)), F.least(F.greatest(ips - 1, F.lit(0)) * 5, F.lit(20))
    combined = F.least(F.lit(100), (anomaly * 0.5 + t * 0.2 + f * 0.2 + n * 0.1).cast("int"))
    return F.struct(t.alias("time_score"), f.alias("frequency_score"), n.alias("network_score"), combined.alias("combined_score"))


#: Name, pattern over lower-cased text, risk.
ATTACK_PATTERNS = (
    ("SSH Brute Force", r"(failed|invalid|authentication failure).*(ssh|login)", 75),
    ("SQL Injection", r"union.*select|drop.*table|';.*--|exec.*xp_", 90),
    ("PowerShell Obfuscation", r"powershell.*-enc|base64|encoded|obfuscat", 85),
    ("Port Scanning", r"port.*scan|connection.*refused|multiple.*ports", 60),
    ("Privilege Escalation", r"sudo|su -|privilege|escalation|root.*access", 80),
    ("File Integrity Violation", r"file.*modified|integrity.*violation|checksum.*mismatch", 85),
    ("Malware Execution", r"malware|virus|trojan|backdoor|rootkit", 95),
    ("Lateral Movement", r"lateral.*movement|psexec|wmic|remote.*execution", 80),
    ("Data Exfiltration", r"exfiltrat|data.*export|large.*transfer|unauthorized.*access", 90),
    ("Command Injection", r";.*rm|;.*cat|;.*wget|command.*injection", 85),
)


def _may_match(low: Column, pattern: str) -> Column:
    """Whether a text holds the literals of some alternative of a pattern, a plain search that spares most texts the regular expression."""
    parts = [p.strip("()").split("|") for p in pattern.split(").*(")] if ").*(" in pattern else None
    every = list(itertools.product(*parts)) if parts else [tuple(x.split(".*")) for x in pattern.split("|")]
    return reduce(or_, (reduce(and_, (low.contains(word) for word in words)) for words in every))


def _pattern_hits(low: Column) -> Column:
    each = (F.when(_may_match(low, p) & low.rlike(p), F.struct(F.lit(risk).alias("risk"), F.lit(-i).alias("i"), F.lit(name).alias("name"))) for i, (name, p, risk) in enumerate(ATTACK_PATTERNS))
    return F.array_compact(F.array(*each))


def _pattern_verdict(hits: Column) -> Column:
    best = F.array_max(hits)
    return F.struct(
        F.coalesce(best["name"], F.lit("No known pattern")).alias("pattern"),
        F.coalesce(best["risk"], F.lit(0)).alias("risk_score"),
        F.transform(hits, lambda h: h["name"]).alias("all_patterns"),
        F.coalesce(F.size(hits) > 0, F.lit(False)).alias("suspicious"),
    )


def attack_patterns(text: Column) -> Column:
    """Struct: pattern (the riskiest, the first of equals), risk_score, all_patterns in order, suspicious. For whole tables use with_attack_patterns."""
    return _pattern_verdict(_pattern_hits(F.lower(text)))


def with_attack_patterns(rows: DataFrame, text: str, name: str = "patterns") -> DataFrame:
    """Adds the struct of attack_patterns. The lower-cased text and the hits are columns of their own, so each is computed once a row."""
    low, hits = "__low", "__hits"
    out = rows.withColumn(low, F.lower(text)).withColumn(hits, _pattern_hits(F.col(low))).drop(low)
    return out.withColumn(name, _pattern_verdict(F.col(hits))).drop(hits)


def severity_boost(risk: Column, severity: Column) -> Column:
    more = F.when(severity == "CRITICAL", 15).when(severity == "HIGH", 10).when(severity == "MEDIUM", 5).otherwise(0)
    return F.when(more > 0, F.least(risk + more, F.lit(100))).otherwise(risk)


def suspicious(risk: Column, confidence: Column) -> Column:
    return (risk > 70) | (confidence > 0.7)


def similarity_severity(similarity: Column) -> Column:
    return F.when(similarity >= 0.8, "CRITICAL").when(similarity >= 0.6, "HIGH").when(similarity >= 0.4, "MEDIUM").otherwise("LOW")


def threat_assessment(anomaly: Column, combined: Column, risk: Column, is_suspicious: Column, threshold: float = 62) -> Column:
    final = F.greatest(combined, risk)
    level = F.when(final >= 90, "CRITICAL").when(final >= 75, "HIGH").when(final >= 50, "MEDIUM").otherwise("LOW")
    return F.struct(final.alias("final_score"), ((anomaly > threshold) | is_suspicious | (final >= threshold)).alias("is_anomaly"), level.alias("threat_level"))


#: The texts of the advice, and the names in a pattern's name that call for some of them.
ADVICE = {
    "score": "High priority score detected - immediate investigation recommended",
    "time": "Event occurred during off-hours - suspicious timing",
    "frequency": "High frequency of failed attempts detected - possible brute force",
    "pattern": "Suspicious pattern detected: ",
    "threat": "Similar to known threat: ",
    "mitigation": "Recommended mitigation: ",
    "none": "Review event manually for potential security concerns",
}
PATTERN_ADVICE = {
    "SSH|Brute Force": "Consider blocking source IP and enabling rate limiting",
    "SQL Injection": "Review database access logs and validate input sanitization",
    "PowerShell": "Investigate PowerShell execution and check for script obfuscation",
}


def recommendations(combined: Column, time: Column, frequency: Column, pattern: Column, is_suspicious: Column, intel: Column) -> Column:
    """Texts by scores, pattern and the nearest intelligence (struct of description and mitigation, or null)."""
    special = F.coalesce(*(F.when(pattern.rlike(names), F.lit(text)) for names, text in PATTERN_ADVICE.items()))
    found = F.array_compact(
        F.array(
            F.when(combined > 80, F.lit(ADVICE["score"])),
            F.when(time > 20, F.lit(ADVICE["time"])),
            F.when(frequency > 30, F.lit(ADVICE["frequency"])),
            F.when(is_suspicious, F.concat(F.lit(ADVICE["pattern"]), pattern)),
            F.when(is_suspicious, special),
            F.concat(F.lit(ADVICE["threat"]), F.substring(intel["description"], 1, 100)),
            F.concat(F.lit(ADVICE["mitigation"]), F.nullif(intel["mitigation"], F.lit(""))),
        )
    )
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(ADVICE["none"])))


# retrieval -------------------------------------------------------------------------------------
def freshness(ts: Column, as_of: Column, hours: float = 168) -> Column:
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 3.6e9
    return F.exp(-age / hours)


def keyword_alert_search(alerts: DataFrame, terms: list[str], text: Column, description: Column, level: str, k: int, tie: str) -> DataFrame:
    """1 for each term in the text, 2 more if in the description; rows without a hit are left out."""
    t, d = F.lower(text), F.lower(description)
    score = reduce(lambda a, b: a + b, (F.coalesce(t.contains(x).cast("int"), F.lit(0)) + 2 * F.coalesce(d.contains(x).cast("int"), F.lit(0)) for x in (w.lower() for w in terms)))
    return alerts.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), F.desc(level), tie).limit(k)


# labels ----------------------------------------------------------------------------------------
def event_class(text: Column, is_alert: Column, pid: Column) -> Column:
    low = F.lower(text)
    return F.when(is_alert, "alert").when(pid.isNotNull() | low.rlike("process|exec"), "process").when(low.rlike("login|auth|password"), "authentication").when(low.rlike("connection|port|network"), "network").otherwise("alert")


#: Words of each tag.
TAG_WORDS = (("authentication", ("ssh", "login", "auth")), ("process", ("process", "exec", "command")), ("network", ("network", "connection", "port")), ("file_integrity", ("file", "integrity", "modification")))
INDICATORS = (("powershell_encoded", "powershell", "encoded"), ("privilege_escalation", "sudo", "su"), ("process_injection", "injection", "dll"), ("lateral_movement", "psexec", "wmic"), ("credential_access", "password", "credential"))


def event_tags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike("|".join(words)), F.lit(tag)) for tag, words in TAG_WORDS)))


def event_ips(text: Column, agent_ip: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\b((?:\d{1,3}\.){3}\d{1,3})\b"), F.lit(1))
    return F.concat(F.array_compact(F.array(F.nullif(agent_ip, F.lit("")))), F.coalesce(found, F.array().cast("array<string>")))


def indicator_flags(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.contains(a) & low.contains(b), F.lit(name)) for name, a, b in INDICATORS)))


def hypothesis_confidence(technique: Column, anomaly: Column, evidence: Column) -> Column:
    return 0.4 * technique + 0.3 * anomaly + 0.3 * F.least(evidence / 5, F.lit(1.0))


def triage_decision(checks_passed: Column, confidence: Column) -> Column:
    return F.when(checks_passed & (confidence >= 0.8), "confirmed").when(checks_passed & (confidence >= 0.6), "likely").when(confidence >= 0.4, "possible").otherwise("unlikely")


def technique_keyword_match(queries: DataFrame, techniques: DataFrame, k: int = 5) -> DataFrame:
    """queries: query, text; techniques: technique, name, description. 0.5 if a query word is in the name, 0.3 more if in the description; top k."""

    def words(text: str) -> Column:
        return F.explode(F.array_distinct(F.filter(F.split(F.lower(text), r"\W+"), lambda w: w != ""))).alias("word")

    asked = queries.select("query", words("text"))
    named = techniques.select("technique", words("name"), F.lit(0.5).alias("w")).unionByName(techniques.select("technique", words("description"), F.lit(0.3).alias("w")))
    hits = asked.join(named, "word").groupBy("query", "technique", "w").agg(F.lit(1)).groupBy("query", "technique").agg(F.sum("w").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "technique"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)
