"""Registered queries of the security-event operators, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import mapping as M
from .functions import predicates as P
from .functions import transform as T
from .operators import aggregates as A
from .operators import enrich as J
from .operators import extract as X
from .operators import filters as L
from .operators import ranking as W
from .operators import scoring as R
from .operators import search as S
from .operators import state as D
from .operators import versions as V
from .plans.alerts import alerts, table
from .registry import ORACLE, QUERIES, query
from .sources import incremental as INC
from .sources.landing import stored

def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# summaries -------------------------------------------------------------------------------------
@query("""WITH {alerts}, d AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_alerts, count(*) FILTER (is_attack) AS n_attacks,
round(avg(level), 4) AS avg_level, max(level) AS max_level FROM alerts GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY day ORDER BY n_attacks DESC, max_level DESC, user_id)::INT AS rank FROM d""")
def alert_daily_rank(spark: SparkSession, d: str) -> DataFrame:
    per = alerts(spark, d).groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n_alerts"), F.count_if("is_attack").alias("n_attacks"), F.round(F.avg("level"), 4).alias("avg_level"), F.max("level").alias("max_level"))
    return per.withColumn("rank", F.expr("row_number() OVER (PARTITION BY day ORDER BY n_attacks DESC, max_level DESC, user_id)"))


@query("WITH {alerts} SELECT level, count(*) AS n FROM alerts GROUP BY 1")
def alerts_by_level(spark: SparkSession, d: str) -> DataFrame:
    return A.alerts_by_level(alerts(spark, d))


@query('WITH {alerts} SELECT "group", count(*) AS n FROM (SELECT unnest(groups) AS "group" FROM alerts) GROUP BY 1 ORDER BY n DESC, "group" LIMIT 15')
def top_groups(spark: SparkSession, d: str) -> DataFrame:
    return A.top_groups(alerts(spark, d))


def level_name() -> Column:
    level = F.col("level")
    return F.when(level >= 12, "CRITICAL").when(level >= 9, "ERROR").when(level >= 5, "WARNING").when(level >= 2, "INFO").otherwise("DEBUG")


@query("""WITH {alerts} SELECT rule_id AS tag, count(*) AS "all", count(*) FILTER (level BETWEEN 2 AND 4) AS info, count(*) FILTER (level BETWEEN 9
AND 11) AS error, count(*) FILTER (level >= 12) AS critical,
count(*) FILTER (level BETWEEN 5 AND 8) AS warning, count(*) FILTER (level < 2) AS debug FROM alerts GROUP BY 1""")
def log_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.log_summary(alerts(spark, d).withColumn("name", level_name()), "rule_id", "name")


@query("WITH {alerts} SELECT (floor(score / 10) * 10)::BIGINT AS bucket, count(*) AS n FROM alerts GROUP BY 1")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.score_histogram(alerts(spark, d))


@query("""WITH {alerts} SELECT round(avg(score), 6) AS mean, median(score) AS median, min(score) AS least, max(score) AS most, count(*) FILTER (score
>= 62) AS anomalies, round(count(*) FILTER (score >= 62) / count(*), 6) AS rate,
count(*) FILTER (score >= 70) AS high FROM alerts""")
def score_statistics(spark: SparkSession, d: str) -> DataFrame:
    return A.score_statistics(alerts(spark, d)).withColumns({"mean": F.round("mean", 6), "rate": F.round("rate", 6)})


@query("""WITH {alerts}, s AS (SELECT avg(score) AS mean, count(*) FILTER (score >= 62) / count(*) AS rate, count(*) FILTER (score >= 70) AS high FROM alerts)
SELECT array_to_string(list_filter([CASE WHEN mean > 60 THEN 'mean score is high' END, CASE WHEN mean < 20 THEN 'mean score is low' END, CASE WHEN
rate > 0.25 THEN 'anomaly rate is high' END, CASE WHEN rate < 0.05 THEN 'anomaly rate is low' END, CASE WHEN high = 0 THEN 'no high scores' END],
lambda x: x IS NOT NULL), ';') AS messages FROM s""")
def model_health(spark: SparkSession, d: str) -> DataFrame:
    return A.model_health_flags(A.score_statistics(alerts(spark, d))).select(F.array_join("messages", ";").alias("messages"))


@query("""WITH {alerts} SELECT CASE WHEN score < 20 THEN 'LOW' WHEN score < 40 THEN 'MODERATE' WHEN score < 60 THEN 'ELEVATED' WHEN score < 80 THEN
'HIGH' ELSE 'SEVERE' END AS band,
count(*) FILTER (is_attack) AS attack, count(*) FILTER (NOT is_attack) AS clean FROM alerts GROUP BY 1""")
def score_bands(spark: SparkSession, d: str) -> DataFrame:
    return A.score_bands(alerts(spark, d))


@query("""WITH {alerts}, m AS (SELECT count(*) FILTER (is_attack) AS attack_n, round(avg(score) FILTER (is_attack), 6) AS attack_avg, max(score)
FILTER (is_attack) AS attack_max, min(score) FILTER (is_attack) AS attack_min, round(100 * count(*) FILTER (is_attack AND score >= 62) / count(*)
FILTER (is_attack), 6) AS attack_rate,
count(*) FILTER (NOT is_attack) AS clean_n, round(avg(score) FILTER (NOT is_attack), 6) AS clean_avg, max(score) FILTER (NOT is_attack) AS clean_max,
min(score) FILTER (NOT is_attack) AS clean_min, round(100 * count(*) FILTER (NOT is_attack AND score >= 62) / count(*) FILTER (NOT is_attack), 6) AS
clean_rate, round(avg(score) FILTER (is_attack) - avg(score) FILTER (NOT is_attack), 6) AS separation FROM alerts)
SELECT *, CASE WHEN separation >= 30 AND attack_rate >= 50 THEN 'GOOD' WHEN separation >= 15 THEN 'FAIR' ELSE 'POOR' END AS verdict FROM m""")
def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = A.verdict(A.class_metrics(alerts(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("attack_avg", "attack_rate", "clean_avg", "clean_rate", "separation")})


@query("""WITH {alerts} SELECT description AS rule_description, count(*) AS n, round(avg(score), 6) AS avg_score, max(score) AS max_score, floor(100 *
count(*) FILTER (score >= 62) / count(*))::BIGINT AS detection FROM alerts GROUP BY 1""")
def per_rule_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return A.per_rule_breakdown(alerts(spark, d).withColumnRenamed("description", "rule_description")).withColumn("avg_score", F.round("avg_score", 6))


@query("""WITH {alerts} SELECT quantile_cont(value, 0.02) AS score_min, quantile_cont(value, 0.98) AS score_max, greatest(40,
trunc(quantile_cont(score, 0.9)))::INT AS threshold FROM alerts WHERE NOT is_attack""")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    clean = alerts(spark, d).filter(~F.col("is_attack"))
    return A.calibration_percentiles(clean, "value").crossJoin(F.broadcast(A.anomaly_threshold(clean)))


@query("""WITH per AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS days, sum(n)::BIGINT AS total,
CASE WHEN sum(n) < 100 THEN 'insufficient' WHEN sum(n) < 1000 THEN 'minimal' WHEN sum(n) < 10000 THEN 'good' ELSE 'excellent' END AS tier FROM per""")
def collection_status(spark: SparkSession, d: str) -> DataFrame:
    return A.collection_status(table(spark, d, "events"), F.to_date("ts"))


@query("""WITH h AS (SELECT hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1), t AS (SELECT count(DISTINCT ts::DATE) AS interactions FROM events)
SELECT s.hour::INT AS hour, coalesce(floor(n / interactions), 0)::BIGINT AS average, interactions FROM range(24) AS s(hour) LEFT JOIN h ON h.hour =
s.hour, t""")
def hourly_average(spark: SparkSession, d: str) -> DataFrame:
    return A.hourly_average(table(spark, d, "events"))


@query("""WITH h AS (SELECT dayofweek(ts) + 1 AS weekday, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT dayofweek(ts) + 1
AS weekday, count(DISTINCT ts::DATE) AS interactions FROM events GROUP BY 1)
SELECT w.weekday::INT AS weekday, s.hour::INT AS hour, coalesce(floor(n / interactions), 0)::BIGINT AS average, coalesce(interactions, 0) AS
interactions FROM range(1, 8) AS w(weekday) CROSS JOIN range(24) AS s(hour) LEFT JOIN h ON h.weekday = w.weekday AND h.hour = s.hour LEFT JOIN t ON
t.weekday = w.weekday""")
def weekly_average(spark: SparkSession, d: str) -> DataFrame:
    return A.weekly_average(table(spark, d, "events"))


@query("""WITH {alerts}, per AS (SELECT date_trunc('hour', ts) AS h, rule_id, level, count(*) AS times FROM alerts GROUP BY 1, 2, 3)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, sum(times)::BIGINT AS total_alerts, string_agg(rule_id || '-' || level || '-' || times, ',' ORDER BY
rule_id || '-' || level || '-' || times) AS alerts FROM per GROUP BY h""")
def hourly_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.hourly_totals(alerts(spark, d)).select(stamp("hour").alias("hour"), "total_alerts", F.array_join("alerts", ",").alias("alerts"))


@query("WITH {alerts} SELECT DISTINCT unnest(groups) AS name FROM alerts")
def distinct_groups(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_values(alerts(spark, d), "groups", "name")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.table_counts({t: table(spark, d, t) for t in TABLES})


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1")
def entity_sets(spark: SparkSession, d: str) -> DataFrame:
    return A.entity_sets(table(spark, d, "events").withColumnRenamed("event_type", "kinds"), ["user_id"], ["kinds"])


# sequences, ranks, pages -----------------------------------------------------------------------
@query("""WITH {alerts}, f AS (SELECT strftime(ts, '%Y-%m-%d %H') AS hour, rule_id, user_id, id, row_number() OVER (PARTITION BY strftime(ts,
'%Y-%m-%d %H'), rule_id, user_id ORDER BY id) AS r FROM alerts) SELECT hour, rule_id, user_id, id FROM f WHERE r = 1""")
def dedup_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    rows = alerts(spark, d).select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "rule_id", "user_id", "id")
    return W.first_by_fingerprint(rows, ["hour", "rule_id", "user_id"], "id")


@query("WITH {alerts} SELECT id, level, score FROM alerts ORDER BY ts DESC, id DESC LIMIT 500")
def latest_alerts(spark: SparkSession, d: str) -> DataFrame:
    return W.latest_n(alerts(spark, d), 500).select("id", "level", "score")


@query("WITH {alerts} SELECT id, level, (SELECT count(*) FROM alerts) AS total FROM alerts ORDER BY level DESC, id LIMIT 50 OFFSET 100")
def page_of_alerts(spark: SparkSession, d: str) -> DataFrame:
    return W.page(alerts(spark, d).select("id", "level"), [F.desc("level"), F.asc("id")], 100, 50)


@query("""WITH {alerts} (SELECT id, score, 'high' AS side FROM alerts ORDER BY score DESC, id LIMIT 15) UNION ALL (SELECT id, score, 'low' FROM alerts
ORDER BY score, id LIMIT 5)""")
def top_and_bottom_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = alerts(spark, d).select("id", "score")
    return W.top_n(rows, "score", 15, "id").withColumn("side", F.lit("high")).unionByName(W.top_n(rows, "score", 5, "id", lowest=True).withColumn("side", F.lit("low")))


@query("""WITH {alerts} SELECT id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY score DESC,
id)::INT AS rank FROM alerts""")
def prioritised_events(spark: SparkSession, d: str) -> DataFrame:
    return W.prioritise_events(alerts(spark, d).select("id", "score", F.date_format("ts", "yyyy-MM-dd").alias("day")), ["day"], "score").drop("score")


@query("""WITH {alerts} SELECT id, user_id, round(0.4 * score + 0.3 * level * 6 + 30 * (value / 500), 6) AS combined, row_number() OVER (PARTITION BY
user_id ORDER BY round(0.4 * score + 0.3 * level * 6 + 30 * (value / 500), 6) DESC, id)::INT AS rank FROM alerts""")
def ranked_threats(spark: SparkSession, d: str) -> DataFrame:
    rows = alerts(spark, d).select("id", "user_id", F.col("score").alias("anomaly_score"), (F.col("level") * 6).alias("pattern_score"), (F.col("value") / 500).alias("similarity"))
    scored = W.rank_threats(rows, ["user_id"]).select("id", "user_id", F.round("combined_rank_score", 6).alias("combined"))
    return W.prioritise_events(scored, ["user_id"], "combined")


@query("""WITH s AS (SELECT user_id % 7 AS session, event_id AS s FROM events WHERE event_type <> 'click'), g AS (SELECT session, s, s - row_number()
OVER (PARTITION BY session ORDER BY s) AS k FROM s) SELECT session, min(s) AS first, max(s) AS last FROM g GROUP BY session, k""")
def sequence_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").filter("event_type <> 'click'").withColumn("session", F.col("user_id") % 7)
    return W.sequence_intervals(rows, ["session"], "event_id")


@query("""WITH s AS (SELECT event_type AS session, event_id AS s, lead(event_id) OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events), e
AS (SELECT session, min(s) AS lo, max(s) AS hi FROM s GROUP BY 1), t AS (SELECT count(*) AS size FROM events)
SELECT session, s + 1 AS first, n - 1 AS last FROM s WHERE n > s + 1 UNION ALL SELECT session, 0, lo - 1 FROM e WHERE lo > 0 UNION ALL SELECT session,
hi + 1, 200000 - 1 FROM e WHERE hi < 200000 - 1""")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return W.sequence_gaps(table(spark, d, "events").withColumnRenamed("event_type", "session"), ["session"], "event_id", F.lit(200000))


# episodes --------------------------------------------------------------------------------------
SESSION_SQL = """m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > {gap}::BIGINT * 1000000 THEN 1 ELSE 0 END AS new FROM alerts
WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS
session FROM m)"""


@query("WITH {alerts}, " + SESSION_SQL.format(gap=43200) + """ SELECT user_id, session::BIGINT AS session, count(*) AS attempts, count(*) FILTER
(is_attack) AS failed, bool_or(rule_id = 'signup') AS mfa, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, CASE WHEN count(*) FILTER (is_attack) > 5
THEN 'high' ELSE 'low' END AS severity FROM s GROUP BY 1, 2""")
def auth_episodes(spark: SparkSession, d: str) -> DataFrame:
    out = A.auth_episodes(alerts(spark, d), "user_id", F.col("is_attack"), F.col("rule_id") == "signup", 43200)
    return out.select("user_id", "session", "attempts", "failed", "mfa", stamp("start").alias("start"), "severity")


@query("WITH {alerts}, " + SESSION_SQL.format(gap=43200) + """ SELECT user_id, session::BIGINT AS session, count(*) AS connections, count(DISTINCT
floor(value)) AS ports, sum(level)::BIGINT AS bytes_sent, sum(score)::BIGINT AS bytes_received, count(DISTINCT floor(value)) > 10 AS scan FROM s GROUP
BY 1, 2""")
def network_episodes(spark: SparkSession, d: str) -> DataFrame:
    out = A.network_episodes(alerts(spark, d), "user_id", F.floor("value"), F.col("level"), F.col("score"), 43200)
    return out.select("user_id", "session", "connections", "ports", "bytes_sent", "bytes_received", (F.size("tags") > 0).alias("scan"))


@query("""WITH {alerts} SELECT level::BIGINT AS tree, count(*) AS process_count, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(DISTINCT
user_id) AS n_users FROM alerts GROUP BY 1 ORDER BY process_count DESC, tree LIMIT 1""")
def process_episode(spark: SparkSession, d: str) -> DataFrame:
    rows = alerts(spark, d).select("id", "ts", F.col("id").alias("pid"), F.col("level").cast("bigint").alias("ppid"), F.col("user_id").alias("user"), F.col("rule_id").alias("host"))
    return A.process_episode(rows).select("tree", "process_count", stamp("start").alias("start"), F.size("users").cast("bigint").alias("n_users"))


CORRELATED_SQL = "f AS (SELECT id, user_id, ts FROM alerts QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, id) <= 11), c AS (SELECT a.id AS alert_id, e.id AS event_id, row_number() OVER (PARTITION BY a.id ORDER BY e.ts, e.id)::INT AS rank FROM alerts a JOIN f e ON a.user_id = e.user_id AND a.id <> e.id)"


@query("WITH {alerts}, " + CORRELATED_SQL + " SELECT * FROM c WHERE rank <= 10")
def correlated_events(spark: SparkSession, d: str) -> DataFrame:
    rows = alerts(spark, d)
    return J.correlated_events(rows, rows, ["user_id"])


@query("WITH {alerts}, " + CORRELATED_SQL + """, l AS (SELECT alert_id, string_agg(event_id, ',' ORDER BY rank) AS refs FROM c WHERE rank <= 10 GROUP
BY 1) SELECT id, CASE WHEN level >= 12 THEN 'critical' WHEN level >= 10 THEN 'high' WHEN level >= 7 THEN 'medium' ELSE 'low' END AS severity, refs
FROM alerts LEFT JOIN l ON id = alert_id""")
def alert_episodes(spark: SparkSession, d: str) -> DataFrame:
    rows = alerts(spark, d)
    return A.alert_episode(rows, J.correlated_events(rows, rows, ["user_id"])).select("id", "severity", F.array_join(F.transform("raw_refs", lambda x: x.cast("string")), ",").alias("refs"))


# lookups ---------------------------------------------------------------------------------------
def nations(spark: SparkSession, d: str) -> DataFrame:
    """Nations of the first three regions as key and value."""
    return table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def lookup_semi(spark: SparkSession, d: str) -> DataFrame:
    return J.lookup_exists(table(spark, d, "customer"), nations(spark, d), "c_nationkey").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def lookup_anti(spark: SparkSession, d: str) -> DataFrame:
    return J.lookup_absent(table(spark, d, "customer"), nations(spark, d), "c_nationkey").select("c_custkey")


@query("SELECT c_custkey, coalesce(n_name, c_mktsegment) AS place FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey < 3")
def lookup_value(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumn("place", F.col("c_mktsegment"))
    return J.lookup_value(rows, nations(spark, d), "c_nationkey", "place").select("c_custkey", "place")


@query("""SELECT c_custkey, nation, coalesce(region, 'none') AS region FROM (SELECT c_custkey, c_mktsegment AS nation, CASE WHEN n_regionkey < 3 THEN
n_name END AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)""")
def lookup_merge(spark: SparkSession, d: str) -> DataFrame:
    kv = nations(spark, d).select("key", F.create_map(F.lit("region"), "value").alias("value"))
    rows = table(spark, d, "customer").withColumn("m", F.create_map(F.lit("nation"), F.col("c_mktsegment"), F.lit("region"), F.lit("none")))
    return J.lookup_merge(rows, kv, "c_nationkey", "m").select("c_custkey", F.col("m")["nation"].alias("nation"), F.col("m")["region"].alias("region"))


@query("""WITH k AS (SELECT p_partkey, unnest([p_size % 25, (p_size * 7) % 25, 99]) AS key, unnest([0, 1, 2]) AS pos FROM part) SELECT p_partkey,
string_agg(n_name, ',' ORDER BY pos) AS names FROM part LEFT JOIN (SELECT * FROM k JOIN nation ON key = n_nationkey AND n_regionkey < 3) USING
(p_partkey) GROUP BY 1""")
def lookup_array(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.array(F.col("p_size") % 25, (F.col("p_size") * 7) % 25, F.lit(99)).alias("keys"))
    return J.lookup_array(rows, nations(spark, d), "keys", "names").select("p_partkey", F.array_join("names", ",").alias("names"))


@query("SELECT p_partkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM part LEFT JOIN nation ON (p_size >> n_nationkey) & 1 = 1 GROUP BY 1")
def lookup_bitmask(spark: SparkSession, d: str) -> DataFrame:
    bits = table(spark, d, "nation").select(F.col("n_nationkey").alias("bit"), F.col("n_name").alias("value"))
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("0x"), F.hex("p_size")).alias("mask"))
    return J.lookup_bitmask(rows, bits, "mask", "names").select("p_partkey", F.array_join("names", ",").alias("names"))


@query("""WITH e AS (SELECT event_id, 167772160 + (user_id * 7919) % 1000000 AS n FROM events), net AS (SELECT n_name, 167772160 + n_nationkey * 40000
AS lo, 167772160 + n_nationkey * 40000 + 29999 AS hi FROM nation) SELECT event_id, n_name AS network FROM e LEFT JOIN net ON n BETWEEN lo AND hi""")
def geo_range_enrich(spark: SparkSession, d: str) -> DataFrame:
    n = F.lit(167772160) + (F.col("user_id") * 7919) % 1000000
    octet = lambda k: F.shiftright(n, k).bitwiseAND(255).cast("string")
    rows = table(spark, d, "events").select("event_id", F.concat_ws(".", octet(24), octet(16), octet(8), octet(0)).alias("ip"))
    lo = F.lit(167772160).cast("bigint") + F.col("n_nationkey") * 40000
    nets = table(spark, d, "nation").select(lo.alias("net_lo"), (lo + 29999).alias("net_hi"), F.col("n_name").alias("record"))
    return J.range_enrich(rows, nets, "ip", "network").select("event_id", "network")


@query("""SELECT c_custkey AS id, string_agg(r_name, ',' ORDER BY r_regionkey DESC) AS groups FROM customer LEFT JOIN region ON (c_custkey +
r_regionkey) % 3 = 0 GROUP BY 1""")
def agent_groups(spark: SparkSession, d: str) -> DataFrame:
    agents = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    groups = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    belongs = agents.select(F.col("id").alias("id_agent"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("id_group")).filter((F.col("id_agent") + F.col("id_group")) % 3 == 0).withColumn("priority", -F.col("id_group"))
    return J.agent_group_join(agents, belongs, groups).select("id", F.array_join("groups", ",").alias("groups"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 < 2 THEN n_name ELSE c_mktsegment END AS place, CASE WHEN c_custkey % 4 < 2 THEN 2 ELSE CASE
WHEN c_custkey % 4 = 2 THEN 3 ELSE 4 END END AS version FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def agent_metadata_update(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("agent_id"), F.col("c_mktsegment").alias("place"), F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 4 + 1).cast("int")).alias("version"))
    updates = table(spark, d, "nation").select(F.col("n_nationkey").alias("agent_id"), F.lit(2).alias("version"), F.col("n_name").alias("place"))
    return J.agent_metadata_update(docs, updates, ["place"]).select("id", "place", "version")


@query("SELECT c_custkey AS id, n_name AS place FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 > 0")
def agent_metadata_repair(spark: SparkSession, d: str) -> DataFrame:
    truth = table(spark, d, "nation").select(F.col("n_nationkey").alias("agent_id"), F.col("n_name").alias("place"))
    docs = table(spark, d, "customer").withColumnRenamed("c_nationkey", "agent_id").join(truth, "agent_id").select(F.col("c_custkey").alias("id"), "agent_id", F.when(F.col("c_custkey") % 3 == 0, F.col("place")).alias("place"))
    return J.agent_metadata_repair(docs, truth, ["place"]).select("id", "place")


# state tables ----------------------------------------------------------------------------------
def snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders before and after: a tenth is new, a tenth is gone, of the rest every seventh has another price."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    k = F.col("o_orderkey") % 10
    changed = F.when(F.col("o_orderkey") % 7 == 0, F.round(F.col("o_totalprice") + 1, 2)).otherwise(F.col("o_totalprice"))
    return o.filter(k != 0), o.filter(k != 1).withColumn("o_totalprice", changed)


SNAP_SQL = """o AS (SELECT o_orderkey AS k, o_orderstatus AS s, round(o_totalprice, 2) AS p FROM orders), a AS (SELECT * FROM o WHERE k % 10 <> 0), b
AS (SELECT k, s, CASE WHEN k % 7 = 0 THEN round(p + 1, 2) ELSE p END AS p FROM o WHERE k % 10 <> 1)"""


@query("WITH " + SNAP_SQL + " SELECT coalesce(a.k, b.k) AS o_orderkey, CASE WHEN a.k IS NULL THEN 'INSERTED' WHEN b.k IS NULL THEN 'DELETED' ELSE 'MODIFIED' END AS operation, a.p AS old_price, b.p AS new_price FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.p <> b.p")
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    out = D.snapshot_diff(*snapshots(spark, d), ["o_orderkey"])
    return out.select("o_orderkey", "operation", F.col("old.o_totalprice").alias("old_price"), F.col("new.o_totalprice").alias("new_price"))


@query("WITH " + SNAP_SQL + " SELECT a.k AS o_orderkey, 'o_totalprice' AS changed, round(a.p, 2) AS previous FROM a JOIN b ON a.k = b.k WHERE a.p <> b.p")
def changed_fields(spark: SparkSession, d: str) -> DataFrame:
    diff = D.snapshot_diff(*snapshots(spark, d), ["o_orderkey"]).filter("operation = 'MODIFIED'")
    out = D.old_values(diff, ["o_orderstatus", "o_totalprice"])
    return out.select("o_orderkey", F.array_join("changed", ",").alias("changed"), F.col("previous")["o_totalprice"].cast("double").alias("previous"))


@query("WITH " + SNAP_SQL + " SELECT l_orderkey, l_linenumber, 'DELETED' AS operation FROM lineitem WHERE l_orderkey IN (SELECT k FROM a WHERE k NOT IN (SELECT k FROM b))")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    old, new = snapshots(spark, d)
    gone = W.snapshot_except(old, new, ["o_orderkey"]).select(F.col("o_orderkey").alias("l_orderkey"))
    return D.cascade_delete(gone, table(spark, d, "lineitem"), ["l_orderkey"]).select("l_orderkey", "l_linenumber", "operation")


def pending_operation() -> Column:
    return F.when(F.col("event_type") == "signup", "CREATE").when(F.col("event_type") == "error", "DELETE").otherwise("MODIFY")


@query("""WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'MODIFY' END AS op FROM events),
s AS (SELECT *, op <> 'CREATE' AND coalesce(lag(op) OVER (PARTITION BY user_id ORDER BY event_id), 'DELETE') = 'DELETE' AS shows FROM p),
g AS (SELECT user_id AS id, max(event_id) AS seq, bool_or(shows) AS existing, arg_max(op, event_id) AS l FROM s GROUP BY 1)
SELECT id, seq, CASE WHEN existing THEN l ELSE 'CREATE' END AS operation, existing FROM g WHERE existing OR l <> 'DELETE'""")
def coalesce_changes(spark: SparkSession, d: str) -> DataFrame:
    pending = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), pending_operation().alias("operation"), F.col("props").alias("data"))
    return D.coalesce_changes(pending).drop("data")


def order_checksum() -> Column:
    return A.row_checksum(*map(F.col, ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")))


CHECKSUM_SQL = "sha1(concat_ws(':', o_orderkey, o_custkey, o_orderstatus, o_orderpriority))"


@query(f"WITH r AS (SELECT o_custkey % 50 AS agent, {CHECKSUM_SQL} AS c FROM orders) SELECT agent, sha1(string_agg(c, '' ORDER BY c)) AS table_checksum, count(*) AS n FROM r GROUP BY 1")
def table_checksum(spark: SparkSession, d: str) -> DataFrame:
    return A.table_checksum(table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("agent"), order_checksum().alias("checksum")), ["agent"])


@query(f"""WITH r AS (SELECT o_custkey % 50 AS agent, substr({CHECKSUM_SQL}, 1, 2) AS b, {CHECKSUM_SQL} AS c FROM orders), i AS (SELECT agent, b,
sha1(string_agg(c, '' ORDER BY c)) AS c, count(*) AS n FROM r GROUP BY 1, 2) SELECT agent, sha1(string_agg(b || c, '' ORDER BY b || c)) AS
table_checksum, sum(n)::BIGINT AS n FROM i GROUP BY 1""")
def table_checksum_levels(spark: SparkSession, d: str) -> DataFrame:
    return A.table_checksum_levels(table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("agent"), order_checksum().alias("checksum")), ["agent"])


TREE_SQL = ", ".join(f"l{i} AS (SELECT agent, depth, CASE WHEN depth >= {i} THEN substr(x.b, 1, {3 * i - 3}) ELSE x.b END AS b, CASE WHEN depth >= {i} THEN sha1(string_agg(x.b || x.c, '' ORDER BY x.b || x.c)) ELSE max(x.c) END AS c, sum(x.n)::BIGINT AS n FROM l{i + 1} x GROUP BY 1, 2, 3)" for i in (3, 2, 1))


@query(f"""WITH e AS (SELECT o_custkey % 50 AS agent, {CHECKSUM_SQL} AS c, count(*) AS k FROM orders GROUP BY 1, 2), s AS (SELECT agent, least(3,
greatest(0, ceil(ln(count(*) / 4096) / ln(4096))))::INT AS depth FROM e GROUP BY 1),
l4 AS (SELECT agent, depth, substr(sha1(c), 1, 3 * depth) AS b, sha1(string_agg(c || ':' || k, ',' ORDER BY c || ':' || k)) AS c, sum(k)::BIGINT AS n
FROM e JOIN s USING (agent) GROUP BY agent, depth, substr(sha1(e.c), 1, 3 * depth)), {TREE_SQL} SELECT agent, c AS table_checksum, n FROM l1""")
def table_checksum_tree(spark: SparkSession, d: str) -> DataFrame:
    return A.checksum_tree(table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("agent"), order_checksum().alias("checksum")), ["agent"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey % 50 IN (SELECT o_custkey % 50 FROM orders WHERE o_orderkey % 101 = 0)")
def integrity_mismatch(spark: SparkSession, d: str) -> DataFrame:
    mine = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("agent"), order_checksum().alias("checksum"))
    theirs = mine.withColumn("checksum", F.when(F.col("o_orderkey") % 101 == 0, F.lit("old")).otherwise(F.col("checksum")))
    return D.integrity_mismatch(mine, theirs, ["agent"]).select("o_orderkey")


@query("""WITH c AS (SELECT user_id AS key, arg_max(event_type, event_id) AS t, arg_max(props, event_id) AS p FROM events GROUP BY 1), s AS (SELECT
c_custkey AS key, c_name AS payload FROM customer)
SELECT key, payload FROM s WHERE key NOT IN (SELECT key FROM c) UNION ALL SELECT key, p FROM c WHERE t <> 'error'""")
def feed_upsert(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("payload"))
    kind = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    changes = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("offset"), kind.alias("type"), F.col("props").alias("payload"))
    return D.feed_upsert(state, changes)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000")
def max_rows_cap(spark: SparkSession, d: str) -> DataFrame:
    return D.max_rows_cap(table(spark, d, "orders"), 1000, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("""WITH k AS (SELECT user_id, max(ts) AS t FROM events GROUP BY 1), m AS (SELECT max(ts) AS now FROM events) SELECT user_id AS id, CASE WHEN
epoch(now) - epoch(t) > 21600 THEN 'disconnected' ELSE 'active' END AS new_status, epoch(now) - epoch(t) > 21600 + 43200 AS alert FROM k, m""")
def agent_disconnect(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    agents = e.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_keepalive"), F.lit("active").alias("status"))
    out = agents.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return D.agent_disconnect(out, F.col("now"), 21600, 43200).select("id", "new_status", "alert")


@query("SELECT DISTINCT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 200")
def select_rows(spark: SparkSession, d: str) -> DataFrame:
    return D.select_rows(table(spark, d, "orders"), ["o_orderkey", "o_custkey"], F.col("o_orderstatus") == "F", True, ["o_orderkey"], 200)


# vulnerability matching ------------------------------------------------------------------------
def inventory(spark: SparkSession, d: str) -> DataFrame:
    """Parts as installed packages of suppliers: the product is the brand, the version is made of size and key."""
    p = table(spark, d, "part")
    version = F.concat_ws(".", F.col("p_size"), F.col("p_partkey") % 10)
    return p.select((F.col("p_partkey") % 20).alias("agent_id"), F.col("p_brand").alias("item"), version.alias("version")).distinct().withColumn("version_key", V.version_key(F.col("version"), "majorminor"))


def feed(spark: SparkSession, d: str) -> DataFrame:
    """Brands as products, each with three version entries."""
    brands = table(spark, d, "part").select(F.col("p_brand").alias("product")).distinct().withColumn("b", F.regexp_extract("product", r"(\d+)", 1).cast("int"))
    entry = lambda low, less, most, status, exact: F.struct(low.cast("string").alias("low"), less.cast("string").alias("less"), most.cast("string").alias("most"), F.lit(status).alias("status"), F.lit(exact).alias("exact"))
    none = F.lit(None)
    b = F.col("b")
    entries = F.array(entry(F.concat(b, F.lit(".3")), none, none, "unaffected", True), entry(F.lit("0"), F.concat(b % 20, F.lit(".5")), none, "affected", False), entry(F.concat(b % 20 + 5, F.lit(".0")), none, F.concat(b % 20 + 9, F.lit(".9")), "affected", False))
    out = brands.select("product", F.concat(F.lit("CVE-"), "product").alias("cve"), F.lit("vendor").alias("source"), F.lit("unaffected").alias("default_status"), F.posexplode(entries).alias("pos", "e")).select("*", "e.*").drop("e")
    return out.withColumns({f"{c}_key": V.version_key(F.col(c), "majorminor") for c in ("low", "less", "most")})


VULN_SQL = """i AS (SELECT DISTINCT p_partkey % 20 AS agent_id, p_brand AS item, p_size AS a, p_partkey % 10 AS b FROM part), x AS (SELECT *,
CAST(regexp_extract(item, '(\\d+)', 1) AS INT) AS n FROM i),
f AS (SELECT agent_id, item, a || '.' || b AS version, 'CVE-' || item AS cve FROM x WHERE NOT (a = n AND b = 3) AND ((a, b) < (n % 20, 5) OR ((a, b)
>= (n % 20 + 5, 0) AND (a, b) <= (n % 20 + 9, 9))))"""


@query("WITH " + VULN_SQL + " SELECT agent_id, item, version, cve, 'vendor' AS source FROM f")
def vulnerability_scan(spark: SparkSession, d: str) -> DataFrame:
    return J.vulnerability_scan(inventory(spark, d), feed(spark, d))


@query("WITH " + VULN_SQL + " SELECT agent_id, item, version, cve FROM f WHERE CAST(regexp_extract(item, '(\\d+)', 1) AS INT) % 2 = 0 AND agent_id % 3 <> CAST(regexp_extract(item, '(\\d+)', 1) AS INT) % 3")
def remediation_filter(spark: SparkSession, d: str) -> DataFrame:
    found = J.vulnerability_scan(inventory(spark, d), feed(spark, d))
    number = F.regexp_extract("cve", r"(\d+)", 1).cast("int")
    remediations = found.select("cve").distinct().filter(number % 2 == 0).withColumn("update", F.concat(F.lit("KB"), number % 3))
    hotfixes = found.select("agent_id").distinct().withColumn("hotfix", F.concat(F.lit("KB"), F.col("agent_id") % 3))
    return J.remediation_filter(found, remediations, hotfixes).select("agent_id", "item", "version", "cve")


@query("WITH " + VULN_SQL + ", k AS (SELECT DISTINCT agent_id, item, cve FROM f) SELECT agent_id, item, cve, CASE WHEN agent_id % 4 = 0 THEN 'INSERTED' ELSE 'DELETED' END AS operation FROM k WHERE agent_id % 4 < 2")
def finding_state_diff(spark: SparkSession, d: str) -> DataFrame:
    found = J.vulnerability_scan(inventory(spark, d), feed(spark, d))
    return J.finding_state_diff(found.filter("agent_id % 4 <> 0"), found.filter("agent_id % 4 <> 1"))


@query("""WITH v AS (SELECT p_partkey, (p_size % 3) || '.' || (p_partkey % 12) AS a, (p_partkey % 3) || '.' || (p_size % 12) AS b, p_size % 3 AS a1,
p_partkey % 12 AS a2, p_partkey % 3 AS b1, p_size % 12 AS b2 FROM part)
SELECT p_partkey, CASE WHEN (a1, a2) < (b1, b2) THEN -1 WHEN (a1, a2) > (b1, b2) THEN 1 ELSE 0 END AS sign FROM v""")
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.concat_ws(".", F.col("p_size") % 3, F.col("p_partkey") % 12), F.concat_ws(".", F.col("p_partkey") % 3, F.col("p_size") % 12)
    return table(spark, d, "part").select("p_partkey", V.package_compare(a, b, "dpkg").alias("sign"))


# filters and routing ---------------------------------------------------------------------------
@query("""WITH {alerts} SELECT id, CASE WHEN level >= 12 THEN 'page' WHEN rule_id = 'error' THEN 'ticket' WHEN level >= 6 THEN 'log' ELSE 'unrouted'
END AS route, CASE WHEN is_attack THEN CASE WHEN rule_id = 'error' THEN 'attack/error' ELSE 'attack' END ELSE CASE WHEN rule_id IN ('click', 'view')
THEN 'clean/web' ELSE 'clean' END END AS path FROM alerts""")
def routes_and_decoders(spark: SparkSession, d: str) -> DataFrame:
    rule, level, attack = F.col("rule_id"), F.col("level"), F.col("is_attack")
    tree = [("attack", attack, [("error", rule == "error", [])]), ("clean", ~attack, [("web", rule.isin("click", "view"), [])])]
    return alerts(spark, d).select("id", L.route_by_priority([("page", level >= 12), ("ticket", rule == "error"), ("log", level >= 6)]).alias("route"), F.array_join(L.decoder_tree(tree), "/").alias("path"))


@query("""WITH {alerts} SELECT id, concat_ws(',', CASE WHEN level >= 10 THEN 'high' END, CASE WHEN score % 2 = 0 THEN 'even' END, CASE WHEN rule_id =
'error' THEN 'error' END) AS rules FROM alerts""")
def rule_broadcast(spark: SparkSession, d: str) -> DataFrame:
    rules = [("high", F.col("level") >= 10), ("even", F.col("score") % 2 == 0), ("error", F.col("rule_id") == "error")]
    return alerts(spark, d).select("id", F.array_join(L.rule_broadcast(rules), ",").alias("rules"))


@query("WITH {alerts} SELECT id FROM alerts WHERE level BETWEEN 5 AND 9 AND list_contains(groups, 'click')")
def catalog_filters(spark: SparkSession, d: str) -> DataFrame:
    return L.catalog_filters(alerts(spark, d), level=(5, 9), group="click").select("id")


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 'AKIA|password')")
def discard_regex(spark: SparkSession, d: str) -> DataFrame:
    return L.discard_regex(table(spark, d, "documents"), F.col("text"), "AKIA|password").select("doc_id")


@query("""SELECT event_id FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-05' OR NOT EXISTS (SELECT 1 FROM events WHERE strftime(ts, '%Y-%m-%d')
= '2024-01-05')""")
def day_filter(spark: SparkSession, d: str) -> DataFrame:
    return L.day_filter_with_fallback(table(spark, d, "events"), stamp("ts"), "2024-01-05").select("event_id")


@query("SELECT page_id FROM pages WHERE contains(url, 'example.org') OR contains(CAST(page_id AS VARCHAR), 'example.org')")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return L.text_search(table(spark, d, "pages"), "example.org", ["page_id", "url"]).select("page_id")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%tion%' AND source = 'src1' ORDER BY doc_id DESC LIMIT 20")
def ilike_search(spark: SparkSession, d: str) -> DataFrame:
    return L.ilike_search(table(spark, d, "documents"), "tion", ["text"], "doc_id", 20, source="src1").select("doc_id")


@query("""SELECT 1 AS one, count(*) FILTER (try_cast(c_name AS INT) IS NULL) AS bad_name, count(*) FILTER (c_nationkey NOT BETWEEN -128 AND 127) AS
bad_nation FROM customer""")
def schema_conformance(spark: SparkSession, d: str) -> DataFrame:
    out = L.schema_conformance(table(spark, d, "customer"), {"c_name": "integer", "c_nationkey": "byte", "c_acctbal": "double"})
    return out.agg(F.lit(1).alias("one"), F.count_if(F.array_contains("violations", "c_name")).alias("bad_name"), F.count_if(F.array_contains("violations", "c_nationkey")).alias("bad_nation"))


@query("""SELECT lpad(CAST(o_custkey AS VARCHAR), greatest(3, length(CAST(o_custkey AS VARCHAR)))::INT, '0') AS agent_id, o_orderkey AS task_id,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS create_time FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100 OFFSET 20""")
def task_query(spark: SparkSession, d: str) -> DataFrame:
    epoch = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("agent_id"), F.col("o_orderstatus").alias("status"), epoch.alias("create_time"), epoch.alias("last_update_time"))
    return L.task_query(tasks, status="F", offset=20, limit=100).select("agent_id", "task_id", "create_time")


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS name, CASE WHEN regexp_matches(p_brand, '1$') THEN 'one' END AS tag FROM part")
def keyed_normalizer(spark: SparkSession, d: str) -> DataFrame:
    entries = [{"find_field": "p_name", "find_pattern": " ", "replace_field": "p_name", "replace_pattern": " ", "replace_value": "_"}, {"find_field": "p_brand", "find_pattern": "1$", "add_field": "tag", "add_value": "one"}]
    return L.keyed_normalizer(table(spark, d, "part"), entries).select("p_partkey", F.col("p_name").alias("name"), "tag")


# functions -------------------------------------------------------------------------------------
@query("""SELECT event_id, user_id > 100 AS gt, user_id >= 100 AS ge, user_id < 100 AS lt, user_id <= 100 AS le, user_id = 100 AS eq, user_id <> 100
AS ne, value > 250.5 AS num_gt, event_type > 'error' AS str_gt, event_type <= 'error' AS str_le, (user_id & 12) <> 0 AS bits FROM events""")
def predicate_numbers(spark: SparkSession, d: str) -> DataFrame:
    f, u = P.PREDICATES, F.col("user_id")
    ints = {"gt": "greater", "ge": "greater_or_equal", "lt": "less", "le": "less_or_equal", "eq": "equal", "ne": "not_equal"}
    return table(spark, d, "events").select("event_id", *(f[f"int_{op}"](u, 100).alias(n) for n, op in ints.items()), f["number_greater"](F.col("value"), 250.5).alias("num_gt"), f["string_greater"](F.col("event_type"), "error").alias("str_gt"), f["string_less_or_equal"](F.col("event_type"), "error").alias("str_le"), P.binary_and(F.concat(F.lit("0x"), F.hex("user_id")), "0xC").alias("bits"))


@query("SELECT page_id, starts_with(url, 'https') AS s, suffix(url, 'x') AS e, contains(url, 'page') AS c, regexp_matches(url, 'example\\.(net|org)') AS r, NOT regexp_matches(url, '^https') AS n FROM pages")
def predicate_strings(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", P.starts_with(u, "https").alias("s"), P.ends_with(u, "x").alias("e"), P.contains(u, "page").alias("c"), P.regex_match(u, r"example\.(net|org)").alias("r"), P.regex_not_match(u, "^https").alias("n"))


@query("""WITH {alerts} SELECT id, list_has_all(groups, ['click', 'severe']) AS every, list_has_any(groups, ['click', 'severe']) AS some, NOT
list_has_all(groups, ['click', 'severe']) AS not_every, NOT list_has_any(groups, ['click', 'severe']) AS none, rule_id IN ('click', 'view') AS listed
FROM alerts""")
def predicate_arrays(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("groups")
    return alerts(spark, d).select("id", P.array_contains(g, "click", "severe").alias("every"), P.array_contains_any(g, "click", "severe").alias("some"), P.array_not_contains(g, "click", "severe").alias("not_every"), P.array_not_contains_any(g, "click", "severe").alias("none"), P.match_value(F.col("rule_id"), F.array(F.lit("click"), F.lit("view"))).alias("listed"))


@query("""WITH e AS (SELECT event_id, (user_id * 7 % 224) AS a, (user_id % 256) AS b FROM events) SELECT event_id, a = 10 AND b < 128 AS inside, NOT
(a = 10 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR a = 127) AS public FROM e""")
def predicate_addresses(spark: SparkSession, d: str) -> DataFrame:
    ip = F.concat_ws(".", F.col("user_id") * 7 % 224, F.col("user_id") % 256, F.lit(1), F.lit(2))
    return table(spark, d, "events").select("event_id", P.ip_cidr_match(ip, "10.0.0.0", "9").alias("inside"), P.is_public_ip(ip).alias("public"))


@query("""SELECT event_id, (user_id + event_id) * 3 AS total, user_id - event_id AS less, CAST(trunc(event_id / (user_id + 1)) AS BIGINT) AS quotient,
round(value / 3 + user_id, 6) AS ratio, CAST(trunc(value) AS BIGINT) AS cut, value <> 0 AS flag FROM events""")
def math_functions(spark: SparkSession, d: str) -> DataFrame:
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    return table(spark, d, "events").select("event_id", M.int_calculate("mul", M.int_calculate("sum", u, e), 3).alias("total"), M.int_calculate("sub", u, e).alias("less"), M.int_calculate("div", e, u + 1).alias("quotient"), F.round(M.float_calculate("sum", M.float_calculate("div", v, 3), u), 6).alias("ratio"), M.to_int(v).alias("cut"), M.to_bool(v).alias("flag"))


@query("""SELECT p_partkey, upper(p_brand) AS up, lower(p_brand) AS down, p_brand || '-' || p_size AS both, sha1(p_name) AS digest,
regexp_extract(p_type, '^(\\w+)', 1) AS first, replace(p_type, ' ', '+') AS plus, trim(p_brand, 'B1') AS cut, p_size AS number FROM part""")
def string_functions(spark: SparkSession, d: str) -> DataFrame:
    b, t = F.col("p_brand"), F.col("p_type")
    return table(spark, d, "part").select("p_partkey", M.upcase(b).alias("up"), M.downcase(b).alias("down"), M.concat(b, "-", F.col("p_size")).alias("both"), M.sha1(F.col("p_name")).alias("digest"), M.regex_extract(t, r"^(\w+)").alias("first"), T.replace(t, " ", "+").alias("plus"), T.trim(b, "both", "B1").alias("cut"), M.hex_to_number(F.concat(F.lit("0x"), F.hex("p_size"))).cast("int").alias("number"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(epoch(o_orderdate) AS DOUBLE) AS seconds FROM orders""")
def date_functions(spark: SparkSession, d: str) -> DataFrame:
    iso = M.date_from_epoch(F.unix_seconds(F.col("o_orderdate").cast("timestamp")))
    return table(spark, d, "orders").select("o_orderkey", iso.alias("iso")).withColumn("seconds", M.date_to_epoch(F.col("iso")))


@query("""SELECT event_id, user_id % 192 // 8 AS facility, (user_id % 192 % 8) AS severity, CASE user_id % 192 % 8 WHEN 0 THEN 'emergency' WHEN 1 THEN
'alert' WHEN 2 THEN 'critical' WHEN 3 THEN 'error' WHEN 4 THEN 'warning' WHEN 5 THEN 'notice' WHEN 6 THEN 'informational' ELSE 'debug' END AS name
FROM events""")
def syslog_functions(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("user_id") % 192
    return table(spark, d, "events").select("event_id", M.syslog_extract_facility(p)["code"].alias("facility"), M.syslog_extract_severity(p)["code"].alias("severity"), M.syslog_extract_severity(p)["name"].alias("name"))


@query("""SELECT p_partkey, array_to_string([p_brand, p_type, 'x'], ',') AS added, array_to_string(CASE WHEN p_brand = 'Brand#11' THEN [p_brand] ELSE
[p_brand, 'Brand#11'] END, ',') AS once, array_to_string(string_split(p_name, ' '), '|') AS parts FROM part""")
def array_functions(spark: SparkSession, d: str) -> DataFrame:
    own = F.array("p_brand")
    return table(spark, d, "part").select("p_partkey", F.array_join(T.array_append(own, F.col("p_type"), "x"), ",").alias("added"), F.array_join(T.array_append_unique(own, "Brand#11"), ",").alias("once"), F.array_join(T.split(F.lit(None).cast("array<string>"), F.col("p_name"), " "), "|").alias("parts"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, event_type AS kind, 'other' AS source, CASE WHEN event_type = 'click' THEN 1 ELSE 2
END AS left_over FROM events""")
def map_functions(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("props", "map<string,string>")
    merged = T.merge(F.map_concat(m, F.create_map(F.lit("source"), F.lit("own"))), F.create_map(F.lit("source"), F.lit("other"), F.lit("kind"), F.col("event_type")))
    rest = T.delete_fields_with_value(F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("x")), "click")
    return table(spark, d, "events").withColumn("m", merged).select("event_id", T.get_key_in(F.col("m"), "k").alias("k"), T.get_key_in(F.col("m"), "kind").alias("kind"), T.get_key_in(F.col("m"), "source").alias("source"), F.size(rest).alias("left_over"))


# extraction ------------------------------------------------------------------------------------
URL_SQL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


@query(f"SELECT page_id, lower(regexp_extract(url, '{URL_SQL}', 1)) AS scheme, regexp_extract(url, '{URL_SQL}', 2) AS domain, nullif(regexp_extract(url, '{URL_SQL}', 4), '') AS path, nullif(regexp_extract(url, '{URL_SQL}', 5), '') AS query, nullif(regexp_extract(url, '{URL_SQL}', 6), '') AS fragment FROM pages")
def url_extract(spark: SparkSession, d: str) -> DataFrame:
    good, _ = X.split_fit(X.url_extract_job(table(spark, d, "pages"), "url"))
    return good.select("page_id", *(F.col(f"extracted.{c}").alias(c) for c in ("scheme", "domain", "path", "query", "fragment")))


@query("SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def kv_extract(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").select("event_id", F.concat(F.lit("kind="), "event_type", F.lit(' who="'), "user_id", F.lit('"')).alias("raw"))
    return X.kv_extract_job(raw, "raw").select("event_id", F.col("extracted")["kind"].alias("kind"), F.col("extracted")["who"].alias("who"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return X.json_extract_job(table(spark, d, "events"), "props", "k bigint").select("event_id", "extracted.k")


@query("SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def csv_extract(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").select("c_custkey", F.concat_ws(",", "c_name", F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))).alias("raw"))
    return X.csv_extract_job(raw, "raw", ["name", "segment"]).select("c_custkey", "extracted.name", "extracted.segment")


@query("SELECT 'p_size' AS \"column\", count(*) AS n, count(*) FILTER (p_size BETWEEN -128 AND 127) AS byte, count(*) AS long, count(*) AS alphanumeric FROM part UNION ALL SELECT 'p_brand', count(*), 0, 0, 0 FROM part")
def type_profile(spark: SparkSession, d: str) -> DataFrame:
    return X.type_profile_job(table(spark, d, "part"), ["p_size", "p_brand"]).select("column", "n", "byte", "long", "alphanumeric")


# scoring and retrieval -------------------------------------------------------------------------
PATTERN_SQL = """
  CASE WHEN regexp_matches(t, '(failed|invalid|authentication failure).*(ssh|login)') THEN {'r': 75, 'i': 0, 'n': 'SSH Brute Force'} END,
  CASE WHEN regexp_matches(t, 'union.*select|drop.*table|\'\';.*--|exec.*xp_') THEN {'r': 90, 'i': -1, 'n': 'SQL Injection'} END,
  CASE WHEN regexp_matches(t, 'powershell.*-enc|base64|encoded|obfuscat') THEN {'r': 85, 'i': -2, 'n': 'PowerShell Obfuscation'} END,
  CASE WHEN regexp_matches(t, 'port.*scan|connection.*refused|multiple.*ports') THEN {'r': 60, 'i': -3, 'n': 'Port Scanning'} END,
  CASE WHEN regexp_matches(t, 'sudo|su -|privilege|escalation|root.*access') THEN {'r': 80, 'i': -4, 'n': 'Privilege Escalation'} END,
  CASE WHEN regexp_matches(t, 'file.*modified|integrity.*violation|checksum.*mismatch') THEN {'r': 85, 'i': -5, 'n': 'File Integrity Violation'} END,
  CASE WHEN regexp_matches(t, 'malware|virus|trojan|backdoor|rootkit') THEN {'r': 95, 'i': -6, 'n': 'Malware Execution'} END,
  CASE WHEN regexp_matches(t, 'lateral.*movement|psexec|wmic|remote.*execution') THEN {'r': 80, 'i': -7, 'n': 'Lateral Movement'} END,
  CASE WHEN regexp_matches(t, 'exfiltrat|data.*export|large.*transfer|unauthorized.*access') THEN {'r': 90, 'i': -8, 'n': 'Data Exfiltration'} END,
  CASE WHEN regexp_matches(t, ';.*rm|;.*cat|;.*wget|command.*injection') THEN {'r': 85, 'i': -9, 'n': 'Command Injection'} END"""
PATTERNS_SQL = f"h AS (SELECT doc_id, list_filter([{PATTERN_SQL}], lambda x: x IS NOT NULL) AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents)), b AS (SELECT doc_id, coalesce(list_aggregate(hits, 'max').r, 0) AS risk_score, coalesce(list_aggregate(hits, 'max').n, 'No known pattern') AS pattern, len(hits) AS n FROM h)"


@query(f"WITH {PATTERNS_SQL} SELECT doc_id, pattern, risk_score, n::INT AS n_patterns FROM b")
def attack_patterns(spark: SparkSession, d: str) -> DataFrame:
    found = R.with_attack_patterns(table(spark, d, "documents").select("doc_id", "text"), "text", "p")
    return found.select("doc_id", "p.pattern", "p.risk_score", F.size("p.all_patterns").alias("n_patterns"))


@query(f"WITH {PATTERNS_SQL} SELECT doc_id, greatest(doc_id % 101, risk_score)::BIGINT AS final_score, (doc_id % 97 > 62 OR n > 0 OR greatest(doc_id % 101, risk_score) >= 62) AS is_anomaly, CASE WHEN greatest(doc_id % 101, risk_score) >= 90 THEN 'CRITICAL' WHEN greatest(doc_id % 101, risk_score) >= 75 THEN 'HIGH' WHEN greatest(doc_id % 101, risk_score) >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM b")
def threat_assessment(spark: SparkSession, d: str) -> DataFrame:
    found = R.with_attack_patterns(table(spark, d, "documents").select("doc_id", "text"), "text", "p")
    out = R.threat_assessment(F.col("doc_id") % 97, F.col("doc_id") % 101, F.col("p.risk_score"), F.col("p.suspicious"))
    return found.select("doc_id", out.alias("a")).select("doc_id", "a.final_score", "a.is_anomaly", "a.threat_level")


@query("""WITH s AS (SELECT doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'que') AS INT) + 2 *
CAST(contains(lower(source), 'the') AS INT) + 2 * CAST(contains(lower(source), 'que') AS INT) AS score, n_chars FROM documents) SELECT doc_id, score
FROM s WHERE score > 0 ORDER BY score DESC, n_chars DESC, doc_id LIMIT 25""")
def keyword_search(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_alert_search(table(spark, d, "documents"), ["the", "que"], F.col("text"), F.col("source"), "n_chars", 25, "doc_id").select("doc_id", "score")


# every row whose id is divisible by 20 asks
VECTOR_SQL = """u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE
* y::DOUBLE)))) AS v FROM embeddings), vs AS (SELECT q.id AS query, u.id, list_dot_product(u.v, q.v) AS similarity FROM u, u q WHERE q.id % 20 = 0)"""
BM25_SQL = """w AS (SELECT doc_id AS doc, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents), t AS
(SELECT count(*) AS n, avg(len(w)) AS a FROM w), bq AS (SELECT DISTINCT doc AS query, unnest(w) AS term FROM w WHERE doc % 20 = 0),
p AS (SELECT term, doc, l, count(*) AS tf FROM (SELECT doc, len(w) AS l, unnest(w) AS term FROM w) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS
df FROM p GROUP BY 1),
r AS (SELECT query, doc, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))) AS raw FROM p JOIN df USING (term)
JOIN bq USING (term), t GROUP BY 1, 2), s AS (SELECT query, doc, raw / max(raw) OVER (PARTITION BY query) AS score FROM r)"""


def asking_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def asking_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "text")


@query(f"WITH {VECTOR_SQL}, k AS (SELECT query, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 9) DESC, id)::INT AS rank FROM vs) SELECT * FROM k WHERE rank <= 10")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.vector_topk(table(spark, d, "embeddings"), asking_vectors(spark, d), 10).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {BM25_SQL}, k AS (SELECT query, doc, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc)::INT AS rank FROM s) SELECT * FROM k WHERE rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25_topk(table(spark, d, "documents"), asking_texts(spark, d), 10, "doc_id", "text").select("query", F.col("id").alias("doc"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {VECTOR_SQL}, {BM25_SQL}, sem AS (SELECT query, id AS doc, similarity AS x FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER
BY round(similarity, 9) DESC, id) AS r FROM vs) WHERE r <= 30), h AS (SELECT coalesce(sem.query, s.query) AS query, coalesce(sem.doc, s.doc) AS doc,
0.6 * coalesce(x, 0) + 0.3 * coalesce(score, 0) AS part FROM sem FULL JOIN s ON sem.query = s.query AND sem.doc = s.doc),
z AS (SELECT query, doc, round(part + 0.1 * exp(-(doc % 500) / 168.0), 6) AS score FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY query
ORDER BY score DESC, doc)::INT AS rank FROM z) SELECT query, doc, score, rank FROM k WHERE rank <= 10""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    semantic = S.vector_topk(table(spark, d, "embeddings"), asking_vectors(spark, d), 30)
    out = S.hybrid_topk(semantic, table(spark, d, "documents"), asking_texts(spark, d), F.exp(-(F.col("id") % 500) / 168.0), 10, "doc_id", "text")
    return out.select("query", F.col("id").alias("doc"), F.round("score", 6).alias("score"), "rank")


@query("""WITH r AS (SELECT l_orderkey, ['all', 'any', 'none'][l_orderkey % 3 + 1] AS condition, CASE l_returnflag WHEN 'A' THEN 'Found' WHEN 'N' THEN
'NotFound' ELSE 'Invalid' END AS result FROM lineitem), g AS (SELECT l_orderkey, condition, bool_or(result = 'Found') AS f, bool_or(result =
'NotFound') AS m, bool_or(result = 'Invalid') AS i FROM r GROUP BY 1, 2)
SELECT l_orderkey AS check_id, condition, CASE condition WHEN 'all' THEN CASE WHEN m THEN 'Failed' WHEN i THEN 'Not applicable' ELSE 'Passed' END WHEN
'any' THEN CASE WHEN f THEN 'Passed' WHEN i THEN 'Not applicable' ELSE 'Failed' END ELSE CASE WHEN f THEN 'Failed' WHEN i THEN 'Not applicable' ELSE
'Passed' END END AS status FROM g""")
def check_conditions(spark: SparkSession, d: str) -> DataFrame:
    condition = F.element_at(F.array(*map(F.lit, ("all", "any", "none"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    result = F.when(F.col("l_returnflag") == "A", "Found").when(F.col("l_returnflag") == "N", "NotFound").otherwise("Invalid")
    return A.check_conditions(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("check_id"), condition.alias("condition"), result.alias("result")))


@query("""SELECT l_orderkey AS check_id, string_agg('line ' || l_linenumber, chr(10) ORDER BY l_linenumber) AS reasons FROM lineitem WHERE
l_returnflag = 'R' GROUP BY 1""")
def invalid_reasons(spark: SparkSession, d: str) -> DataFrame:
    result = F.when(F.col("l_returnflag") == "R", "Invalid").otherwise("Found")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("check_id"), result.alias("result"), F.col("l_linenumber").alias("rule_no"), F.concat(F.lit("line "), "l_linenumber").alias("reason"))
    return A.invalid_reasons(rows)


def forest_raw(spark: SparkSession, d: str) -> DataFrame:
    """id, is_attack, raw of every alert by a forest fitted on the clean ones. The features are written once, as their moments, the fit and the scores read them."""
    rows = alerts(spark, d).withColumns({"agent_ip": F.lit("10.0.0.1"), "message": F.col("full_log")})
    feats = stored(R.event_features(rows).select("id", "is_attack", "features"), "forest-features")
    scaled = R.standardise(feats.filter(~F.col("is_attack")), feats)
    nodes = R.isolation_forest_fit(scaled.filter(~F.col("is_attack")))
    return stored(R.isolation_forest_score(scaled, nodes).select("id", "is_attack", "raw"), "forest-raw")


def calibrated(raw: DataFrame) -> DataFrame:
    low_high = A.calibration_percentiles(raw.filter(~F.col("is_attack")))
    return raw.crossJoin(F.broadcast(low_high)).select("id", "is_attack", R.score_normalise(F.col("raw"), F.col("score_min"), F.col("score_max")).alias("score"))


@query()
def anomaly_scores(spark: SparkSession, d: str) -> DataFrame:
    """Isolation forest over the alert features: fitted on clean alerts, calibrated, scored 0 to 100."""
    return calibrated(forest_raw(spark, d))


@query("""WITH {alerts} SELECT id, CASE WHEN hour(ts) BETWEEN 2 AND 6 THEN 30 WHEN hour(ts) >= 22 OR hour(ts) <= 2 THEN 20 WHEN hour(ts) BETWEEN 8 AND
18 THEN 5 ELSE 0 END AS time_score, least(100, trunc(score * 0.5 + (CASE WHEN hour(ts) BETWEEN 2 AND 6 THEN 30 WHEN hour(ts) >= 22 OR hour(ts) <= 2
THEN 20 WHEN hour(ts) BETWEEN 8 AND 18 THEN 5 ELSE 0 END) * 0.2 + least(level * 10, 50) * 0.2 + 0.5))::INT AS combined_score FROM alerts""")
def multi_dimensional_scores(spark: SparkSession, d: str) -> DataFrame:
    s = R.multi_dimensional_score(F.col("score"), F.hour("ts"), F.col("level"), F.lit(2))
    return alerts(spark, d).select("id", s.alias("s")).select("id", "s.time_score", "s.combined_score")


# bookmarks -------------------------------------------------------------------------------------
@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) SELECT o_custkey, o_orderkey FROM
r WHERE r <= 3""")
def retain_last_n(spark: SparkSession, d: str) -> DataFrame:
    return INC.retain_last_n(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 3)


@query("""WITH o AS (SELECT o_orderkey AS name, o_orderdate AS created FROM orders), p AS (SELECT * FROM o WHERE created < TIMESTAMP '1997-06-01' AND
name % 3 <> 0), t AS (SELECT max(created) AS top FROM p) SELECT name FROM o, t WHERE created >= top AND NOT EXISTS (SELECT 1 FROM p WHERE p.name =
o.name)""")
def high_water_mark(spark: SparkSession, d: str) -> DataFrame:
    objects = table(spark, d, "orders").select(F.col("o_orderkey").alias("name"), F.col("o_orderdate").alias("created"))
    processed = objects.filter((F.col("created") < F.lit("1997-06-01").cast("timestamp_ntz")) & (F.col("name") % 3 != 0))
    return INC.high_water_mark_filter(objects, processed).select("name")


@query("SELECT o_orderpriority AS prefix, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def last_key(spark: SparkSession, d: str) -> DataFrame:
    return INC.last_key(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "prefix"), ["prefix"], "o_orderkey")


# the other sets register themselves
from . import queries_detection, queries_functions, queries_operators, queries_sources, queries_streams  # noqa: E402, F401
