"""Registered queries of stateful streams, run to their end over a landed table, and of sources that read landed files in their own format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import enrich as J
from .plans.alerts import table
from .queries import pending_operation
from .registry import query
from .sources import cloud as C
from .sources import sinks as K
from .sources import text as S
from .sources.history import History
from .sources.landing import landed, new_folder
from .streaming import streams
from .streaming.state_table import StateTable


def ran(spark: SparkSession, rows: DataFrame, build, mode: str, last: DataFrame | None = None) -> DataFrame:
    """The output of a stream over rows as one batch, and after it, if given, over the rows of last, which move the watermark past all others."""
    base, key = new_folder(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(key, "").endswith("RocksDBStateStoreProvider"):  # state of keys and timers needs it
        spark.conf.set(key, streams.ROCKS)
    rows.write.parquet(f"{base}/in")
    n = max(1, len(spark.read.schema(rows.schema).parquet(f"{base}/in").inputFiles()))
    if last is not None:
        last.select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{base}/in")
    out = build(streams.incremental_files(spark, f"{base}/in", rows.schema, "parquet", per_trigger=n))
    # a batch that is repeated after a failure overwrites its own folder; in complete mode the last one holds all
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{base}/out/{'all' if mode == 'complete' else f'batch={batch}'}")
    run = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).option("recursiveFileLookup", True).parquet(f"{base}/out")


def timed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def after_all(rows: DataFrame) -> DataFrame:
    """One row a year after the last."""
    top = rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(1)
    return top.withColumn("ts", F.col("ts") + F.expr("interval 365 days"))


def second(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS events, count(*) FILTER (event_type = 'error') AS alerts
FROM events GROUP BY 1""")
def hourly_totals_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = timed(spark, d).select("ts", "event_type")
    out = ran(spark, rows, lambda s: streams.hourly_totals_stream(s, F.col("event_type") == "error"), "complete")
    return out.select(second("hour").alias("hour"), "events", "alerts")


# a session ends where five minutes pass without an event: an event just five minutes later begins the next
@query("""WITH p AS (SELECT user_id % 40 AS u, ts, event_type, ts - lag(ts) OVER (PARTITION BY user_id % 40 ORDER BY ts) >= INTERVAL 5 MINUTE AS new
FROM events),
s AS (SELECT *, sum(coalesce(new, true)::INT) OVER (PARTITION BY u ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM p)
SELECT u, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS attempts, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER
(event_type = 'error') > 5 AS brute_force FROM s GROUP BY u, n""")
def auth_episode_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = timed(spark, d).select((F.col("user_id") % 40).alias("u"), "ts", "event_type")
    out = ran(spark, rows, lambda s: streams.auth_episode_stream(s, "u", F.col("event_type") == "error"), "complete")
    return out.select("u", second("start").alias("start"), "attempts", "failed", "brute_force")


@query("""WITH p AS (SELECT DISTINCT user_id % 3 AS u, date_trunc('minute', ts) AS m, event_id % 50 AS port FROM events), w AS (SELECT u, m -
to_minutes(k) AS start, port FROM p, range(0, 10) AS t(k))
SELECT u, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(DISTINCT port) AS ports FROM w GROUP BY 1, start HAVING count(DISTINCT port) > 2""")
def port_scan_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = timed(spark, d).select((F.col("user_id") % 3).alias("u"), "ts", (F.col("event_id") % 50).alias("port"), "event_id")
    out = ran(spark, rows, lambda s: streams.port_scan_stream(s, "u", "port", 2), "append", after_all(rows))
    return out.select("u", second("start").alias("start"), "ports")


@query("""WITH p AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'CREATE' WHEN 'error' THEN 'DELETE' ELSE 'MODIFY' END AS op FROM events),
s AS (SELECT *, op <> 'CREATE' AND coalesce(lag(op) OVER (PARTITION BY user_id ORDER BY event_id), 'DELETE') = 'DELETE' AS shows FROM p),
g AS (SELECT user_id AS id, bool_or(shows) AS existing, arg_max(op, event_id) AS l FROM s GROUP BY 1)
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN existing THEN l WHEN l = 'DELETE' THEN 'NONE' ELSE 'CREATE' END AS operation, existing FROM g""")
def pending_changes_stream(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), pending_operation().alias("operation"), F.col("props").alias("data"))
    return ran(spark, rows, streams.stream_coalesce_changes, "update").select("id", "operation", "existing")


@query("""WITH m AS (SELECT CAST(event_id % 25 AS VARCHAR) AS session, event_id // 25 AS seq FROM events WHERE event_id % 7 <> 3), z AS (SELECT
CAST(event_id % 25 AS VARCHAR) AS session, max(event_id // 25) + 1 AS size FROM events GROUP BY 1),
e AS (SELECT session, seq, coalesce(lag(seq) OVER (PARTITION BY session ORDER BY seq), -1) AS before FROM m UNION ALL SELECT z.session, size,
coalesce(max(seq), -1) FROM z LEFT JOIN m ON z.session = m.session GROUP BY 1, 2)
SELECT session, count(*) FILTER (seq - before > 1) = 0 AS complete, coalesce(string_agg((before + 1) || '-' || (seq - 1), ',' ORDER BY seq) FILTER
(seq - before > 1), '') AS missing FROM e GROUP BY 1""")
def sequence_gaps_stream(spark: SparkSession, d: str) -> DataFrame:
    session, seq = (F.col("event_id") % 25).cast("string"), F.floor(F.col("event_id") / 25)
    every = table(spark, d, "events").select("event_id", session.alias("session"), seq.alias("seq"))
    sizes = every.groupBy("session").agg((F.max("seq") + 1).alias("size"))
    rows = every.filter("event_id % 7 <> 3").join(sizes, "session").select("session", "seq", "size")
    return ran(spark, rows, streams.stream_sequence_gaps, "update")


@query("""WITH k AS (SELECT CAST(user_id % 30 AS VARCHAR) AS agent_id, max(epoch_us(ts)) // 1000 AS ms FROM events GROUP BY 1)
SELECT agent_id, 'active' AS status, ms AS at_ms FROM k UNION ALL SELECT agent_id, 'disconnected', ms + 600000 FROM k UNION ALL SELECT agent_id,
'alert', ms + 900000 FROM k""")
def keepalive_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each agent falls silent after its last event; a row a year later lets its timers end."""
    rows = timed(spark, d).select((F.col("user_id") % 30).cast("string").alias("agent_id"), "ts", "event_id")
    out = ran(spark, rows, lambda s: streams.keepalive_timeout(s.drop("event_id"), 600, 300), "append", after_all(rows).withColumn("agent_id", F.lit("later")))
    return out.filter("agent_id <> 'later'")


# files in their own format ----------------------------------------------------------------------
@query("SELECT event_id, event_type || ' ü' AS event_type FROM events")
def utf16_records(spark: SparkSession, d: str) -> DataFrame:
    path = new_folder(spark, "utf16")
    table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(" ü")).alias("event_type")).write.option("encoding", "UTF-16LE").json(path)
    return S.utf16_source(spark, path).select(F.from_json("line", "event_id bigint, event_type string").alias("e")).select("e.*")


@query("""SELECT 'json' AS kind, event_id, event_type FROM events UNION ALL SELECT 'csv', event_id, event_type FROM events WHERE event_id % 2 = 0
UNION ALL SELECT 'plain', event_id, event_type FROM events WHERE event_id % 3 = 0""")
def auto_records(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines, CSV and plain lines in one folder; each file says by its first line what it is."""
    path, e = new_folder(spark, "auto"), table(spark, d, "events").select("event_id", "event_type")
    e.write.json(f"{path}/a")
    e.filter("event_id % 2 = 0").write.option("header", True).csv(f"{path}/b")
    e.filter("event_id % 3 = 0").select(F.concat_ws(" ", "event_id", "event_type").alias("value")).write.text(f"{path}/c")
    rows = C.auto_format_source(spark, path)
    parsed = F.from_json("record", "event_id string, event_type string")  # cells of CSV are texts
    plain = F.struct(F.split_part("record", F.lit(" "), F.lit(1)).alias("event_id"), F.split_part("record", F.lit(" "), F.lit(2)).alias("event_type"))
    return rows.select("kind", F.when(F.col("kind") == "plain", plain).otherwise(parsed).alias("e")).select("kind", F.col("e.event_id").cast("bigint").alias("event_id"), "e.event_type")


FIREWALL = "timestamp bigint, action string, httpRequest struct<clientIp:string,headers:array<struct<name:string,value:string>>>"


@query("""SELECT event_id AS timestamp, event_type AS action, '10.0.0.' || user_id % 250 AS ip, 'h' || user_id AS host FROM events WHERE event_id % 5 > 0""")
def firewall_records(spark: SparkSession, d: str) -> DataFrame:
    """Two objects share a line; headers out of the list go, and every fifth object has no request."""
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.array(header("Host", F.concat(F.lit("h"), "user_id")), header("X-Secret", F.lit("s")))
    request = F.when(F.col("event_id") % 5 > 0, F.struct(F.concat(F.lit("10.0.0."), F.col("user_id") % 250).alias("clientIp"), headers.alias("headers")))
    e = table(spark, d, "events").select((F.floor(F.col("event_id") / 2)).alias("pair"), F.to_json(F.struct(F.col("event_id").alias("timestamp"), F.col("event_type").alias("action"), request.alias("httpRequest"))).alias("x"))
    lines = e.groupBy("pair").agg(F.array_join(F.collect_list("x"), "").alias("x"))
    out = C.firewall_json_source(spark, landed(lines, F.col("x"), "firewall"), FIREWALL)
    return out.select("timestamp", "action", F.col("httpRequest.clientIp").alias("ip"), F.element_at("headers", "host").alias("host"))


@query("""SELECT 'dnslogs' AS kind, 't' || event_id AS timestamp, event_type AS what FROM events WHERE event_id % 3 = 0 UNION ALL SELECT 'proxylogs',
't' || event_id, event_type FROM events WHERE event_id % 3 = 1
UNION ALL SELECT 'iplogs', 't' || event_id, event_type FROM events WHERE event_id % 3 = 2""")
def dns_security_records(spark: SparkSession, d: str) -> DataFrame:
    path, e = new_folder(spark, "dns"), table(spark, d, "events")
    for k, (kind, width, at) in enumerate((("dnslogs", 13, 7), ("proxylogs", 23, 6), ("iplogs", 7, 5))):
        cells = [F.col("event_type") if i == at else F.concat(F.lit("t"), "event_id") if i == 0 else F.lit(f"c{i}") for i in range(width)]
        e.filter(F.col("event_id") % 3 == k).select(*(c.alias(f"c{i}") for i, c in enumerate(cells))).write.option("quoteAll", True).csv(f"{path}/{kind}")
    what = F.when(F.col("kind") == "dnslogs", F.col("response_code")).when(F.col("kind") == "proxylogs", F.col("verdict")).otherwise(F.col("destination_port"))
    return C.dns_security_log_source(spark, path).select("kind", "timestamp", what.alias("what"))


@query("""SELECT CAST(event_id AS VARCHAR) AS resource_id, CASE event_id % 3 WHEN 0 THEN 'a' || user_id WHEN 1 THEN 'x,' || event_type ELSE event_type
END AS groups FROM events""")
def config_records(spark: SparkSession, d: str) -> DataFrame:
    """A field that is a text, a list or an object comes as a list."""
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = F.when(F.col("event_id") % 3 == 0, q(F.concat(F.lit("a"), "user_id"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('["x",'), q(F.col("event_type")), F.lit("]")))
    value = value.otherwise(F.concat(F.lit('{"id":'), q(F.col("event_type")), F.lit("}")))
    line = F.concat(F.lit('{"resourceId":"'), "event_id", F.lit('","configuration":{"groups":'), value, F.lit("}}"))
    out = C.config_history_source(spark, landed(table(spark, d, "events"), line, "config"), {"groups": "id"})
    return out.select("resource_id", F.array_join("groups", ",").alias("groups"))


@query("""SELECT event_type AS name, CAST(user_id AS VARCHAR) AS region, CASE WHEN event_id % 2 = 0 THEN '{"string":"text ' || event_id || '"}' ELSE
'{"k":' || event_id || '}' END AS parameters FROM events""")
def audit_trail_records(spark: SparkSession, d: str) -> DataFrame:
    """Files of a Records array; plain text parameters are wrapped."""
    parameters = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"text '), "event_id", F.lit('"'))).otherwise(F.concat(F.lit('{"k":'), "event_id", F.lit("}")))
    record = F.concat(F.lit('{"eventName":"'), "event_type", F.lit('","awsRegion":"'), "user_id", F.lit('","requestParameters":'), parameters, F.lit("}"))
    rows = table(spark, d, "events").select((F.col("event_id") % 8).alias("file"), record.alias("r"))
    path = new_folder(spark, "trail")
    files = rows.groupBy("file").agg(F.concat(F.lit('{"Records":['), F.array_join(F.collect_list("r"), ","), F.lit("]}")).alias("value"))
    files.repartition(8, "file").write.partitionBy("file").text(path)
    out = C.audit_trail_source(spark, path)
    return out.select(F.col("eventName").alias("name"), F.col("awsRegion").alias("region"), F.col("requestParameters").alias("parameters"))


@query("""SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-15' UNION ALL SELECT -event_id FROM events WHERE event_type = 'view' AND event_id
>= 100 AND event_id < 5000 AND props NOT LIKE '%7%'""")
def range_and_scan_records(spark: SparkSession, d: str) -> DataFrame:
    """Findings since the last scan, and (with negative ids) the events of one stream in a range without those that a pattern discards."""
    e = table(spark, d, "events")
    found = C.scan_findings_source(e.withColumn("createdAt", F.col("ts").cast("timestamp")), "2024-01-15").select("event_id")
    logs = e.select(F.col("event_type").alias("stream"), F.col("event_id").alias("ts_ms"), F.col("props").alias("message"))
    return found.unionByName(C.log_stream_range_source(logs, "view", 100, 5000, "7").select((-F.col("ts_ms")).alias("event_id")))


@query("""SELECT 'ATTACK-' || p_partkey AS episode_id, p_name || ': ' || p_type AS summary, p_brand AS tags, CAST(p_partkey AS VARCHAR) AS entity FROM
part UNION ALL SELECT 'YARA-' || p_partkey, p_partkey || ': ' || p_type, p_brand, p_name FROM part
UNION ALL SELECT 'ADV-' || p_partkey, p_name, lower(p_brand), p_type FROM part""")
def knowledge_bases(spark: SparkSession, d: str) -> DataFrame:
    """Techniques, string rules and advisories as episodes."""
    p, one = table(spark, d, "part"), lambda c: F.array(c)
    key = F.col("p_partkey").cast("string")
    shapes = {
        C.attack_kb_source: ("technique", F.struct(key.alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), one("p_brand").alias("tactics"))),
        C.yara_kb_source: ("string", F.struct(key.alias("name"), F.col("p_type").alias("description"), one("p_brand").alias("tags"), one("p_name").alias("strings"))),
        C.advisory_kb_source: ("cve", F.struct(key.alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("severity"), one("p_type").alias("cves"))),
    }
    out = None
    for source, (entity, row) in shapes.items():
        path = new_folder(spark, "kb")
        # a file is an array of entries
        files = p.select(F.col("p_partkey") % 8, row.alias("r")).toDF("file", "r").groupBy("file").agg(F.to_json(F.collect_list("r")).alias("value"))
        files.repartition(8, "file").write.partitionBy("file").text(path)
        each = source(spark, path).select("episode_id", "summary", F.array_join("tags", ",").alias("tags"), F.array_join(F.element_at("entities", entity), ",").alias("entity"))
        out = each if out is None else out.unionByName(each)
    return out


@query("SELECT p_partkey::INT AS id, p_size AS level, p_brand AS groups, CAST(p_size AS VARCHAR) AS pci_dss, 0 AS n_gdpr FROM part")
def rule_catalog(spark: SparkSession, d: str) -> DataFrame:
    groups = F.array("p_brand", F.concat(F.lit("pci_dss_"), "p_size"))
    rows = table(spark, d, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_size").alias("level"), groups.alias("groups"))).alias("value"))
    out = C.rule_catalog_source(spark, landed(rows, F.col("value"), "rules"))
    return out.select("id", "level", F.array_join("groups", ",").alias("groups"), F.array_join("pci_dss", ",").alias("pci_dss"), F.size("gdpr").alias("n_gdpr"))


@query("SELECT 'p' || event_id % 4 AS program, CAST(event_id AS VARCHAR) AS stamp, event_type || ' ' || props AS message FROM events")
def multilog_records(spark: SparkSession, d: str) -> DataFrame:
    """One folder a program, whose file is named current."""
    path, e = new_folder(spark, "multilog"), table(spark, d, "events")
    for k in range(4):
        lines = e.filter(F.col("event_id") % 4 == k).select(F.concat(F.lit("@"), "event_id", F.lit(" "), "event_type", F.lit(" "), "props").alias("value"))
        lines.unionByName(spark.range(1).select(F.lit("no stamp").alias("value"))).write.text(f"{path}/p{k}")
    return S.multilog_source(spark, f"{path}/*/part-*")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-19' GROUP BY 1")
def retained_days(spark: SparkSession, d: str) -> DataFrame:
    """Days that are left after those older than ten days before the end of the month are deleted."""
    path = new_folder(spark, "retention")
    table(spark, d, "events").select("event_id", F.to_date("ts").cast("string").alias("day")).write.partitionBy("day").parquet(path)
    K.retention_delete(spark, path, "2024-01-30", 10)
    return spark.read.schema("event_id bigint, day date").parquet(path).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, c_name AS own_name, n_name AS nation, 'kept' AS own_only, CAST(n_regionkey AS VARCHAR) AS region FROM customer JOIN nation
ON c_nationkey = n_nationkey""")
def deep_merge_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Maps of maps from a key-value table are merged into a row's own, level by level."""
    inner = lambda **kv: F.create_map(*(F.lit(x) if k % 2 == 0 else x for pair in kv.items() for k, x in enumerate(pair)))
    kv = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.create_map(F.lit("a"), inner(nation=F.col("n_name"), region=F.col("n_regionkey").cast("string"))).alias("value"))
    rows = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.create_map(F.lit("a"), inner(name=F.col("c_name"), nation=F.lit("old")), F.lit("b"), inner(only=F.lit("kept"))).alias("target"))
    out = J.lookup_merge(rows, kv, "c_nationkey", "target", recursive=True)
    a, b = F.element_at("target", "a"), F.element_at("target", "b")
    return out.select("c_custkey", a["name"].alias("own_name"), a["nation"].alias("nation"), b["only"].alias("own_only"), a["region"].alias("region"))


@query("""WITH c AS (SELECT user_id AS key, max(event_id) AS o, arg_max(event_type, event_id) AS t, arg_max(props, event_id) AS p FROM events GROUP BY 1)
SELECT key, o AS offset_, p AS payload FROM c WHERE t <> 'error'""")
def feed_state_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a feed in several batches into a bucketed state table; an error deletes its user until something follows."""
    base = new_folder(spark, "feed")
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("offset_"), F.col("props").alias("payload"), "event_type")
    e.repartition(3).write.parquet(f"{base}/in")
    schema = "key bigint, offset_ bigint, payload string"
    state = StateTable(spark, f"{base}/state", ["key"], "offset_", schema, buckets=16)
    state.follow(streams.incremental_files(spark, f"{base}/in", e.schema, "parquet", per_trigger=1), f"{base}/checkpoint", "event_type = 'error'").awaitTermination()
    return state.read()


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 = 0 AND o_custkey % 2 = 0 AND o_orderkey % 4 <> 1 UNION ALL SELECT o_orderkey,
o_custkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_custkey % 2 = 1 AND o_orderkey % 4 <> 1""")
def unseen_items(spark: SparkSession, d: str) -> DataFrame:
    """Orders against a history of two runs, kept with Bloom filters."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    seen = History(spark, new_folder(spark, "history"), ["o_orderkey"], buckets=32)
    seen.extend(rows.filter("o_orderkey % 4 = 1"), "first")
    seen.extend(rows.filter("o_orderkey % 5 = 0 and o_custkey % 2 = 1 or o_orderkey % 5 <> 0 and o_custkey % 2 = 0"), "second")
    return seen.unseen(rows)
