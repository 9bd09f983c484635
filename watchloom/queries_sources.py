"""Registered queries of the sources and sinks: rows of a table are landed in the source's own format, read back and checked against the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.alerts import table
from .registry import query
from .sources import cloud as C
from .sources import sinks as K
from .sources import text as S
from .sources.landing import landed, new_folder
from .streaming import streams


def part(c: str, pattern: str, k: int = 1) -> Column:
    return F.regexp_extract(c, pattern, k)


# lines -----------------------------------------------------------------------------------------
@query("""SELECT 'lines' AS source, event_id, event_type FROM events WHERE event_id % 10 > 0 UNION ALL SELECT 'log', event_id, event_type FROM events
WHERE event_id % 10 > 0
UNION ALL SELECT 'history', event_id, event_type FROM events WHERE event_id % 10 > 0""")
def json_sources(spark: SparkSession, d: str) -> DataFrame:
    """json_lines_source, json_log_source and alert_history_source; every tenth line is broken."""
    line = F.when(F.col("event_id") % 10 > 0, F.to_json(F.struct("event_id", "event_type"))).otherwise('{"event_id": broken')
    path, schema = landed(table(spark, d, "events"), line, "json"), "event_id bigint, event_type string"
    logs = S.json_log_source(spark, path, schema, origin="landing").select(F.lit("log").alias("source"), "event.event_id", "event.event_type", "labels")
    logs = logs.filter("event_id is not null and labels['origin'] = 'landing'").drop("labels")
    history = S.alert_history_source(spark, path, schema, "part-*").filter("file is not null").select(F.lit("history").alias("source"), "event_id", "event_type")
    return S.json_lines_source(spark, path, schema).select(F.lit("lines").alias("source"), "event_id", "event_type").unionByName(logs).unionByName(history)


@query("""SELECT page_id, 'url ' || url AS line FROM pages""")
def plain_lines(spark: SparkSession, d: str) -> DataFrame:
    path = landed(table(spark, d, "pages"), F.concat_ws("\t", "page_id", F.concat(F.lit("url "), "url")), "plain")
    return S.plain_line_source(spark, path).select(F.split_part("line", F.lit("\t"), F.lit(1)).cast("bigint").alias("page_id"), F.split_part("line", F.lit("\t"), F.lit(2)).alias("line"))


@query("""WITH o AS (SELECT o_orderkey AS k, 'status ' || o_orderstatus AS s, 'priority ' || o_orderpriority AS p FROM orders)
SELECT k, 'fixed' AS how, 'id ' || k || ' ' || s || ' ' || p AS event FROM o UNION ALL SELECT k, 'strict', 'id ' || k || chr(10) || s || chr(10) || p FROM o
UNION ALL SELECT k, 'start', 'id ' || k || chr(10) || s || chr(10) || p FROM o UNION ALL SELECT k, 'end', 'id ' || k || chr(9) || s || chr(9) || p
FROM o UNION ALL SELECT k, 'all', 'id ' || k || s || p FROM o""")
def multiline_sources(spark: SparkSession, d: str) -> DataFrame:
    """Records of three lines, joined by number, by their first line, by their last and by a pattern of the whole, with each way of joining."""
    text = F.concat(F.lit("id "), "o_orderkey", F.lit("\nstatus "), "o_orderstatus", F.lit("\npriority "), "o_orderpriority")
    lines = S.numbered_lines(spark, landed(table(spark, d, "orders"), text, "multiline"))
    ways = {
        "fixed": S.fixed_multiline_source(lines, 3),
        "strict": S.strict_chunk_source(lines, 3),
        "start": S.regex_start_source(lines, r"^id \d+$"),
        "end": S.regex_end_source(lines, "^priority", "tab"),
        "all": S.regex_all_source(lines, r"(?s)id \d+.*priority \d", join="none"),
    }
    parts = [df.select(part("event", r"^id (\d+)").cast("bigint").alias("k"), F.lit(how).alias("how"), "event") for how, df in ways.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("k", F.when(F.col("how") == "all", F.regexp_extract("event", r"^id (\d+)status", 1).cast("bigint")).otherwise(F.col("k")))


@query("""SELECT event_id AS rule, user_id % 16 AS level, event_type AS description, 'agent' || user_id % 10 AS hostname, 'u' || user_id AS "user",
'line ' || event_id AS message, epoch(date_trunc('second', ts))::BIGINT AS seconds,
'level: ' || user_id % 16 || '; rule: ' || event_id || '; location: /var/log/x; user: u' || user_id || '; log: line ' || event_id AS forwarded FROM events""")
def alert_blocks(spark: SparkSession, d: str) -> DataFrame:
    """alert_block_source, alert_block_fields and forwarded_alert_source."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    u, e = F.col("user_id"), F.col("event_id")
    head = F.format_string("** Alert %d.%d: - a,b,\n2024 Jan 01 00:00:00 (agent%d) 10.0.0.1->/var/log/x\n", seconds, e, u % 10)
    block = F.concat(head, F.format_string("Rule: %d (level %d) -> '%s'\nUser: u%d\nline %d\n", e, u % 16, "event_type", u, e))
    fields = S.alert_block_fields(S.alert_block_source(S.numbered_lines(spark, landed(table(spark, d, "events"), block, "alerts"))))
    out = fields.select(F.col("rule_id").cast("bigint").alias("rule"), F.col("level").cast("bigint").alias("level"), "description", "hostname", "user", "message", F.unix_seconds("timestamp").alias("seconds"))
    line = S.forwarded_alert_source(fields).select(part("line", r"rule: (\d+);").cast("bigint").alias("rule"), F.col("line").alias("forwarded"))
    return out.join(line, "rule")


@query("""SELECT c_custkey AS k, 'audit' AS kind, 'type=A msg=audit(1.0:' || c_custkey || '): one type=B msg=audit(1.0:' || c_custkey || '): two' AS
event FROM customer
UNION ALL SELECT c_custkey, 'delimiter', 'type=A msg=audit(1.0:' || c_custkey || '): one' || chr(10) || 'type=B msg=audit(1.0:' || c_custkey ||
'): two' || chr(10) || 'other' FROM customer""")
def audit_records(spark: SparkSession, d: str) -> DataFrame:
    """audit_record_source, and delimiter_multiline_source over the same files."""
    k = F.col("c_custkey")
    text = F.concat(F.format_string("type=A msg=audit(1.0:%d): one\ntype=B msg=audit(1.0:%d): two\nother\n%%%%", k, k))
    path = landed(table(spark, d, "customer"), text, "audit")
    key = part("event", r"audit\(1\.0:(\d+)\)").cast("bigint").alias("k")
    audit = S.audit_record_source(S.numbered_lines(spark, path)).select(key, F.lit("audit").alias("kind"), "event")
    return audit.unionByName(S.delimiter_multiline_source(spark, path, "%%").select(key, F.lit("delimiter").alias("kind"), "event"))


@query("""SELECT p_partkey AS k, 'db' AS kind, p_name || ' more' AS a, p_brand AS b FROM part UNION ALL SELECT p_partkey, 'ids', p_name, p_brand FROM
part UNION ALL SELECT p_partkey, 'channel', p_name, p_brand FROM part
UNION ALL SELECT p_partkey, 'scan', (p_size)::VARCHAR, 'ssh' FROM part UNION ALL SELECT p_partkey, 'frame', p_name, '/var/a:b' FROM part UNION ALL
SELECT p_partkey, 'manager', p_name, 'error' FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'manager', p_name, 'info' FROM part WHERE
p_partkey % 2 = 1""")
def block_sources(spark: SparkSession, d: str) -> DataFrame:
    """Logs of databases, intrusion detection, event channels, scans, frames and managers."""
    rows, k = table(spark, d, "part"), F.col("p_partkey")
    land = lambda text, name: landed(rows, text, name)
    db = S.db_log_source(S.numbered_lines(spark, land(F.format_string("2024-01-01 00:00:00 UTC [%d] %s|%s|\nmore", k, "p_brand", "p_name"), "db")), "postgresql")
    ids = S.ids_block_source(S.numbered_lines(spark, land(F.format_string("[**] [%d] [**]\n%s|%s\n", k, "p_name", "p_brand"), "ids")))
    xml = F.format_string("<Event><Id>%d</Id><Name>%s</Name><Brand>%s</Brand></Event>", k, "p_name", "p_brand")
    channel = S.event_channel_source(spark, land(xml, "channel"), "Id bigint, Name string, Brand string")
    scan = S.scan_report_source(S.numbered_lines(spark, land(F.format_string("Host: h%d ()\tPorts: %d/open/tcp//ssh///, 1/closed/tcp//x///", k, "p_size"), "scan")))
    frame = S.framed_event_source(spark.read.text(land(F.format_string("1:[%d] (name) any->/var/a|:b:%s", k, "p_name"), "frame")))
    plain, as_json = F.format_string("2024/01/01 00:00:00 t%d[1]: INFO: %s", k, "p_name"), F.format_string('{"timestamp":"2024/01/01 00:00:00","tag":"t%d","level":"ERROR","description":"%s"}', k, "p_name")
    manager = S.manager_log_source(S.plain_line_source(spark, land(F.when(k % 2 == 1, plain).otherwise(as_json), "manager")))
    parts = [
        db.select(part("event", r"\[(\d+)\]").cast("bigint").alias("k"), F.lit("db").alias("kind"), F.concat(part("event", r"\|(.*)\| more$"), F.lit(" more")).alias("a"), part("event", r"\] (\S+)\|").alias("b")),
        ids.select(part("event", r"\[(\d+)\]").cast("bigint").alias("k"), F.lit("ids").alias("kind"), part("event", r"\[\*\*\] \[\d+\] \[\*\*\] (.*)\|").alias("a"), part("event", r"\|(\S+)$").alias("b")),
        channel.select(F.col("Id").alias("k"), F.lit("channel").alias("kind"), F.col("Name").alias("a"), F.col("Brand").alias("b")),
        scan.select(F.substring("host", 2, 20).cast("bigint").alias("k"), F.lit("scan").alias("kind"), F.col("port").cast("string").alias("a"), F.col("service").alias("b")),
        frame.filter("ok").select(F.col("agent_id").cast("bigint").alias("k"), F.lit("frame").alias("kind"), F.col("message").alias("a"), F.col("location").alias("b")),
        manager.select(F.substring("tag", 2, 20).cast("bigint").alias("k"), F.lit("manager").alias("kind"), F.col("description").alias("a"), F.col("level").alias("b")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""SELECT o_orderkey AS hour, '[' || o_custkey || '-3-7]' AS alerts, o_orderkey % 50 AS total, o_custkey + 0.5 AS avg FROM orders""")
def counter_files(spark: SparkSession, d: str) -> DataFrame:
    """hourly_totals_source and kv_state_source."""
    o, k, c = table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    totals = S.hourly_totals_source(S.numbered_lines(spark, landed(o, F.format_string("1-%d-3-7\n%d--%d--0--0--0", c, k, k % 50), "totals")))
    state = S.kv_state_source(S.numbered_lines(spark, landed(o, F.format_string("n%d='0'\nn%d='%d.5'", k, k, c), "state")))
    values = state.select(F.explode("state").alias("name", "avg")).select(F.substring("name", 2, 20).cast("bigint").alias("hour"), "avg")
    shown = F.concat(F.lit("["), F.array_join(F.transform("alerts", lambda a: F.concat_ws("-", a["sigid"], a["level"], a["times"])), ","), F.lit("]"))
    return totals.select("hour", shown.alias("alerts"), F.col("total_alerts").alias("total")).join(values, "hour")


# cloud files -----------------------------------------------------------------------------------
@query("""SELECT event_id, '10.0.0.' || user_id % 256 AS src, 1000 + user_id % 100 AS port, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ')
AS start, CASE WHEN event_id % 2 = 0 THEN 'ACCEPT' ELSE 'REJECT' END AS action FROM events""")
def flow_logs(spark: SparkSession, d: str) -> DataFrame:
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    line = F.concat_ws(" ", F.lit("2"), F.col("event_id"), F.lit("eni"), F.concat(F.lit("10.0.0."), F.col("user_id") % 256), F.lit("10.1.1.1"), 1000 + F.col("user_id") % 100, F.lit("443 6 1 1"), s, s + 60, F.when(F.col("event_id") % 2 == 0, "ACCEPT").otherwise("REJECT"), F.lit("OK"))
    rows = C.flow_log_source(spark, landed(table(spark, d, "events"), line, "flow"))
    return rows.select(F.col("account_id").cast("bigint").alias("event_id"), F.col("srcaddr").alias("src"), F.col("srcport").cast("bigint").alias("port"), "start", "action")


@query("""SELECT page_id, kind, url, '10.0.0.' || page_id % 256 AS client, (1000 + page_id % 50)::VARCHAR AS port FROM pages, (SELECT unnest(['app',
'classic', 'network']) AS kind)""")
def balancer_logs(spark: SparkSession, d: str) -> DataFrame:
    """Application, classic and network load balancers: quoted requests, addresses with ports."""
    p, k = table(spark, d, "pages"), F.col("page_id")
    client, request = F.format_string("10.0.0.%d:%d", k % 256, 1000 + k % 50), F.concat(F.lit('"GET '), "url", F.lit(' HTTP/1.1"'))
    word = lambda n: [F.lit("-")] * n
    join = lambda *x: F.concat_ws(" ", *x)
    app = C.app_lb_log_source(spark, landed(p, join(F.lit("h2 t"), k.cast("string"), client, F.lit("10.9.9.9:80"), *word(7), request, *word(16)), "app"))
    classic = C.classic_lb_log_source(spark, landed(p, join(F.lit("t"), k.cast("string"), client, *word(8), request, *word(3)), "classic"))
    network = C.network_lb_log_source(spark, landed(p, join(F.lit("tls 2 t"), k.cast("string"), F.lit("-"), client, F.lit("10.9.9.9:443"), *word(10), "url", *word(2)), "network"))
    said = part("request", r"^GET (.*) HTTP/1\.1$")
    both = app.select("elb", F.lit("app").alias("kind"), said.alias("url"), "client_ip", "client_port")
    old = classic.select("elb", F.lit("classic").alias("kind"), said.alias("url"), F.split_part("client_port", F.lit(":"), F.lit(1)).alias("client_ip"), F.split_part("client_port", F.lit(":"), F.lit(2)).alias("client_port"))
    out = both.unionByName(old).unionByName(network.select("elb", F.lit("network").alias("kind"), F.col("domain_name").alias("url"), "client_ip", "client_port"))
    return out.select(F.col("elb").cast("bigint").alias("page_id"), "kind", "url", F.col("client_ip").alias("client"), F.col("client_port").alias("port"))


@query("""SELECT page_id, 'access' AS kind, url AS value FROM pages UNION ALL SELECT page_id, 'hub', url FROM pages UNION ALL SELECT page_id,
'findings', url FROM pages
UNION ALL SELECT page_id, 'inline', url FROM pages UNION ALL SELECT page_id, 'csv', url FROM pages UNION ALL SELECT page_id, 'columnar', url FROM
pages UNION ALL SELECT page_id, 'lake', url FROM pages""")
def landed_findings(spark: SparkSession, d: str) -> DataFrame:
    """Object access logs, hub and JSON findings, blobs by line, CSV access logs, columnar rows and a lake's parquet."""
    p, k = table(spark, d, "pages").select("page_id", "url"), F.col("page_id")
    access = F.concat(F.lit("owner bucket [06/Feb/2019:00:00:38 +0000] 192.0.2.3 req "), k, F.lit(' REST key "GET '), "url", F.lit(' HTTP/1.1" 200 - 1 1 1 1 "-" "a b" -'))
    a = C.object_access_log_source(spark, landed(p, access, "access")).select(F.col("request_id").cast("bigint").alias("page_id"), F.lit("access").alias("kind"), part("request_uri", "^GET (.*) HTTP").alias("value"))
    return_ = lambda df, kind: df.select(F.col("page_id").cast("bigint").alias("page_id"), F.lit(kind).alias("kind"), F.col("value"))
    hub = F.to_json(F.struct(k.cast("string").alias("id"), F.lit("x").alias("detail-type"), F.struct(F.array("url", F.lit("second")).alias("findings")).alias("detail")))
    h = return_(C.hub_findings_source(spark, landed(p, hub, "hub")).select(F.col("id").alias("page_id"), F.col("finding").alias("value")), "hub")
    finding = F.to_json(F.struct(k.alias("id"), F.struct(F.lit("Guard").alias("serviceName"), F.struct(F.struct(F.array("url").alias("portProbeDetails")).alias("portProbeAction")).alias("action")).alias("service")))
    schema = "id bigint, service struct<serviceName:string,action:struct<portProbeAction:struct<portProbeDetails:array<string>>>>"
    f = C.probe_detail_explode(C.findings_jsonl_source(spark, landed(p, finding, "findings"), schema).filter("source = 'guard'"))
    f = return_(f.select(F.col("id").alias("page_id"), F.col("probe_detail").alias("value")), "findings")
    inline = C.blob_records_source(spark, landed(p, F.when(k >= 0, F.to_json(F.struct("page_id", "url"))), "inline"), "json_inline", "tag", ".txt")
    i = return_(inline.select(F.get_json_object("record", "$.page_id").alias("page_id"), F.get_json_object("record", "$.url").alias("value")), "inline")
    folder = new_folder(spark, "csv")
    p.write.option("header", True).csv(folder)
    c = return_(C.gcs_access_log_source(spark, folder).select("page_id", F.col("url").alias("value")), "csv")
    grid = F.to_json(F.struct(F.array(F.struct(F.lit("t").alias("name"), F.array(*(F.struct(F.lit(n).alias("name"), F.lit("string").alias("type")) for n in ("page_id", "url"))).alias("columns"), F.array(F.array(k.cast("string"), "url")).alias("rows"))).alias("tables")))
    g = C.columnar_rows_source(spark, landed(p, grid, "columnar"), by_line=True)
    g = return_(g.select(F.col("record")["page_id"].alias("page_id"), F.col("record")["url"].alias("value")), "columnar")
    folder = new_folder(spark, "lake")
    p.write.parquet(folder)
    lake = return_(C.lake_parquet_source(spark, folder).select("page_id", F.col("url").alias("value")), "lake")
    out = a
    for more in (h, f, i, c, g, lake):
        out = out.unionByName(more)
    return out


# sinks -----------------------------------------------------------------------------------------
@query("""SELECT event_id, 'index' AS sink, 'wl-' || event_type AS place FROM events WHERE user_id % 5 > 0 UNION ALL SELECT event_id, 'rejected',
'WL ' || event_type FROM events WHERE user_id % 5 = 0
UNION ALL SELECT event_id, 'file', 'file' FROM events UNION ALL SELECT event_id, 'routed', 'all' FROM events UNION ALL SELECT event_id, 'routed',
'clicks' FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 'enriched', event_type FROM events UNION ALL SELECT event_id, 'archive', strftime(ts, '%Y-%m-%d') FROM events UNION ALL
SELECT min(event_id), 'snapshot', strftime(min(ts), '%Y-%m-%d') FROM events GROUP BY user_id HAVING user_id % 3 > 0""")
def sinks_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every sink written to a new folder and read back."""
    e, base = table(spark, d, "events"), new_folder(spark, "sinks")
    day = F.date_format("ts", "yyyy-MM-dd")
    slim = e.select("event_id", "event_type", "user_id")
    name = F.concat(F.when(F.col("user_id") % 5 > 0, "wl-").otherwise("WL "), "event_type")
    rejected = K.index_sink(slim, f"{base}/index", name).select("event_id", F.lit("rejected").alias("sink"), F.col("index_name").alias("place"))
    K.append_file_sink(slim, f"{base}/file")
    K.routed_outputs(slim, f"{base}/routed", {"all": F.lit(True), "clicks": F.col("event_type") == "click"})
    K.enriched_alert_sink(slim, ["event_id"], ["event_type"], f"{base}/enriched")
    K.raw_archive_sink(e.withColumn("raw", F.col("event_id").cast("string")), "raw", day, f"{base}/archive")
    firsts = e.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min("ts").alias("ts"))
    K.daily_snapshot_sink(firsts.unionByName(firsts), firsts.filter("user_id % 3 = 0"), "user_id", day, f"{base}/snapshot")
    back = lambda sink, place: spark.read.json(f"{base}/{sink}").select(F.col("event_id").cast("bigint").alias("event_id"), F.lit(sink).alias("sink"), place.cast("string").alias("place"))
    enriched = spark.read.json(f"{base}/enriched").select("original_alert.event_id", F.lit("enriched").alias("sink"), F.col("ai_analysis.event_type").alias("place"))
    archive = spark.read.text(f"{base}/archive").select(F.col("value").cast("bigint").alias("event_id"), F.lit("archive").alias("sink"), F.col("day").cast("string").alias("place"))
    out = back("index", F.col("index_name"))
    for more in (rejected, back("file", F.lit("file")), back("routed", F.col("output")), enriched, archive, back("snapshot", F.col("day"))):
        out = out.unionByName(more)
    return out


# streams ---------------------------------------------------------------------------------------
@query("""SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS scored FROM events WHERE ts >= TIMESTAMP '2024-01-10'""")
def stream_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Landed twice, read once a file, cut at a date, deduplicated, scored and appended: incremental_files, discard_late_or_old, stream_dedup, tail_and_score."""
    base = new_folder(spark, "stream")
    e = table(spark, d, "events").select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e).write.parquet(f"{base}/in")
    rows = streams.incremental_files(spark, f"{base}/in", e.schema, "parquet", per_trigger=1000)
    fresh = streams.stream_dedup(streams.discard_late_or_old(rows, "2024-01-10", late=None), "event_id")
    score = lambda df: df.select("event_id", "event_type", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("scored"))
    run = streams.tail_and_score(fresh, score, f"{base}/out", f"{base}/checkpoint", once=True)
    run.awaitTermination()
    return spark.read.schema("event_id bigint, event_type string, scored string").json(f"{base}/out")
