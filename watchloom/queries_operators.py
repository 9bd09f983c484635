"""Registered queries of filters, joins, state tables, labels and scores that the first set leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates as A
from .operators import enrich as J
from .operators import filters as L
from .operators import ranking as W
from .operators import scoring as R
from .operators import state as D
from .operators import versions as V
from .plans.alerts import alerts, table
from .registry import query
from .sources import incremental as INC
from .sources.landing import stored

# filters and projections -----------------------------------------------------------------------


@query("""WITH {alerts} SELECT id, CASE WHEN level >= 12 THEN rule_id || '!' END AS staged, coalesce(rule_id = 'click', false) AS is_click, level =
score AS same FROM alerts
WHERE level > 2 AND score >= 10 AND (level > 5 OR rule_id = 'click') AND (user_id % 2 = 0) IS NOT DISTINCT FROM true""")
def filter_chain(spark: SparkSession, d: str) -> DataFrame:
    """check_expression, severity_threshold, field_query, condition_then_stages, value_equals, field_equals_field."""
    rows = L.check_expression(alerts(spark, d), "level > 2 AND (level > 5 OR rule_id = 'click')").withColumn("even", F.col("user_id") % 2 == 0)
    rows = L.field_query(L.severity_threshold(rows, "score", 10), even=True)
    staged = L.condition_then_stages(F.col("level") >= 12, staged=F.concat("rule_id", F.lit("!")))
    same = L.field_equals_field(F.col("level"), F.col("score"))
    return rows.select("id", staged["staged"].alias("staged"), L.value_equals(F.col("rule_id"), "click").alias("is_click"), same.alias("same"))


@query("""SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""")
def distinct_fields(spark: SparkSession, d: str) -> DataFrame:
    return L.distinct_rows(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT event_id, event_type, 'Event from ' || event_type || ': ' || left(props, 200) AS description,
lower(concat_ws(' ', event_type, 'level:' || user_id % 16, 'rule:' || event_id, event_type || ' x', 'T1', props, 'k:' || json_extract_string(props,
'$.k'), 'Agent')) AS text FROM events""")
def event_texts(spark: SparkSession, d: str) -> DataFrame:
    e = L.select_fields(table(spark, d, "events"), ["event_id", "event_type", "props", "user_id"], ["event_type"])
    kind, data = F.col("event_type"), F.from_json("props", "map<string,string>")
    one = F.create_map(F.lit("k"), data["k"])
    text = L.searchable_text(kind, F.col("user_id") % 16, F.col("event_id"), F.array(kind, F.lit("x")), F.array(F.lit("T1")), F.col("props"), one, F.lit("Agent"))
    return e.select("event_id", "event_type", L.threat_description(kind, F.col("props")).alias("description"), text.alias("text"))


@query("""WITH {alerts}, e AS (SELECT user_id, level, min(ts) AS a, max(ts) AS b FROM alerts GROUP BY 1, 2) SELECT user_id, level FROM e
WHERE level >= 8 AND level % 2 = 0 AND a >= TIMESTAMP '2024-01-03' AND b <= TIMESTAMP '2024-01-28'""")
def episode_search(spark: SparkSession, d: str) -> DataFrame:
    spans = alerts(spark, d).groupBy("user_id", "level").agg(F.struct(F.min("ts").alias("start"), F.max("ts").alias("end")).alias("time_range"))
    kind = F.when(F.col("level") % 2 == 0, "even").otherwise("odd")
    tags = F.array_compact(F.array(F.when(F.col("level") >= 8, "severe"), F.lit("any")))
    moment = lambda x: F.lit(x).cast("timestamp_ntz")
    rows = spans.withColumns({"episode_type": kind, "tags": tags})
    return L.episode_search(rows, "even", ["severe", "any"], moment("2024-01-03"), moment("2024-01-28")).select("user_id", "level")


@query("""SELECT event_id FROM events WHERE event_type = 'click' AND props ILIKE '%1%' ORDER BY ts DESC, props LIMIT 50""")
def ioc_search(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("type"), F.col("props").alias("value"), F.col("ts").alias("first_seen"))
    return L.ioc_search(rows, "click", "1").select("event_id")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 3 AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01'""")
def metadata_prefilter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    hits = L.metadata_prefilter(rows, F.col("o_custkey") % 7 == 3, F.col("o_orderstatus") == "F", F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))
    return hits.select("o_orderkey")


@query("""WITH k AS (SELECT user_id, date_trunc('second', max(ts)) AS t FROM events GROUP BY 1), m AS (SELECT max(t) AS now FROM k) SELECT user_id AS
id FROM k, m WHERE user_id % 2 = 0 AND epoch(t) < epoch(now) - 21600""")
def stale_agents(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    status = F.when(F.col("id") % 2 == 0, "disconnected").otherwise("active")
    agents = e.groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_keepalive")).withColumn("status", status)
    now = e.agg(F.max("ts").alias("now"))
    return L.stale_agent_filter(agents.crossJoin(F.broadcast(now)), F.col("now"), 21600).select("id")


@query("""SELECT url AS path, 'like' AS how FROM pages WHERE url LIKE '%example.org/%' UNION ALL SELECT url, 'inode' FROM pages WHERE page_id % 100 =
7 AND page_id % 3 = 1""")
def file_state_search(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "pages").select(F.col("url").alias("path"), (F.col("page_id") % 100).alias("inode"), (F.col("page_id") % 3).alias("device"))
    by_name = L.file_state_search(files, like="%example.org/%").withColumn("how", F.lit("like"))
    return by_name.unionByName(L.file_state_search(files, inode=7, device=1).withColumn("how", F.lit("inode")))


@query("""SELECT p_partkey, 'CVE-' || p_partkey AS cve, p_brand AS package, CASE p_partkey % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Low' ELSE '-' END AS severity,
CASE WHEN p_size % 5 > 0 THEN round(p_size / 10, 2) END AS base, p_size % 5 = 0 OR p_partkey % 3 = 2 AS under_evaluation FROM part""")
def vulnerability_documents(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    severity = F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "low").otherwise(" ")
    found = table(spark, d, "part").select(F.concat(F.lit("CVE-"), k).alias("cve"), k.alias("agent_id"), F.col("p_brand").alias("item"), size.cast("string").alias("version"), severity.alias("severity"), F.when(size % 5 > 0, size / 10).otherwise(0.0).alias("score"), F.lit(None).cast("string").alias("description"))
    v = F.col("vulnerability")
    return L.vulnerability_document(found).select(F.col("agent.id").alias("p_partkey"), v["id"].alias("cve"), F.col("package.name").alias("package"), v["severity"].alias("severity"), v["score"]["base"].alias("base"), v["under_evaluation"].alias("under_evaluation"))


# joins -----------------------------------------------------------------------------------------
@query("""WITH e AS (SELECT event_id, user_id % 40 AS a, user_id % 250 AS b FROM events) SELECT event_id, CASE WHEN a < 25 THEN CASE WHEN b < 128 AND
a % 2 = 0 THEN n_name || ' low' ELSE n_name END END AS asn FROM e LEFT JOIN nation ON a = n_nationkey""")
def asn_enrich(spark: SparkSession, d: str) -> DataFrame:
    """Networks inside networks, half of the addresses IPv6: the smallest network that holds the address."""
    n, u = F.col("n_nationkey"), F.col("user_id")
    text = lambda a, b, six: F.when(six, F.format_string("2001:db8:%x:%x::1", a, b)).otherwise(F.format_string("10.%d.%d.1", a, b))
    a, b = u % 40, u % 250
    rows = table(spark, d, "events").select("event_id", text(a, b, a % 2 == 1).alias("ip"))
    wide = F.when(n % 2 == 1, F.format_string("2001:db8:%x::/48", n)).otherwise(F.format_string("10.%d.0.0/16", n))
    nation = table(spark, d, "nation")
    nets = nation.select(wide.alias("network"), F.col("n_name").alias("record"))
    low = nation.filter(n % 2 == 0).select(F.format_string("10.%d.0.0/17", n).alias("network"), F.concat("n_name", F.lit(" low")).alias("record"))
    return J.asn_enrich(rows, nets.unionByName(low), "ip", "asn").select("event_id", "asn")


@query("""SELECT c_custkey, n_name || ',Group ' || c_custkey % 5 || ',S-1-5-9' AS names FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def sid_descriptions(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.concat(F.lit("S-1-1-"), "n_nationkey").alias("key"), F.col("n_name").alias("value"))
    domain = spark.range(5).select((500 + F.col("id")).cast("string").alias("key"), F.concat(F.lit("Group "), "id").alias("value"))
    sids = F.array(F.concat(F.lit("S-1-1-"), "c_nationkey"), F.concat(F.lit("S-1-5-21-7-8-9-"), 500 + F.col("c_custkey") % 5), F.lit("S-1-5-9"))
    out = J.sid_list_describe(table(spark, d, "customer").select("c_custkey", sids.alias("sids")), names, domain, "sids", "names")
    return out.select("c_custkey", F.array_join("names", ",").alias("names"))


@query("""WITH f AS (SELECT DISTINCT p_partkey % 20 AS agent_id, p_brand AS item, 'CVE-' || p_size AS cve, p_partkey % 3 AS source FROM part), b AS
(SELECT agent_id, item, cve, min(source) AS source FROM f GROUP BY ALL)
SELECT agent_id, item, cve, ['vendor', 'nvd', 'other'][source + 1] AS source, CASE WHEN source < 2 THEN 'text ' || cve ELSE 'default' END AS
description, CASE WHEN source = 0 THEN 9.5 ELSE 5.0 END AS score,
CASE WHEN CAST(substr(cve, 5) AS INT) % 4 = agent_id % 4 THEN 'DELETED' ELSE 'KEPT' END AS operation FROM b""")
def findings_chain(spark: SparkSession, d: str) -> DataFrame:
    """source_priority_dedup, description_fallback and solved_by_hotfix, one after the other."""
    sources = F.array(F.lit("vendor"), F.lit("nvd"), F.lit("other"))
    rank = F.col("p_partkey") % 3
    found = table(spark, d, "part").select((F.col("p_partkey") % 20).alias("agent_id"), F.col("p_brand").alias("item"), F.concat(F.lit("CVE-"), "p_size").alias("cve"), F.element_at(sources, (rank + 1).cast("int")).alias("source")).distinct()
    best = J.source_priority_dedup(found, F.array_position(sources, F.col("source")))
    key = best.select(F.concat("cve", F.lit("@"), "source").alias("cve"), F.col("cve").alias("plain"), "source", "agent_id", "item")
    each = key.select("cve", "plain", "source").distinct()
    text = F.when(F.col("source") == "other", "Not Defined").otherwise(F.concat(F.lit("text "), "plain"))
    vendor = each.select("cve", text.alias("description"), F.when(F.col("source") == "vendor", 9.5).otherwise(0.0).alias("score"), F.lit("High").alias("severity"))
    default = each.select("cve", F.lit("default").alias("description"), F.lit(5.0).alias("score"), F.lit("Medium").alias("severity"))
    out = J.description_fallback(key, vendor, default).select("agent_id", "item", F.col("plain").alias("cve"), "source", "description", "score")
    update = F.concat(F.lit("KB"), F.substring("cve", 5, 9).cast("int") % 4)
    remediations = out.select("cve").distinct().withColumn("update", update)
    hotfixes = out.select("agent_id").distinct().withColumn("hotfix", F.concat(F.lit("KB"), F.col("agent_id") % 4))
    return J.solved_by_hotfix(out, remediations, hotfixes)


@query("""SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN n_name ELSE 'old' END AS groups FROM customer JOIN nation ON c_nationkey =
n_nationkey WHERE c_custkey % 5 <> 0""")
def agent_group_updates(spark: SparkSession, d: str) -> DataFrame:
    """agent_groups_update after known_item_anti_join has left the customers that were seen out."""
    c = table(spark, d, "customer")
    new = J.known_item_anti_join(c, c.filter("c_custkey % 5 = 0"), "c_custkey")
    docs = new.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("agent_id"), F.array(F.lit("old")).alias("groups"), F.lit(1).alias("version"))
    updates = table(spark, d, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("agent_id"), F.array("n_name").alias("groups"), F.lit(1).alias("version"))
    return J.agent_groups_update(docs, updates).select("id", F.array_join("groups", ",").alias("groups"))


@query("""SELECT event_id, n_name AS title, '10.0.0.' || n_nationkey AS ioc, user_id % 3 AS rank FROM events JOIN nation ON user_id % 25 = n_nationkey""")
def intel_matches(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    top = e.select("event_id", (F.col("user_id") % 25).alias("intel_id"), (F.col("user_id") % 3).alias("rank"))
    entities = F.create_map(F.lit("ip"), F.array(F.concat(F.lit("10.0.0."), "n_nationkey")), F.lit("actor"), F.array("n_name"))
    intel = table(spark, d, "nation").select(F.col("n_nationkey").alias("intel_id"), F.col("n_name").alias("title"), entities.alias("entities"))
    return J.intel_to_event_match(e.select("event_id"), top, intel).select("event_id", "title", F.array_join("ioc", ",").alias("ioc"), "rank")


@query("""SELECT r_regionkey AS id, string_agg(n_name, ',' ORDER BY n_name) AS members FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY 1""")
def technique_catalog(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    lists = nation.groupBy(F.col("n_regionkey").alias("id")).agg(F.collect_list("n_nationkey").alias("ids"))
    techniques = table(spark, d, "region").select(F.col("r_regionkey").alias("id")).join(lists, "id", "left")
    out = J.technique_catalog(techniques, nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "ids", "members")
    return out.select("id", F.array_join("members", ",").alias("members"))


# aggregates, orders, unions --------------------------------------------------------------------
@query("""SELECT max(o_custkey) AS version, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n_filled, strftime(min(o_orderdate),
'%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last,
count(*) AS entries, count(DISTINCT o_custkey % 100 * 10 + o_orderkey % 3) AS inodes FROM orders""")
def table_facts(spark: SparkSession, d: str) -> DataFrame:
    """max_version, rows_per_group, range_bounds and entry_counts of orders, side by side."""
    o = table(spark, d, "orders")
    filled = A.rows_per_group(o, ["o_orderstatus"]).filter("o_orderstatus = 'F'").select(F.col("n").alias("n_filled"))
    bounds = A.range_bounds(o, "o_orderdate").select(F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))
    entries = A.entry_counts(o.select((F.col("o_custkey") % 100).alias("inode"), (F.col("o_orderkey") % 3).alias("device")))
    return A.max_version(o.withColumnRenamed("o_custkey", "version")).crossJoin(filled).crossJoin(bounds).crossJoin(entries)


@query("""SELECT o_orderkey, o_orderstatus AS part, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS extra,
len(list_intersect([o_orderstatus, o_orderpriority, 'x'], ['F', '1-URGENT'])) AS suspicious FROM orders""")
def merged_tables(spark: SparkSession, d: str) -> DataFrame:
    """merge_daily of the order states, merge_knowledge where one has a column more, group_intersection over all."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("part"), "o_orderpriority")
    groups = W.group_intersection(F.array("part", "o_orderpriority", F.lit("x")), ["F", "1-URGENT"]).cast("bigint")
    o = o.withColumn("suspicious", groups)
    own = o.filter("part = 'F'").withColumnRenamed("o_orderpriority", "extra")
    rest = W.merge_daily([o.filter(F.col("part") == s).drop("o_orderpriority") for s in ("O", "P")])
    return W.merge_knowledge([own, rest])


@query("""(SELECT c_custkey, 'sorted' AS how FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 40) UNION ALL (SELECT c_custkey, 'paged' FROM
customer WHERE c_name LIKE 'Customer#00000%' ORDER BY c_name LIMIT 30 OFFSET 30)""")
def sorted_and_paged(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    first = W.sort_fields(c, ["-c_nationkey", "+c_custkey"], ["c_custkey", "c_nationkey"]).limit(40).select("c_custkey", F.lit("sorted").alias("how"))
    paged = W.prefix_page(c.withColumnRenamed("c_name", "key"), "Customer#00000", 2, 30).select("c_custkey", F.lit("paged").alias("how"))
    return first.unionByName(paged)


# state tables ----------------------------------------------------------------------------------
@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders) SELECT k, CASE WHEN k % 3 = 0 THEN 'new' ELSE s END AS s, CASE WHEN k % 3
= 0 THEN 1 ELSE 0 END AS touched FROM o WHERE k % 3 = 0 OR k % 2 = 0""")
def row_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    state, changes = D.row_upsert(o.filter("k % 2 = 0"), o.filter("k % 3 = 0").withColumn("s", F.lit("new")), ["k"])
    return state.join(changes.select("k", F.lit(1).alias("touched")), "k", "left").na.fill(0, ["touched"])


@query("""SELECT k, operation, count(*) OVER (PARTITION BY operation) AS n, CASE operation WHEN 'MODIFIED' THEN 8 WHEN 'INSERTED' THEN 1 END AS
version, 3::BIGINT AS stamped FROM (
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 1 THEN 'DELETED' WHEN o_orderkey % 10 = 0 THEN 'INSERTED' WHEN o_orderkey % 7 = 0 THEN 'MODIFIED'
END AS operation FROM orders) WHERE operation IS NOT NULL""")
def transaction_diff(spark: SparkSession, d: str) -> DataFrame:
    """transaction_diff, version_bump and set_version."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.lit(7).alias("version"))
    scan = o.filter("k % 10 <> 1").withColumn("c", F.when(F.col("k") % 7 == 0, -1).otherwise(F.col("c")))
    bumped = D.version_bump(D.transaction_diff(o.filter("k % 10 <> 0"), scan, ["k"]))
    version = F.when(F.col("operation") != "DELETED", F.col("version"))
    sizes = bumped.groupBy("operation").agg(F.count(F.lit(1)).alias("n"))
    out = bumped.select("k", "operation", version.alias("bumped")).join(sizes, "operation")
    return D.set_version(out, 3).withColumnsRenamed({"version": "stamped"}).withColumnRenamed("bumped", "version")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM lineitem UNION ALL SELECT l_orderkey,
l_linenumber, 'extra' FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber = 1""")
def candidate_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("old").alias("origin"))
    again = rows.filter("l_orderkey % 3 = 0").withColumn("origin", F.lit("new"))
    again = again.unionByName(again.filter("l_linenumber = 1").withColumn("origin", F.lit("extra")))
    return D.candidate_replace(rows, again, "l_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 4 = 1 THEN 'DELETED' END AS operation FROM orders""")
def inventory_clean(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    gone = o.select("o_custkey").distinct().filter("o_custkey % 4 = 1")
    stay, report = D.inventory_clean(o.select("o_orderkey", "o_custkey"), gone, ["o_custkey"])
    return stay.withColumn("operation", F.lit(None).cast("string")).unionByName(report).select("o_orderkey", "operation")


@query("""WITH k AS (SELECT user_id AS id, max(ts) AS last_sync, (user_id % 5) * 43200 AS s FROM events GROUP BY user_id), m AS (SELECT max(last_sync)
AS now FROM k) SELECT id FROM k, m WHERE last_sync + to_seconds(s) <= now""")
def sync_due(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_sync")).withColumn("interval_seconds", F.col("id") % 5 * 43200)
    now = marks.agg(F.max("last_sync").alias("now"))
    return D.sync_due(marks.crossJoin(F.broadcast(now)), F.col("now")).select("id")


@query("""SELECT c_custkey AS rule_id, c_mktsegment = 'BUILDING' AND c_nationkey <= 12 AND c_custkey % 3 <> 0 AS found FROM customer""")
def policy_checks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    line = F.concat(F.lit("Segment "), "c_mktsegment", F.lit(" nation "), "c_nationkey", F.when(k % 3 == 0, " off").otherwise(""))
    c = table(spark, d, "customer")
    content = c.select(F.concat(F.lit("t"), k).alias("target"), F.concat(F.lit("# head\n"), line).alias("text"))
    term = lambda kind, negate, pattern, op=None, value=None: F.struct(F.lit(kind).alias("kind"), F.lit(negate).alias("negate"), F.lit(pattern).alias("pattern"), F.lit(op).cast("string").alias("op"), F.lit(value).cast("double").alias("value"))
    terms = F.array(term("r", False, "^Segment BUILDING"), term("n", False, r"nation (\d+)", "<=", 12.0), term("r", True, "off$"))
    return V.policy_check_eval(content, c.select(k.alias("rule_id"), F.concat(F.lit("t"), k).alias("target"), terms.alias("terms")))


# bookmarks -------------------------------------------------------------------------------------
@query("""SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderdate >= TIMESTAMP '1996-01-01' AND NOT o_orderdate BETWEEN TIMESTAMP
'1996-06-01' AND TIMESTAMP '1997-06-01'""")
def unread_objects(spark: SparkSession, d: str) -> DataFrame:
    """already_processed_filter, then processed_window_filter."""
    moment = lambda x: F.lit(x).cast("timestamp_ntz")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("modified"))
    new = INC.already_processed_filter(o, o.filter("o_orderkey % 3 = 0"), ["o_orderkey"])
    bounds = spark.range(1).select(moment("1996-06-01").alias("lo"), moment("1997-06-01").alias("hi"))
    return INC.processed_window_filter(new, bounds, moment("1996-01-01")).select("o_orderkey")


@query("""WITH a AS (SELECT o_custkey AS k, max(o_orderkey) AS token, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders WHERE o_orderkey % 2 =
0 GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS token, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders WHERE o_orderkey % 2 =
1 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, coalesce(b.token, a.token) AS token, strftime(least(a.s, b.s), '%Y-%m-%d') AS start_time, strftime(greatest(a.e, b.e),
'%Y-%m-%d') AS end_time FROM a FULL JOIN b ON a.k = b.k""")
def range_bookmarks(spark: SparkSession, d: str) -> DataFrame:
    def marks(parity: int) -> DataFrame:
        rows = table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == parity).groupBy(F.col("o_custkey").alias("k"))
        return rows.agg(F.max("o_orderkey").alias("token"), F.min("o_orderdate").alias("start_time"), F.max("o_orderdate").alias("end_time"))

    day = {c: F.date_format(c, "yyyy-MM-dd") for c in ("start_time", "end_time")}
    return INC.merge_range_bookmark(marks(0), marks(1), ["k"]).withColumns(day)


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderkey % 4 > 0""")
def path_dates(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("logs"), F.date_format("o_orderdate", "/yyyy/MM/dd/"), F.lit("x.gz"))).otherwise("logs/none/x.gz")
    out = INC.path_date_filter(table(spark, d, "orders").select("o_orderkey", path.alias("path")), "path", "1997-01-01")
    return out.select("o_orderkey", F.date_format("path_date", "yyyy-MM-dd").alias("day"))


# scores and labels -----------------------------------------------------------------------------
@query("""WITH e AS (SELECT event_id, user_id % 101 AS risk, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'][user_id % 4 + 1] AS s, (event_id % 100) / 100 AS c
FROM events)
SELECT event_id, least(100, risk + CASE s WHEN 'CRITICAL' THEN 15 WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 5 ELSE 0 END) AS boosted, risk > 70 OR c >
0.7 AS suspicious, CASE WHEN c >= 0.8 THEN 'CRITICAL' WHEN c >= 0.6 THEN 'HIGH' WHEN c >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS near,
round(0.4 * c + 0.3 * risk / 100 + 0.3 * least(event_id % 8 / 5, 1), 6) AS confidence, CASE WHEN event_id % 3 > 0 AND c >= 0.8 THEN 'confirmed' WHEN
event_id % 3 > 0 AND c >= 0.6 THEN 'likely' WHEN c >= 0.4 THEN 'possible' ELSE 'unlikely' END AS triage FROM e""")
def score_labels(spark: SparkSession, d: str) -> DataFrame:
    e, risk, c = F.col("event_id"), F.col("user_id") % 101, (F.col("event_id") % 100) / 100
    severity = F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW"))), (F.col("user_id") % 4 + 1).cast("int"))
    confidence = F.round(R.hypothesis_confidence(c, risk / 100, e % 8), 6)
    rows = table(spark, d, "events")
    return rows.select("event_id", R.severity_boost(risk, severity).alias("boosted"), R.suspicious(risk, c).alias("suspicious"), R.similarity_severity(c).alias("near"), confidence.alias("confidence"), R.triage_decision(e % 3 > 0, c).alias("triage"))


@query("""WITH e AS (SELECT event_id, user_id % 101 AS score, user_id % 31 AS t, event_id % 51 AS f, ['SSH Brute Force', 'SQL Injection',
'PowerShell Obfuscation', 'Port Scanning'][event_id % 4 + 1] AS p, event_id % 5 = 0 AS sus, user_id % 9 = 0 AS intel FROM events),
l AS (SELECT event_id, list_filter([CASE WHEN score > 80 THEN 'High priority score detected - immediate investigation recommended' END, CASE WHEN t >
20 THEN 'Event occurred during off-hours - suspicious timing' END,
CASE WHEN f > 30 THEN 'High frequency of failed attempts detected - possible brute force' END, CASE WHEN sus THEN 'Suspicious pattern detected: ' || p
END, CASE WHEN sus THEN CASE event_id % 4 WHEN 0 THEN 'Consider blocking source IP and enabling rate limiting' WHEN 1 THEN
'Review database access logs and validate input sanitization'
WHEN 2 THEN 'Investigate PowerShell execution and check for script obfuscation' END END, CASE WHEN intel THEN 'Similar to known threat: worm' END,
CASE WHEN intel THEN 'Recommended mitigation: patch' END], lambda x: x IS NOT NULL) AS l FROM e)
SELECT event_id, CASE WHEN len(l) > 0 THEN array_to_string(l, '; ') ELSE 'Review event manually for potential security concerns' END AS advice FROM l""")
def advice(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    pattern = F.element_at(F.array(*map(F.lit, ("SSH Brute Force", "SQL Injection", "PowerShell Obfuscation", "Port Scanning"))), (e % 4 + 1).cast("int"))
    intel = F.when(u % 9 == 0, F.struct(F.lit("worm").alias("description"), F.lit("patch").alias("mitigation")))
    return table(spark, d, "events").select("event_id", F.array_join(R.recommendations(u % 101, u % 31, e % 51, pattern, e % 5 == 0, intel), "; ").alias("advice"))


@query("""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t, doc_id % 11 = 0 AS a, doc_id % 7 = 0 AS p FROM documents)
SELECT doc_id, CASE WHEN a THEN 'alert' WHEN p OR regexp_matches(t, 'process|exec') THEN 'process' WHEN regexp_matches(t, 'login|auth|password') THEN
'authentication' WHEN regexp_matches(t, 'connection|port|network') THEN 'network' ELSE 'alert' END AS class,
concat_ws(',', CASE WHEN regexp_matches(t, 'ssh|login|auth') THEN 'authentication' END, CASE WHEN regexp_matches(t, 'process|exec|command') THEN
'process' END, CASE WHEN regexp_matches(t, 'network|connection|port') THEN 'network' END, CASE WHEN regexp_matches(t, 'file|integrity|modification')
THEN 'file_integrity' END) AS tags,
concat_ws(',', CASE WHEN contains(t, 'powershell') AND contains(t, 'encoded') THEN 'powershell_encoded' END, CASE WHEN contains(t, 'sudo') AND
contains(t, 'su') THEN 'privilege_escalation' END, CASE WHEN contains(t, 'injection') AND contains(t, 'dll') THEN 'process_injection' END,
CASE WHEN contains(t, 'psexec') AND contains(t, 'wmic') THEN 'lateral_movement' END, CASE WHEN contains(t, 'password') AND contains(t, 'credential')
THEN 'credential_access' END) AS flags,
array_to_string(list_concat(['10.0.0.1'], regexp_extract_all(t, '\\b((?:\\d{1,3}\\.){3}\\d{1,3})\\b', 1)), ',') AS ips FROM x""")
def event_labels(spark: SparkSession, d: str) -> DataFrame:
    text, k = F.coalesce("text", F.lit("")), F.col("doc_id")
    kind = R.event_class(text, k % 11 == 0, F.when(k % 7 == 0, 1))
    return table(spark, d, "documents").select("doc_id", kind.alias("class"), F.array_join(R.event_tags(text), ",").alias("tags"), F.array_join(R.indicator_flags(text), ",").alias("flags"), F.array_join(R.event_ips(text, F.lit("10.0.0.1")), ",").alias("ips"))


@query("""SELECT event_id, round(exp(-(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3.6e9 / 168), 6) AS fresh FROM events""")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(R.freshness(F.col("ts"), F.lit("2024-02-01").cast("timestamp")), 6).alias("fresh"))


@query("""WITH q AS (SELECT p_partkey AS query, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part), b AS (SELECT DISTINCT p_type
AS technique FROM part),
n AS (SELECT technique, unnest(list_distinct(string_split(lower(technique), ' '))) AS w, 0.5 AS s FROM b), h AS (SELECT query, technique, max(s) AS
score FROM q JOIN n USING (w) GROUP BY 1, 2),
k AS (SELECT query, technique, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, technique)::INT AS rank FROM h)
SELECT * FROM k WHERE rank <= 5""")
def technique_matches(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    techniques = p.select(F.col("p_type").alias("technique"), F.col("p_type").alias("name"), F.lit("").alias("description")).distinct()
    out = R.technique_keyword_match(p.select(F.col("p_partkey").alias("query"), F.col("p_name").alias("text")), techniques)
    return out.select("query", "technique", F.round("score", 6).alias("score"), "rank")


@query()
def forest_detection(spark: SparkSession, d: str) -> DataFrame:
    """What the forest itself tells apart: separation, detection and false-positive rate at its calibrated threshold, and the shares of clean and attack rows under the contamination offset."""
    from .queries import calibrated, forest_raw

    raw = forest_raw(spark, d)
    offset = R.contamination_offset(raw.filter(~F.col("is_attack")), 0.05)
    under = raw.agg(*(F.try_divide(F.count_if(p & (F.col("raw") < offset)), F.count_if(p)).alias(f"{n}_under_offset") for n, p in (("clean", ~F.col("is_attack")), ("attack", F.col("is_attack")))))
    scored = stored(calibrated(raw), "forest-scores")
    threshold = A.anomaly_threshold(scored.filter(~F.col("is_attack"))).first()[0]
    return A.verdict(A.class_metrics(scored, threshold)).withColumn("threshold", F.lit(threshold)).crossJoin(F.broadcast(under))
