"""Registered queries of indicator matching, of resynchronisation by checksum trees and of the vector index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import aggregates as A
from .operators import indicators as I
from .operators import merkle as M
from .operators import process_trees as T
from .operators import vector_index as V
from .plans.alerts import alerts, table
from .registry import query

NO_LETTERS = r"[^\p{L}]+"


def words(text: str, least: int) -> Column:
    """The distinct words of a text that have at least so many letters."""
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), NO_LETTERS), lambda x: F.length(x) >= least))


@query(rf"""WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '{NO_LETTERS}')) AS literal FROM conversations), l AS (SELECT literal FROM w
WHERE length(literal) >= 7)
SELECT doc_id, literal, instr(text, literal) - 1 AS first_at FROM documents, l WHERE contains(text, literal)""")
def indicator_hits(spark: SparkSession, d: str) -> DataFrame:
    """Every long word of the conversations as an indicator, searched in all documents."""
    literals = table(spark, d, "conversations").select(F.explode(words("text", 7)).alias("literal"))
    return I.literal_hits(table(spark, d, "documents"), literals, "text", "doc_id").drop("n")


@query(rf"""WITH w AS (SELECT DISTINCT conv_id AS intel_id, unnest(regexp_split_to_array(text, '{NO_LETTERS}')) AS ioc FROM conversations), l AS
(SELECT * FROM w WHERE length(ioc) >= 9),
u AS (SELECT DISTINCT ioc FROM l), h AS (SELECT doc_id, ioc FROM documents, u WHERE contains(text, ioc))
SELECT doc_id, intel_id, 'conversation ' || intel_id AS title, string_agg(ioc, ',' ORDER BY ioc) AS ioc FROM h JOIN l USING (ioc) GROUP BY 1, 2""")
def intel_in_texts(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as intelligence: their long words are its indicators (of kind file), the short ones name actors, which aren't searched."""
    entities = F.create_map(F.lit("file"), F.flatten(F.collect_list(words("text", 9))), F.lit("actor"), F.array(F.lit("the")))
    intel = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("intel_id")).agg(entities.alias("entities"))
    intel = intel.select("intel_id", F.concat(F.lit("conversation "), "intel_id").alias("title"), "entities")
    return I.intel_in_texts(table(spark, d, "documents"), intel, "text", "doc_id").withColumn("ioc", F.array_join("ioc", ","))


#: Patterns with the literals without which they can't match.
WORD_PATTERNS = {"list": (r"\d+\. [a-z]", [["1. "], ["2. "], ["3. "]]), "address": (r"[\w.]+@[\w.]+\.\w+", [["@", "."]]), "secret": (r"(?:password|token)\s*[:=]", [["password"], ["token"]])}


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN (contains(t, '1. ') OR contains(t, '2. ') OR contains(t, '3. ')) AND regexp_matches(t,
'[0-9]+\\. [a-z]') THEN 'list' END,
  CASE WHEN contains(t, '.') AND regexp_matches(t, '[\\pL\\pN_.]+@[\\pL\\pN_.]+\\.[\\pL\\pN_]') THEN 'address' END, CASE WHEN regexp_matches(t,
'(password|token)\\s*[:=]') THEN 'secret' END], lambda x: x IS NOT NULL), ',') AS names FROM t""".replace("\\\\", "\\"))
def pattern_hits(spark: SparkSession, d: str) -> DataFrame:
    """Regular expressions that run only on documents with their literals."""
    return I.regex_hits(table(spark, d, "documents"), WORD_PATTERNS, "text", "doc_id").withColumn("names", F.array_join("names", ","))


LEAF_ROWS = 64


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_custkey % 5 AS agent, o_orderstatus || ':' || o_orderpriority AS c FROM orders), m AS (SELECT * FROM o
WHERE k % 107 <> 0),
t AS (SELECT k, agent, CASE WHEN k % 101 = 0 THEN 'old' ELSE c END AS c FROM o WHERE k % 103 <> 0 UNION ALL SELECT k, 9, c FROM o WHERE k % 3 = 0),
n AS (SELECT greatest((SELECT count(*) FROM m), (SELECT count(*) FROM t)) AS n), z AS (SELECT 2 * (SELECT min(x) FROM range(0, 6) AS r(x) WHERE n /
pow(256, x) <= {LEAF_ROWS} OR x = 5) AS w FROM n),
p AS (SELECT 'm' AS side, agent, k, c, sha1(length(CAST(k AS VARCHAR)) || ':' || k) AS place FROM m UNION ALL SELECT 't', agent, k, c,
sha1(length(CAST(k AS VARCHAR)) || ':' || k) FROM t),
l AS (SELECT agent, substr(place, 1, w) AS leaf, count(*) FILTER (side = 'm') AS mine, count(*) FILTER (side = 't') AS theirs,
  string_agg(place || c, ',' ORDER BY place) FILTER (side = 'm') AS a, string_agg(place || c, ',' ORDER BY place) FILTER (side = 't') AS b FROM p, z
GROUP BY 1, 2),
x AS (SELECT * FROM l WHERE a IS DISTINCT FROM b)
SELECT CASE WHEN mine > 0 THEN 'send' ELSE 'clear' END AS action, agent, leaf, mine, theirs, NULL::BIGINT AS o_orderkey FROM x
UNION ALL SELECT 'row', x.agent, x.leaf, NULL, NULL, k FROM x JOIN p ON p.agent = x.agent AND x.leaf = substr(place, 1, (SELECT w FROM z)) WHERE side = 'm'""")
def integrity_ranges(spark: SparkSession, d: str) -> DataFrame:
    """What an agent sends and what the other side clears, where rows were changed, lost and added on either side."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("agent"), F.concat_ws(":", "o_orderstatus", "o_orderpriority").alias("checksum"))
    mine = rows.filter("o_orderkey % 107 <> 0")
    changed = rows.filter("o_orderkey % 103 <> 0").withColumn("checksum", F.when(F.col("o_orderkey") % 101 == 0, "old").otherwise(F.col("checksum")))
    theirs = changed.unionByName(rows.filter("o_orderkey % 3 = 0").withColumn("agent", F.lit(9).cast("bigint")))
    depth = M.depth_for(max(mine.count(), theirs.count()), LEAF_ROWS)
    a, b = (M.build(x, ["agent"], ["o_orderkey"], depth=depth) for x in (mine, theirs))
    differ = M.descend(a, b)
    spans = M.ranges(differ).select("action", "agent", "leaf", "mine", "theirs", F.lit(None).cast("bigint").alias("o_orderkey"))
    sent = M.to_send(a, differ).withColumn("leaf", F.substring(M.place("o_orderkey"), 1, M.DIGITS * depth))
    nothing = F.lit(None).cast("bigint")
    return spans.unionByName(sent.select(F.lit("row").alias("action"), "agent", "leaf", nothing.alias("mine"), nothing.alias("theirs"), "o_orderkey"))


#: Queries by which the number of cells to look into is tuned.
TUNED_BY = 64


@query()
def vector_topk_index(spark: SparkSession, d: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 20 by the inverted file, with a recall of 0.95 over 64 of these queries.

    Tests measure the recall over all queries against the exact search. Vectors without clusters need most of the cells.
    """
    vectors = table(spark, d, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    index = V.build(vectors)
    probes = V.tuned_probes(index, vectors, asked.orderBy(F.xxhash64("query")).limit(TUNED_BY), 10)
    return V.search(index, asked, 10, probes).withColumn("similarity", F.round("similarity", 6))


PROCESS_SQL = """e AS (SELECT event_id AS id, user_id % 20 AS host, event_id % 53 AS pid, (event_id // 53 + user_id) % 61 AS ppid, ts, event_type ||
' ' || props AS message, row_number() OVER (ORDER BY ts, event_id) AS o FROM events),
l AS (SELECT c.id, p.id AS parent FROM e c ASOF LEFT JOIN e p ON c.host = p.host AND c.ppid = p.pid AND c.o > p.o),
t AS (SELECT id, id AS root, 1 AS depth FROM l WHERE parent IS NULL UNION ALL SELECT l.id, t.root, t.depth + 1 FROM l JOIN t ON l.parent = t.id)"""


def processes(spark: SparkSession, d: str) -> DataFrame:
    """The events as processes of twenty hosts with re-used numbers."""
    e = table(spark, d, "events")
    parent = (F.floor(F.col("event_id") / 53) + F.col("user_id")) % 61
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("host"), (F.col("event_id") % 53).alias("pid"), parent.alias("ppid"), "ts", F.concat("event_type", F.lit(" "), "props").alias("message"))


@query(f"WITH RECURSIVE {PROCESS_SQL} SELECT * FROM t")
def process_roots(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every process."""
    return T.roots(T.with_parents(processes(spark, d)))


@query(f"""WITH RECURSIVE {PROCESS_SQL}, g AS (SELECT root, min(host) AS host, count(*) AS process_count, max(depth) AS depth, min(ts) AS start,
bool_or(regexp_matches(lower(message), 'powershell|cmd|encoded|base64')) AS a,
  bool_or(regexp_matches(lower(message), 'privilege|escalation|sudo|su')) AS b, bool_or(regexp_matches(lower(message), 'injection|dll|process')) AS c,
bool_or(id % 7 = 0) AS u FROM t JOIN e USING (id) GROUP BY root)
SELECT root, process_count, depth, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, array_to_string(list_filter(['process_episode', CASE WHEN c THEN
'technique:T1055' END, CASE WHEN b THEN 'technique:T1068' END,
  CASE WHEN a::INT + b::INT + c::INT + u::INT > 2 THEN 'severity:high' WHEN a OR b OR c OR u THEN 'severity:medium' ELSE 'severity:low' END], lambda
x: x IS NOT NULL), ',') AS tags FROM g""")
def process_trees(spark: SparkSession, d: str) -> DataFrame:
    """An episode for each process tree, with its depth, indicators and tags."""
    out = T.tree_episodes(processes(spark, d), F.col("message"), F.col("id") % 7 == 0)
    return out.select("root", "process_count", "depth", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.array_join("tags", ",").alias("tags"))


@query("""WITH {alerts}, p AS (SELECT date_trunc('hour', ts) AS h, rule_id, level, count(*) AS n, count(*) FILTER (is_attack) AS a, count(*) FILTER
(rule_id = 'view') AS s, count(*) FILTER (value > 90) AS f FROM alerts GROUP BY 1, 2, 3)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, coalesce(string_agg(rule_id || '-' || level || '-' || a, ',' ORDER BY rule_id, level) FILTER (a > 0),
'') AS alerts, sum(a)::BIGINT AS total_alerts, sum(n)::BIGINT AS events, sum(s)::BIGINT AS syscheck, sum(f)::BIGINT AS firewall FROM p GROUP BY h""")
def hourly_statistics(spark: SparkSession, d: str) -> DataFrame:
    """All six fields of the hourly totals."""
    out = A.hourly_statistics(alerts(spark, d), F.col("is_attack"), F.col("rule_id") == "view", F.col("value") > 90)
    text = F.array_join(F.transform("alerts", lambda a: F.concat_ws("-", a["sigid"], a["level"], a["times"])), ",")
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), text.alias("alerts"), "total_alerts", "events", "syscheck", "firewall")
