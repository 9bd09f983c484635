"""Registered queries of the field functions and extraction jobs that the first set leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import mapping as M
from .functions import predicates as P
from .functions import transform as T
from .operators import extract as X
from .plans.alerts import table
from .registry import query

# predicates ------------------------------------------------------------------------------------


@query("""SELECT doc_id, lang IS NOT NULL AS there, lang IS NULL AS missing, coalesce(lang IN ('en', 'de'), false) AS is_key,
coalesce(source IN ('src1', 'src2'), false) AS listed FROM documents""")
def predicate_presence(spark: SparkSession, d: str) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    names = F.create_map(F.lit("en"), F.lit(1), F.lit("de"), F.lit(2))
    listed = P.keys_exist_in_list(F.when(source.isNotNull(), F.create_map(source, F.lit(1))), F.array(F.lit("src1"), F.lit("src2")))
    docs = table(spark, d, "documents")
    return docs.select("doc_id", P.exists(lang).alias("there"), P.not_exists(lang).alias("missing"), P.exists_key_in(lang, names).alias("is_key"), listed.alias("listed"))


KINDS = ("object", "array", "boolean", "number", "string")


@query("""WITH e AS (SELECT event_id, ['object', 'array', 'boolean', 'number', 'number', 'string', 'null'][event_id % 7 + 1] AS kind FROM events)
SELECT event_id, kind = 'object' AS is_object, kind = 'array' AS is_array, kind = 'boolean' AS is_boolean, kind = 'number' AS is_number, kind =
'string' AS is_string,
kind <> 'object' AS is_not_object, kind <> 'array' AS is_not_array, kind <> 'boolean' AS is_not_boolean, kind <> 'number' AS is_not_number, kind <>
'string' AS is_not_string,
kind = 'null' AS is_null, kind <> 'null' AS is_not_null FROM e""")
def predicate_types(spark: SparkSession, d: str) -> DataFrame:
    e, number = table(spark, d, "events"), F.col("event_id").cast("string")
    texts = (F.concat(F.lit('{"a":'), number, F.lit("}")), F.concat(F.lit("["), number, F.lit("]")), F.lit("true"), number, F.concat(number, F.lit(".5")), F.concat(F.lit('"'), number, F.lit('"')), F.lit("null"))
    v = F.parse_json(F.element_at(F.array(*texts), (F.col("event_id") % 7 + 1).cast("int")))
    names = [f"is_{k}" for k in KINDS] + [f"is_not_{k}" for k in KINDS] + ["is_null", "is_not_null"]
    return e.withColumn("v", v).select("event_id", *(getattr(P, n)(F.col("v")).alias(n) for n in names))


OPERATORS = {"equal": "=", "not_equal": "<>", "greater": ">", "greater_or_equal": ">=", "less": "<", "less_or_equal": "<="}


@query("SELECT event_id, " + ", ".join(f"round(value) {sign} 250 AS number_{op}, event_type {sign} 'purchase' AS string_{op}" for op, sign in OPERATORS.items()) + " FROM events")
def predicate_comparisons(spark: SparkSession, d: str) -> DataFrame:
    f, v, t = P.PREDICATES, F.round("value"), F.col("event_type")
    out = [x for op in OPERATORS for x in (f[f"number_{op}"](v, 250).alias(f"number_{op}"), f[f"string_{op}"](t, "purchase").alias(f"string_{op}"))]
    return table(spark, d, "events").select("event_id", *out)


@query("""WITH e AS (SELECT event_id, user_id % 4 AS k, user_id % 65536 AS g FROM events) SELECT event_id, k = 0 AND g < 32768 AS inside, k = 0 OR k =
1 AS six, k <> 1 AND k <> 2 AS public FROM e""")
def predicate_addresses_v6(spark: SparkSession, d: str) -> DataFrame:
    group = F.lower(F.hex(F.col("user_id") % 65536))
    ip = F.element_at(F.array(F.concat(F.lit("2001:db8:"), group, F.lit("::1")), F.concat(F.lit("fe80:0:0:0::"), group), F.concat(F.lit("10.1.2."), F.col("user_id") % 256), F.lit("8.8.8.8")), (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").withColumn("ip", ip).select("event_id", P.ip_cidr_match(F.col("ip"), "2001:db8::", "33").alias("inside"), P.is_ipv6(F.col("ip")).alias("six"), P.is_public_ip(F.col("ip")).alias("public"))


# mappings --------------------------------------------------------------------------------------
@query("""SELECT p_partkey, p_brand || coalesce(CASE WHEN p_size % 2 = 0 THEN p_type END, '') || p_size AS any_parts, p_name AS decoded,
array_to_string(string_split(p_type, ' '), '+') AS joined,
p_size::VARCHAR AS text, lower(replace(p_type, ' ', '_')) AS first_key, p_brand AS pair_value, p_name AS new_value, CASE WHEN p_size % 2 = 0 THEN
p_brand END AS old_value FROM part""")
def mapping_text(spark: SparkSession, d: str) -> DataFrame:
    b, t, n, size = (F.col(c) for c in ("p_brand", "p_type", "p_name", "p_size"))
    objects = F.array(F.struct(t.alias("k"), F.lit("lost").alias("v"), F.lit("x").alias("o")), F.struct(t.alias("k"), b.alias("v"), F.when(size % 2 == 0, b).otherwise("").alias("o")))
    pairs = F.array(F.struct(t.alias("k"), n.alias("v"), F.when(size % 2 == 0, b).otherwise("").alias("o")))
    rows = table(spark, d, "part").withColumns({"m": M.array_obj_to_map_kv(objects, "k", "v"), "n": M.array_extract_key_obj(pairs, "k", "v", "o")})
    key = F.map_keys("m")[0]
    return rows.select("p_partkey", M.concat_any(b, F.when(size % 2 == 0, t), size).alias("any_parts"), M.decode_base16(F.hex(F.encode(n, "UTF-8"))).alias("decoded"), M.join(F.split(t, " "), "+").alias("joined"), M.to_string(size).alias("text"), key.alias("first_key"), F.col("m")[key].alias("pair_value"), F.col("n")[key]["new"].alias("new_value"), F.col("n")[key]["old"].alias("old_value"))


@query("""WITH e AS (SELECT event_id, [1, 6, 17, 47, 50, 58, 132][user_id % 7 + 1] AS code, ['icmp', 'tcp', 'udp', 'gre', 'esp', 'ipv6-icmp',
'sctp'][user_id % 7 + 1] AS name, user_id FROM events)
SELECT event_id, name, code::VARCHAR AS number, CASE WHEN user_id % 3 = 0 THEN 'IPv4' WHEN user_id % 3 = 1 THEN 'IPv6' END AS version FROM e""")
def mapping_protocols(spark: SparkSession, d: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, (1, 6, 17, 47, 50, 58, 132))), (F.col("user_id") % 7 + 1).cast("int"))
    ip = F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("10.0.0."), F.col("user_id") % 256)).when(F.col("user_id") % 3 == 1, F.concat(F.lit("fd00::"), F.hex(F.col("user_id") % 65536))).otherwise("none")
    name = M.iana_protocol_number_to_name(code)
    return table(spark, d, "events").select("event_id", name.alias("name"), M.iana_protocol_name_to_number(F.upper(name)).alias("number"), M.ip_version(ip).alias("version"))


@query("""WITH e AS (SELECT event_id, user_id % 200 AS s, event_id % 200 AS t, 1024 + user_id % 60000 AS a, 80 + event_id % 1000 AS b FROM events),
o AS (SELECT *, s < t OR (s = t AND a <= b) AS fwd FROM e), h AS (SELECT event_id, CASE WHEN fwd THEN s ELSE t END AS s, CASE WHEN fwd THEN t ELSE s
END AS t, CASE WHEN fwd THEN a ELSE b END AS a, CASE WHEN fwd THEN b ELSE a END AS b FROM o)
SELECT event_id, '1:' || to_base64(unhex(sha1(unhex(printf('00000a0000%02x0a0000%02x0600%04x%04x', s, t, a, b))))) AS community FROM h""")
def mapping_community_id(spark: SparkSession, d: str) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    one = M.network_community_id(F.concat(F.lit("10.0.0."), u % 200), F.concat(F.lit("10.0.0."), e % 200), 1024 + u % 60000, 80 + e % 1000, F.lit(6))
    return table(spark, d, "events").select("event_id", one.alias("community"))


@query("SELECT event_id, true AS is_late, 20 AS n_chars FROM events")
def mapping_clock(spark: SparkSession, d: str) -> DataFrame:
    """The clock's functions: their form, and that they are later than every event."""
    rows = table(spark, d, "events")
    return rows.select("event_id", (M.system_epoch() > F.unix_seconds(F.col("ts").cast("timestamp"))).alias("is_late"), F.length(M.get_date()).alias("n_chars"))


# transforms ------------------------------------------------------------------------------------
@query("""SELECT event_id, concat_ws(',', event_type, CASE WHEN user_id % 2 = 0 THEN 'even' END, 'x') AS added, CASE WHEN event_type = 'click' THEN
'click,x' ELSE event_type || ',click,x' END AS once,
CASE WHEN user_id % 2 = 0 THEN 1 ELSE 2 END AS n_left, event_type AS kept, 'inner' AS merged, event_type AS under, 'deep' AS deep, event_type AS
clean, event_type AS renamed FROM events""")
def transform_more(spark: SparkSession, d: str) -> DataFrame:
    kind, u = F.col("event_type"), F.col("user_id")
    m = F.create_map(F.lit("kind"), kind, F.lit("custom"), F.lit("c"))
    other = F.create_map(F.lit("wanted"), F.create_map(F.lit("custom"), F.lit("inner")))
    deep = F.create_map(F.lit("a"), m)
    deep_other = F.create_map(F.lit("wanted"), F.create_map(F.lit("a"), F.create_map(F.lit("custom"), F.lit("deep"))))
    rows = T.rename(table(spark, d, "events").withColumn("moved", kind), "moved", "renamed")
    recursive = T.merge_recursive_key_in(deep, deep_other, "wanted")["a"]
    return rows.select(
        "event_id",
        F.array_join(T.array_append_any(F.array(kind), F.when(u % 2 == 0, "even"), "x"), ",").alias("added"),
        F.array_join(T.array_append_unique_any(F.array(kind), "click", F.lit(None).cast("string"), "x"), ",").alias("once"),
        F.when(u % 2 == 0, F.size(T.delete_key(m, "custom"))).otherwise(F.size(m)).alias("n_left"),
        T.erase_custom_fields(m, ["kind"])["kind"].alias("kept"),
        T.merge_key_in(m, other, "wanted")["custom"].alias("merged"),
        recursive["kind"].alias("under"),
        recursive["custom"].alias("deep"),
        T.sanitize_fields(F.create_map(F.lit(" Event Type! "), kind))["event_type"].alias("clean"),
        "renamed",
    )


# extraction ------------------------------------------------------------------------------------
@query("""SELECT p_partkey, p_size AS size, p_brand AS brand, p_size AS said FROM part""")
def xml_extract(spark: SparkSession, d: str) -> DataFrame:
    event = F.format_string("<Event><System><EventID>%d</EventID></System><EventData><Data Name='Brand'>%s</Data><Data Name='Size'>%d</Data></EventData></Event>", F.col("p_size"), "p_brand", F.col("p_size"))
    rows = table(spark, d, "part").select("p_partkey", event.alias("raw"))
    out = X.xml_extract_job(rows, "raw", "System struct<EventID:int>")
    data = X.event_data_map(F.col("raw"))
    return out.select("p_partkey", F.col("extracted.System.EventID").alias("size"), data["Brand"].alias("brand"), data["Size"].cast("int").alias("said"))


@query("""SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS seconds, o_orderkey % 3 < 2 AS fits FROM orders WHERE o_orderkey % 3 < 2 UNION ALL SELECT
o_orderkey, NULL, false FROM orders WHERE o_orderkey % 3 = 2""")
def timestamp_extract(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format(day, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(day, "dd/MMM/yyyy:HH:mm:ss")).otherwise("soon")
    out = X.timestamp_extract_job(table(spark, d, "orders").select("o_orderkey", raw.alias("raw")), "raw", ["yyyy-MM-dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss"])
    return out.select("o_orderkey", F.unix_seconds("extracted").alias("seconds"), "fits")


@query("""SELECT page_id, page_id % 2 = 0 AS domain, page_id % 3 > 0 AS ip, page_id % 2 = 1 AS base64, 'x' || page_id AS between, 'a"' || page_id AS
quoted, '/srv/www' AS directory, 'p' || page_id || '.html' AS name, 'html' AS extension FROM pages""")
def validity_jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    raws = {
        "domain": F.concat(F.lit("host-"), k, F.when(k % 2 == 0, ".example.org").otherwise("_.example..org")),
        "ip": F.when(k % 3 == 0, "1.2.3").when(k % 3 == 1, F.concat(F.lit("10.0.0."), k % 256)).otherwise(F.concat(F.lit("fd00::"), k % 10000)),
        "base64": F.when(k % 2 == 1, F.base64(F.encode(k.cast("string"), "UTF-8"))).otherwise("?*"),
        "between": F.concat(F.lit("<<x"), k, F.lit(">>")),
        "quoted": F.concat(F.lit('"a\\"'), k, F.lit('" rest')),
        "path": F.concat(F.lit("/srv/www/p"), k, F.lit(".html")),
    }
    rows = table(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in raws.items()))

    def run(df: DataFrame, name: str, job, value: str | None, *args) -> DataFrame:
        out = job(df, name, *args)
        return out.withColumn(f"{name}_", F.col("fits") if value is None else F.col(value)).drop("extracted", "fits")

    for name, job in (("domain", X.domain_validity_job), ("ip", X.ip_validity_job), ("base64", X.base64_validity_job)):
        rows = run(rows, name, job, None)
    rows = run(rows, "between", X.between_extract_job, "extracted", "<<", ">>")
    rows = run(rows, "quoted", X.quoted_extract_job, "extracted")
    rows = run(rows, "path", X.path_extract_job, "extracted")
    return rows.select("page_id", *(F.col(f"{n}_").alias(n) for n in ("domain", "ip", "base64", "between", "quoted")), *(F.col(f"path_.{n}").alias(n) for n in ("directory", "name", "extension")))
