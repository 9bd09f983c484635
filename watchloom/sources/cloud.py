"""Landed cloud files: flow logs, load balancers, firewalls, findings, audit records, blobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.mapping import date_from_epoch
from . import records


def _strings(names: str) -> str:
    return ", ".join(f"{n} string" for n in names.split())


#: Column names of the formats, in file order.
FLOW = "version account_id interface_id srcaddr dstaddr srcport dstport protocol packets bytes start end action log_status"
APP_LB = "type time elb client_port target_port request_processing_time target_processing_time response_processing_time elb_status_code target_status_code received_bytes sent_bytes request user_agent ssl_cipher ssl_protocol target_group_arn trace_id domain_name chosen_cert_arn matched_rule_priority request_creation_time action_executed redirect_url error_reason target_port_list target_status_code_list classification classification_reason"
CLASSIC_LB = "time elb client_port backend_port request_processing_time backend_processing_time response_processing_time elb_status_code backend_status_code received_bytes sent_bytes request user_agent ssl_cipher ssl_protocol"
NETWORK_LB = "type version time elb listener client_port destination_port connection_time tls_handshake_time received_bytes sent_bytes incoming_tls_alert chosen_cert_arn chosen_cert_serial tls_cipher tls_protocol_version tls_named_group domain_name alpn_fe_protocol alpn_client_preference_list"
DNS = "timestamp most_granular_identity identities internal_ip external_ip action query_type response_code domain categories most_granular_identity_type identity_types blocked_categories"
PROXY = "timestamp identities internal_ip external_ip destination_ip content_type verdict url referer user_agent status_code requested_size response_size response_body_size sha categories av_detections puas amp_disposition amp_malware_name amp_score identity_type blocked_categories"
IP_LOG = "timestamp identity source_ip source_port destination_ip destination_port categories"
ACCESS = "bucket_owner bucket time remote_ip requester request_id operation key request_uri http_status error_code bytes_sent object_size total_time turn_around_time referer user_agent version_id host_id signature_version cipher_suite authentication_type host_header tls_version"


def _address(c: str, k: int) -> Column:
    """Part 1 (address) or 2 (port) of ip:port; a value without a colon is the address."""
    return F.when(F.col(c).contains(":"), F.split_part(c, F.lit(":"), F.lit(k))).otherwise(F.col(c) if k == 1 else F.lit(None))


def flow_log_source(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(_strings(FLOW)).csv(path, sep=" ").filter("version rlike '^[0-9]+$'")
    iso = [date_from_epoch(F.col(c)).alias(c) for c in ("start", "end")]
    return rows.select(*[c for c in FLOW.split() if c not in ("start", "end")], *iso)


def _ports(rows: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        base = c.removesuffix("_port")
        rows = rows.withColumns({f"{base}_ip": _address(c, 1), c: _address(c, 2)})
    return rows


def app_lb_log_source(spark: SparkSession, path: str) -> DataFrame:
    rows = _ports(spark.read.schema(_strings(APP_LB)).csv(path, sep=" ", quote='"'), ["client_port", "target_port"])
    pairs = F.split("target_port_list", " ")
    return rows.withColumns({"target_ip_list": F.array_join(F.transform(pairs, lambda x: F.split_part(x, F.lit(":"), F.lit(1))), " "), "target_port_list": F.array_join(F.transform(pairs, lambda x: F.split_part(x, F.lit(":"), F.lit(2))), " ")})


def classic_lb_log_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_strings(CLASSIC_LB)).csv(path, sep=" ", quote='"')


def network_lb_log_source(spark: SparkSession, path: str) -> DataFrame:
    return _ports(spark.read.schema(_strings(NETWORK_LB)).csv(path, sep=" ", quote='"'), ["client_port", "destination_port"])


#: Request headers that are kept.
HEADERS = ("accept", "accept-encoding", "accept-language", "host", "origin", "referer", "user-agent", "x-forwarded-for")


def firewall_json_source(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Several JSON objects may share a line; headers (array of name, value) become a map of the allowed names.

    Texts that don't have the structure are dropped.
    """
    objects = F.explode(F.split("value", r"(?<=\})\s*(?=\{\"timestamp\")"))
    rows = spark.read.text(path).select(objects.alias("v")).filter(F.try_parse_json("v").isNotNull()).select(F.from_json("v", schema).alias("e")).select("e.*")
    named = F.transform("httpRequest.headers", lambda h: F.struct(F.lower(h["name"]).alias("key"), h["value"].alias("value")))
    once = F.filter(named, lambda e, i: e["key"].isin(*HEADERS) & ~F.exists(F.slice(named, i + 2, F.greatest(F.size(named) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return rows.withColumn("headers", F.map_from_entries(once)).filter("httpRequest is not null")


def dns_security_log_source(spark: SparkSession, path: str) -> DataFrame:
    """Three layouts by path: dnslogs, proxylogs, iplogs. kind tells which; missing columns are null."""
    parts = []
    for kind, names in (("dnslogs", DNS), ("proxylogs", PROXY), ("iplogs", IP_LOG)):
        rows = spark.read.option("recursiveFileLookup", True).schema(_strings(names)).csv(path).withColumn("file", F.col("_metadata.file_path"))
        parts.append(rows.filter(F.col("file").contains(f"/{kind}")).withColumn("kind", F.lit(kind)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def object_access_log_source(spark: SparkSession, path: str) -> DataFrame:
    """24 fields split at spaces; [...], "..." and '...' hold together."""
    fields = F.regexp_extract_all("value", F.lit(r"""(\[[^\]]*\]|"[^"]*"|'[^']*'|\S+)"""), F.lit(1))
    clean = F.transform(fields, lambda x: F.regexp_replace(x, r"""^[\["']|[\]"']$""", ""))
    return spark.read.text(path).filter("value <> ''").select(clean.alias("f")).select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(ACCESS.split())))


def findings_jsonl_source(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("source", F.lower("service.serviceName"))


def probe_detail_explode(findings: DataFrame, details: str = "service.action.portProbeAction.portProbeDetails") -> DataFrame:
    """One row for each probe detail; findings without details stay as they are."""
    return findings.withColumn("probe_detail", F.explode_outer(details))


def coerced_list(v: Column, key: str) -> Column:
    """A variant that may be a text, a list or an object, as an array of texts (of list elements or of the object's key)."""
    kind = F.schema_of_variant(v)
    as_list = F.try_variant_get(v, "$", "array<string>")
    in_object = F.try_variant_get(v, f"$.{key}", "string")
    return F.when(kind.startswith("ARRAY"), as_list).when(kind.startswith("OBJECT"), F.array_compact(F.array(in_object))).when(kind == "VOID", F.lit(None)).otherwise(F.array(F.try_variant_get(v, "$", "string")))


def config_history_source(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """JSON lines; each of the given configuration fields (field → key of the object form) comes as an array of texts."""
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("v")).filter("v is not null")
    fields = [coerced_list(F.try_variant_get("v", f"$.configuration.{f}", "variant"), k).alias(f) for f, k in keys.items()]
    return rows.select(F.try_variant_get("v", "$.resourceId", "string").alias("resource_id"), F.try_variant_get("v", "$.configurationItemCaptureTime", "string").alias("captured"), *fields)


def audit_trail_source(spark: SparkSession, path: str) -> DataFrame:
    """records; requestParameters and responseElements that are plain text are wrapped as {"string": text}."""
    files = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.Records", "array<variant>")).alias("r"))

    def wrapped(field: str) -> Column:
        v = F.try_variant_get("r", f"$.{field}", "variant")
        return F.when(F.schema_of_variant(v) == "STRING", F.to_json(F.struct(F.try_variant_get(v, "$", "string").alias("string")))).otherwise(F.to_json(v)).alias(field)

    return files.select(*(F.try_variant_get("r", f"$.{f}", "string").alias(f) for f in ("eventName", "eventSource", "eventTime", "awsRegion", "sourceIPAddress")), wrapped("requestParameters"), wrapped("responseElements"))


def auto_format_source(spark: SparkSession, path: str) -> DataFrame:
    """file, kind, record: JSON lines, CSV with a header that has no digit (record is a JSON object of its columns), else plain text.

    The first line of each file decides; files of any size are read in ranges.
    """
    records.register(spark)
    return spark.read.format(records.NAME).option("path", path).option("kind", "auto").load().select("file", "kind", "record")


def lake_parquet_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


HUB = "id string, `detail-type` string, source string, account string, time string, region string, detail struct<findings:array<string>>"


def hub_findings_source(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(HUB).option("mode", "DROPMALFORMED").json(path)
    return rows.select(F.col("detail-type").alias("detail_type"), "id", "source", "account", "time", "region", F.get("detail.findings", F.lit(0)).alias("finding"))


def log_stream_range_source(events: DataFrame, stream: str, start_ms: int, end_ms: int, discard: str | None = None, field: str | None = None) -> DataFrame:
    """events: stream, ts_ms, message. Those of one stream in [start, end); discard is matched with a JSON field or the raw text."""
    hits = events.filter((F.col("stream") == stream) & (F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    if discard is None:
        return hits
    target = F.get_json_object("message", f"$.{field}") if field else F.col("message")
    return hits.filter(~F.coalesce(target.rlike(discard), F.lit(False)))


def scan_findings_source(findings: DataFrame, last_scan: str, created: str = "createdAt") -> DataFrame:
    return findings.filter(F.col(created) > F.lit(last_scan).cast("timestamp"))


def gcs_access_log_source(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').csv(path)


def blob_records_source(spark: SparkSession, path: str, mode: str, tag: str, extension: str | None = None) -> DataFrame:
    """record, tag. mode: json_file (a records array), json_inline (JSON by line) or text. Empty blobs and other extensions are skipped."""
    whole = mode == "json_file"
    rows = spark.read.text(path, wholetext=whole).withColumns({"file": F.col("_metadata.file_path"), "size": F.col("_metadata.file_size")}).filter("size > 0 and value <> ''")
    if extension:
        rows = rows.filter(F.col("file").endswith(extension))
    if whole:
        rows = rows.select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$.records", "array<variant>")).alias("r")).select(F.to_json("r").alias("record"))
    elif mode == "json_inline":
        rows = rows.filter(F.try_parse_json("value").isNotNull()).select(F.col("value").alias("record"))
    else:
        rows = rows.select(F.col("value").alias("record"))
    return rows.withColumn("tag", F.lit(tag))


def columnar_rows_source(spark: SparkSession, path: str, by_line: bool = False) -> DataFrame:
    """tables[].columns[] and rows[][] as a map for each row. A file is one answer, or with by_line each of its lines is."""
    schema = "tables array<struct<name:string,columns:array<struct<name:string,type:string>>,rows:array<array<string>>>>"
    tables = spark.read.schema(schema).option("multiLine", not by_line).json(path).select(F.explode("tables").alias("t"))
    return tables.select(F.col("t.name").alias("table"), F.col("t.columns.name").alias("names"), F.explode("t.rows").alias("row")).select("table", F.map_from_arrays("names", "row").alias("record"))


EPISODE = "episode_id string, episode_type string, source string, tags array<string>, summary string, entities map<string,array<string>>"


def attack_kb_source(spark: SparkSession, path: str) -> DataFrame:
    """Techniques (id, name, description, tactics) as episodes."""
    rows = spark.read.schema("id string, name string, description string, tactics array<string>").option("multiLine", True).json(path)
    return rows.select(F.concat(F.lit("ATTACK-"), "id").alias("episode_id"), F.lit("attack").alias("episode_type"), F.lit("attack_kb").alias("source"), F.coalesce("tactics", F.array().cast("array<string>")).alias("tags"), F.concat_ws(": ", "name", "description").alias("summary"), F.create_map(F.lit("technique"), F.array("id")).alias("entities"))


def yara_kb_source(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("name string, description string, tags array<string>, strings array<string>").option("multiLine", True).json(path)
    return rows.select(F.concat(F.lit("YARA-"), "name").alias("episode_id"), F.lit("yara").alias("episode_type"), F.lit("yara_kb").alias("source"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.concat_ws(": ", "name", "description").alias("summary"), F.create_map(F.lit("string"), F.coalesce("strings", F.array().cast("array<string>"))).alias("entities"))


def advisory_kb_source(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("id string, title string, severity string, cves array<string>").option("multiLine", True).json(path)
    return rows.select(F.concat(F.lit("ADV-"), "id").alias("episode_id"), F.lit("advisory").alias("episode_type"), F.lit("advisory_kb").alias("source"), F.array_compact(F.array(F.lower("severity"))).alias("tags"), F.col("title").alias("summary"), F.create_map(F.lit("cve"), F.coalesce("cves", F.array().cast("array<string>"))).alias("entities"))


FRAMEWORKS = ("pci_dss", "gdpr", "hipaa", "nist_800_53", "gpg13", "tsc", "mitre")


def rule_catalog_source(spark: SparkSession, path: str) -> DataFrame:
    """Rules; groups with a framework's prefix (pci_dss_10.2.5) go to that framework's array."""
    rows = spark.read.schema("id int, level int, description string, status string, filename string, groups array<string>").json(path)
    plain = F.filter("groups", lambda g: ~g.rlike(f"^({'|'.join(FRAMEWORKS)})_"))
    return rows.select("id", "level", "description", "status", "filename", plain.alias("groups"), *map(_tagged, FRAMEWORKS))


def _tagged(framework: str) -> Column:
    own = F.filter("groups", lambda g: g.startswith(f"{framework}_"))
    return F.transform(own, lambda g: F.substring(g, F.lit(len(framework) + 2), F.length(g))).alias(framework)
