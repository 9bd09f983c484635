"""Filters, routing and projections over alerts and state tables."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mapping import date_from_epoch
from ..functions.predicates import IPV4, IPV6, sure


def check_list(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """All conditions hold; an empty list is an error."""
    if not conditions:
        raise ValueError("a check needs a condition")
    return df.filter(reduce(and_, map(sure, conditions)))


def check_expression(df: DataFrame, text: str) -> DataFrame:
    """A boolean SQL text; unknown is false."""
    return df.filter(sure(F.expr(text)))


def discard_regex(df: DataFrame, field: Column, pattern: str, is_array: bool = False) -> DataFrame:
    """Drops rows in which a value of the field matches; rows without the field stay."""
    hit = F.exists(field, lambda x: x.rlike(pattern)) if is_array else field.rlike(pattern)
    return df.filter(~sure(hit))


def value_equals(field: Column, value) -> Column:
    return sure(field == F.lit(value))


def field_equals_field(a: Column, b: Column) -> Column:
    return sure(a == b)


def route_by_priority(routes: list[tuple[str, Column]]) -> Column:
    """Name of the first route whose filter holds, else unrouted."""
    return F.coalesce(*(F.when(sure(p), F.lit(name)) for name, p in routes), F.lit("unrouted"))


def decoder_tree(tree: list[tuple[str, Column, list]]) -> Column:
    """Path of decoders as an array: the first child whose condition holds, then its children."""
    out = F.array().cast("array<string>")
    for name, condition, children in reversed(tree):
        below = decoder_tree(children) if children else F.array().cast("array<string>")
        out = F.when(sure(condition), F.concat(F.array(F.lit(name)), below)).otherwise(out)
    return out


def rule_broadcast(rules: list[tuple[str, Column]]) -> Column:
    """Names of all rules that hold."""
    return F.array_compact(F.array(*(F.when(sure(p), F.lit(name)) for name, p in rules)))


def condition_then_stages(condition: Column, **stages: Column) -> Column:
    return F.when(sure(condition), F.struct(*(c.alias(n) for n, c in stages.items())))


def keep_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds; all rows if there is none."""
    found = df.agg(F.count_if(sure(condition)).alias("__hits"))
    return df.crossJoin(F.broadcast(found)).filter(sure(condition) | (F.col("__hits") == 0)).drop("__hits")


def day_filter_with_fallback(df: DataFrame, timestamp_text: Column, day: str) -> DataFrame:
    return keep_or_all(df, timestamp_text.contains(day))


#: Fixed values of the attack classifier.
ATTACK_RULE_IDS = ("5503", "5710", "5760", "5758", "5712", "5720", "2502")
ATTACK_KEYWORDS = ("failed", "denied", "invalid", "non-existent", "brute force", "authentication_failed", "invalid_login", "authentication_failures", "multiple failed", "error", "attack", "exploit")
ATTACK_GROUPS = ("authentication_failed", "invalid_login", "attack", "exploit")


def attack_classifier(rule_id: Column, level: Column, description: Column, groups: Column, techniques: Column) -> Column:
    words = F.lower(description).rlike("|".join(k.replace(" ", r"\x20") for k in ATTACK_KEYWORDS))
    overlap = F.arrays_overlap(groups, F.array(*map(F.lit, ATTACK_GROUPS)))
    return reduce(or_, map(sure, (rule_id.isin(*ATTACK_RULE_IDS), level >= 8, words, overlap, F.size(techniques) > 0)))


def text_search(df: DataFrame, text: str, columns: list[str] | None = None, complementary: bool = False) -> DataFrame:
    hit = reduce(or_, (sure(F.col(c).cast("string").contains(text)) for c in columns or df.columns))
    return df.filter(~hit if complementary else hit)


def field_query(df: DataFrame, **values) -> DataFrame:
    return check_list(df, [F.col(c) == F.lit(v) for c, v in values.items()])


def catalog_filters(df: DataFrame, ids: list | None = None, level: tuple[int, int] | int | None = None, group: str | None = None, status: str | None = None, filename: str | None = None, tags: dict[str, str] | None = None) -> DataFrame:
    """Filters of a rule catalogue with id, level, groups, status, filename and tag arrays."""
    conditions = [F.lit(True)]
    if ids is not None:
        conditions.append(F.col("id").isin(*ids))
    if level is not None:
        low, high = level if isinstance(level, tuple) else (level, level)
        conditions.append(F.col("level").between(low, high))
    if group is not None:
        conditions.append(F.array_contains("groups", group))
    conditions += [F.col(c) == v for c, v in (("status", status), ("filename", filename)) if v is not None]
    conditions += [F.array_contains(c, v) for c, v in (tags or {}).items()]
    return check_list(df, conditions)


def ilike_search(df: DataFrame, query: str, columns: list[str], newest: str, limit: int, **equal) -> DataFrame:
    """The newest rows with the text in one of the columns; of equally new ones the least by the columns."""
    hit = reduce(or_, (sure(F.col(c).ilike(f"%{query}%")) for c in columns))
    return check_list(df, [hit, *(F.col(c) == v for c, v in equal.items())]).orderBy(F.desc(newest), *columns).limit(limit)


def ioc_search(df: DataFrame, kind: str, value: str, limit: int = 50) -> DataFrame:
    return ilike_search(df, value, ["value"], "first_seen", limit, type=kind)


def episode_search(df: DataFrame, kind: str | None = None, tags: list[str] = (), since=None, until=None) -> DataFrame:
    conditions = [F.lit(True), *(F.array_contains("tags", t) for t in tags)]
    if kind is not None:
        conditions.append(F.col("episode_type") == kind)
    if since is not None:
        conditions.append(F.col("time_range.start") >= since)
    if until is not None:
        conditions.append(F.col("time_range.end") <= until)
    return check_list(df, conditions)


def metadata_prefilter(df: DataFrame, entities: Column | None = None, tags: Column | None = None, window: Column | None = None) -> DataFrame:
    """Conditions that were given are joined by AND; without any hit all rows pass."""
    given = [c for c in (entities, tags, window) if c is not None]
    return keep_or_all(df, reduce(and_, map(sure, given))) if given else df


def severity_threshold(df: DataFrame, score: str, least: float = 70) -> DataFrame:
    return df.filter(F.col(score) >= least)


def stale_agent_filter(df: DataFrame, as_of: Column, limit_seconds: int) -> DataFrame:
    return df.filter((F.col("status") == "disconnected") & (F.unix_seconds("last_keepalive") < F.unix_seconds(as_of) - limit_seconds))


#: Declared type → (Spark type to try, pattern the text must have).
CHECKS = {
    "boolean": ("boolean", "^(true|false)$"),
    "byte": ("tinyint", r"^-?\d+$"),
    "short": ("smallint", r"^-?\d+$"),
    "integer": ("int", r"^-?\d+$"),
    "long": ("bigint", r"^-?\d+$"),
    "float": ("float", None),
    "double": ("double", None),
    "keyword": ("string", None),
    "date": ("timestamp", r"^\d{4}-\d{2}-\d{2}"),
    "ip": ("string", f"{IPV4}|{IPV6}"),
    "binary": ("string", r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"),
    "object": ("string", r"^\s*\{"),
}


def schema_conformance(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Adds violations: names of fields whose value doesn't fit the declared type. Empty means valid."""
    bad = []
    for name, kind in declared.items():
        target, pattern = CHECKS[kind]
        text = F.col(name).cast("string")
        fits = text.try_cast(target).isNotNull() & (text.rlike(pattern) if pattern else F.lit(True))
        bad.append(F.when(text.isNotNull() & ~fits, F.lit(name)))
    return df.withColumn("violations", F.array_compact(F.array(*bad)))


def task_query(tasks: DataFrame, agents: list[int] | None = None, ids: list[int] | None = None, status: str | None = None, module: str | None = None, offset: int = 0, limit: int = 500) -> DataFrame:
    conditions = [F.lit(True)]
    conditions += [F.col(c).isin(*v) for c, v in (("agent_id", agents), ("task_id", ids)) if v is not None]
    conditions += [F.col(c) == v for c, v in (("status", status), ("module", module)) if v is not None]
    out = check_list(tasks, conditions)
    iso = [date_from_epoch(F.col(c)).alias(c) for c in ("create_time", "last_update_time")]
    rest = [c for c in tasks.columns if c not in ("create_time", "last_update_time", "agent_id")]
    agent = F.col("agent_id").cast("string")
    return out.orderBy("task_id").offset(offset).limit(limit).select(F.lpad(agent, F.greatest(F.lit(3), F.length(agent)), F.lit("0")).alias("agent_id"), *rest, *iso)


def file_state_search(files: DataFrame, like: str | None = None, inode: int | None = None, device: int | None = None) -> DataFrame:
    hit = F.col("path").like(like) if like is not None else (F.col("inode") == inode) & (F.col("device") == device)
    return files.filter(hit).select("path")


def select_fields(df: DataFrame, fields: list[str], required: list[str] = ()) -> DataFrame:
    names = dict.fromkeys([*required, *fields])
    return df.select(*(F.col(n).alias(n.replace(".", "_")) for n in names))


def distinct_rows(df: DataFrame, fields: list[str]) -> DataFrame:
    return select_fields(df, fields).distinct()


def threat_description(agent_name: Column, message: Column) -> Column:
    return F.concat(F.lit("Event from "), F.coalesce(agent_name, F.lit("unknown")), F.lit(": "), F.substring(F.coalesce(message, F.lit("")), 1, 200))


def searchable_text(description: Column, level: Column, rule_id: Column, groups: Column, mitre: Column, log: Column, data: Column, agent_name: Column) -> Column:
    pairs = F.array_join(F.transform(F.map_entries(data), lambda e: F.concat_ws(":", e["key"], e["value"])), " ")
    return F.lower(F.concat_ws(" ", description, F.concat(F.lit("level:"), level), F.concat(F.lit("rule:"), rule_id), F.array_join(groups, " "), F.array_join(mitre, " "), log, pairs, agent_name))


def keyed_normalizer(df: DataFrame, dictionary: list[dict]) -> DataFrame:
    """Entries: find_field, find_pattern, and replace_field / replace_pattern / replace_value or add_field / add_value."""
    for e in dictionary:
        hit = sure(F.col(e["find_field"]).rlike(e["find_pattern"]))
        if "replace_field" in e:
            field = F.col(e["replace_field"])
            df = df.withColumn(e["replace_field"], F.when(hit, F.regexp_replace(field, e["replace_pattern"], e["replace_value"])).otherwise(field))
        if "add_field" in e:
            old = F.col(e["add_field"]) if e["add_field"] in df.columns else F.lit(None).cast("string")
            df = df.withColumn(e["add_field"], F.when(hit, F.lit(e["add_value"])).otherwise(old))
    return df


def vulnerability_document(found: DataFrame) -> DataFrame:
    """Nested document of a finding: cve, agent_id, item, version, severity, score, description."""
    scored = F.coalesce(F.col("score"), F.lit(0.0)) >= 0.01
    severity = F.when(F.length(F.trim("severity")) > 0, F.initcap("severity")).otherwise("-")
    vulnerability = F.struct(F.col("cve").alias("id"), severity.alias("severity"), F.struct(F.when(scored, F.round("score", 2)).alias("base"), F.lit("CVSS").alias("classification")).alias("score"), F.coalesce("description", F.lit("-")).alias("description"), (~scored | (severity == "-")).alias("under_evaluation"))
    return found.select(F.struct(F.col("agent_id").alias("id")).alias("agent"), F.struct(F.col("item").alias("name"), F.col("version")).alias("package"), vulnerability.alias("vulnerability"))
