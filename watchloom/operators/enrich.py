"""Lookups and joins. Sizes of lookup tables are left to Spark, which broadcasts what is known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import address_hex, bit_text, hex_number, ip_number
from ..functions.transform import merge, merge_recursive


def lookup_exists(df: DataFrame, kv: DataFrame, field: str) -> DataFrame:
    """kv: key, value. Rows whose field is a key."""
    return df.join(kv.select(F.col("key").alias(field)), field, "left_semi")


def lookup_absent(df: DataFrame, kv: DataFrame, field: str) -> DataFrame:
    """Rows whose field is there and not a key."""
    return df.filter(F.col(field).isNotNull()).join(kv.select(F.col("key").alias(field)), field, "left_anti")


def _found(df: DataFrame, kv: DataFrame, field: str) -> DataFrame:
    return df.join(kv.select(F.col("key").alias("__key"), F.col("value").alias("__value")), F.col(field) == F.col("__key"), "left").drop("__key")


def lookup_value(df: DataFrame, kv: DataFrame, field: str, target: str) -> DataFrame:
    """target = value of the key; kept as it was where the key is absent."""
    old = F.col(target) if target in df.columns else F.lit(None)
    return _found(df, kv, field).withColumn(target, F.coalesce("__value", old)).drop("__value")


def lookup_merge(df: DataFrame, kv: DataFrame, field: str, target: str, recursive: bool = False) -> DataFrame:
    """Merges the key's map into target; recursive for maps of maps."""
    return _found(df, kv, field).withColumn(target, (merge_recursive if recursive else merge)(F.col(target), F.col("__value"))).drop("__value")


def _by_list(df: DataFrame, source: str, each: DataFrame, item: Column, target: str) -> DataFrame:
    """target = the items of a list in their order. each: a row for each entry of each distinct list, with __list and __pos."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("__pos", item.alias("item")))), lambda x: x["item"])
    lists = each.groupBy("__list").agg(items.alias("__items"))
    out = df.drop(target) if target != source else df
    return out.join(lists, F.col(source) == F.col("__list"), "left").drop("__list").withColumn(target, F.col("__items")).drop("__items")


def _entries(df: DataFrame, source: str, name: str) -> DataFrame:
    """__list, __pos and the entries of each distinct list: equal lists are looked up once, whichever rows hold them."""
    return df.select(F.col(source).alias("__list")).distinct().select("__list", F.posexplode("__list").alias("__pos", name))


def lookup_array(df: DataFrame, kv: DataFrame, keys: str, target: str) -> DataFrame:
    """target = values of the keys that are found, in their order; rows without a hit get null."""
    hits = _entries(df, keys, "key").join(kv.select("key", F.col("value").alias("__value")), "key")
    return _by_list(df, keys, hits, F.col("__value"), target)


def lookup_bitmask(df: DataFrame, bits: DataFrame, mask: str, target: str) -> DataFrame:
    """target = values (bits: bit, value) of the set bits 0..31 in order; null if there is none."""
    number = hex_number(F.col("__list"))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda b: F.call_function("getbit", number, b) == 1)
    each = df.select(F.col(mask).alias("__list")).distinct().select("__list", F.explode(numbers).alias("__pos"))
    return _by_list(df, mask, each.join(bits.select(F.col("bit").alias("__pos"), F.col("value").alias("__value")), "__pos"), F.col("__value"), target)


def sid_list_describe(df: DataFrame, names: DataFrame, domain_names: DataFrame, sids: str, target: str) -> DataFrame:
    """Account text of each SID; a domain SID by its last number; else the SID itself."""
    each = _entries(df, sids, "__sid").withColumn("__rid", F.regexp_extract("__sid", r"^S-1-5-21-.*-(\d{1,5})$", 1))
    each = each.join(names.select(F.col("key").alias("__sid"), F.col("value").alias("__name")), "__sid", "left")
    each = each.join(domain_names.select(F.col("key").alias("__rid"), F.col("value").alias("__domain")), "__rid", "left")
    return _by_list(df, sids, each, F.coalesce("__name", "__domain", "__sid"), target)


def network_blocks(networks: DataFrame, bits: int = 16) -> DataFrame:
    """networks (net_lo, net_hi, …) with a row for each block of 2**bits addresses that they touch."""
    return networks.withColumn("__block", F.explode(F.sequence(F.shiftright("net_lo", bits), F.shiftright("net_hi", bits))))


def range_enrich(df: DataFrame, ranges: DataFrame, ip: str, target: str, record: str = "record", bits: int = 16) -> DataFrame:
    """target = record of the range of IPv4 addresses (net_lo, net_hi) that holds the address, the smallest if several do.

    An equi join on the block comes first. For networks of either kind see geo_enrich.
    """
    left = df.withColumn("__ip", ip_number(F.col(ip)))
    left = left.withColumn("__block", F.shiftright("__ip", bits))
    right = network_blocks(ranges, bits).select("__block", "net_lo", "net_hi", F.col(record).alias("__record"))
    keys = left.select("__ip", "__block").filter(F.col("__ip").isNotNull()).distinct()
    hits = keys.join(right, "__block").filter(F.col("__ip").between(F.col("net_lo"), F.col("net_hi")))
    best = hits.groupBy("__ip").agg(F.min_by("__record", F.struct(F.col("net_hi") - F.col("net_lo"), F.col("net_lo"))).alias(target))
    return left.join(best, "__ip", "left").drop("__ip", "__block")


def network_prefixes(networks: DataFrame, network: str = "network") -> DataFrame:
    """networks (network: address/bits) with kind, bits and prefix, the leading bits that all its addresses share."""
    parts = F.split(network, "/")
    digits = address_hex(parts[0])
    out = networks.withColumns({"__kind": F.length(digits) * 4, "__len": F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.length(digits) * 4)})
    return out.withColumn("__prefix", F.substring(bit_text(digits), F.lit(1), F.col("__len"))).filter("__len between 0 and __kind")


def geo_enrich(df: DataFrame, networks: DataFrame, ip: str, target: str, record: str = "record", network: str = "network") -> DataFrame:
    """target = record of the network (network: address/bits, IPv4 or IPv6) that holds the address, the smallest if several do.

    An address has one prefix for each length that occurs among the networks, at most 162, and these meet the networks by an equi join. Each distinct
    address is looked up once.
    """
    right = network_prefixes(networks, network).select("__kind", "__len", "__prefix", F.col(record).alias("__record"))
    lengths = {(r[0], r[1]) for r in right.select("__kind", "__len").distinct().collect()}
    left = df.withColumn("__ip", address_hex(F.col(ip)))
    keys = left.select("__ip").filter(F.col("__ip").isNotNull()).distinct().withColumns({"__kind": F.length("__ip") * 4, "__bits": bit_text(F.col("__ip"))})
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in sorted(lengths))) if lengths else F.array().cast("array<struct<k:int,n:int>>")
    each = keys.withColumn("__x", F.explode(F.filter(known, lambda x: x["k"] == F.col("__kind")))).select("__ip", "__kind", F.col("__x.n").alias("__len"), F.substring("__bits", F.lit(1), F.col("__x.n")).alias("__prefix"))
    best = each.join(right, ["__kind", "__len", "__prefix"]).groupBy("__ip").agg(F.max_by("__record", "__len").alias(target))
    return left.join(best, "__ip", "left").drop("__ip")


#: The address-to-system lookup is the same join on another table.
asn_enrich = geo_enrich


def vulnerability_scan(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """items: agent_id, item, version, version_key. candidates: cve, product, source, default_status, pos, low, low_key, less, less_key, most, most_key, status, exact.

    A candidate row is one version entry. exact entries need version = low; others low <= version (or low = 0) and version < less, or
    <= most where less is missing or *. The first entry that fits decides by its status; without one the default status does.
    """
    j = items.join(candidates, items["item"] == candidates["product"])
    v, equal = F.col("version_key"), F.col("version") == F.col("low")
    above = (F.col("low") == "0") | F.coalesce(F.col("low_key") <= v, F.lit(False))
    below = F.when(F.col("less").isNotNull() & (F.col("less") != "*"), v < F.col("less_key")).otherwise(v <= F.col("most_key"))
    fits = F.coalesce(F.when(F.col("exact"), equal).otherwise(above & below), F.lit(False))
    out = j.withColumn("__fits", fits).groupBy("agent_id", "item", "version", "cve", "source").agg(F.min(F.when(F.col("__fits"), F.struct("pos", "status"))).alias("hit"), F.first("default_status").alias("default_status"))
    return out.filter(F.coalesce(F.col("hit.status"), F.col("default_status")) == "affected").select("agent_id", "item", "version", "cve", "source")


def source_priority_dedup(found: DataFrame, ranks: Column) -> DataFrame:
    """Of equal (agent, item, cve) the row of the best source (least rank) stays."""
    w = Window.partitionBy("agent_id", "item", "cve").orderBy(ranks, "source")
    return found.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def remediation_filter(found: DataFrame, remediations: DataFrame, hotfixes: DataFrame) -> DataFrame:
    """Findings that have a remediation (cve, update) none of which is installed (agent_id, hotfix)."""
    solved = remediations.join(hotfixes, remediations["update"] == hotfixes["hotfix"]).select("agent_id", "cve").distinct()
    return found.join(remediations.select("cve").distinct(), "cve", "left_semi").join(solved, ["agent_id", "cve"], "left_anti")


def solved_by_hotfix(open_findings: DataFrame, remediations: DataFrame, new_hotfixes: DataFrame) -> DataFrame:
    """Open findings with operation: DELETED if a new hotfix solves them, else KEPT."""
    solved = remediations.join(new_hotfixes, remediations["update"] == new_hotfixes["hotfix"]).select("agent_id", "cve").distinct().withColumn("__solved", F.lit(True))
    return open_findings.join(solved, ["agent_id", "cve"], "left").withColumn("operation", F.when(F.col("__solved"), "DELETED").otherwise("KEPT")).drop("__solved")


def finding_state_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("agent_id", "item", "cve")) -> DataFrame:
    """Keys with INSERTED or DELETED."""
    a, b = old.select(*keys).distinct().withColumn("__old", F.lit(1)), new.select(*keys).distinct().withColumn("__new", F.lit(1))
    return a.join(b, list(keys), "full_outer").filter("__old is null or __new is null").select(*keys, F.when(F.col("__old").isNull(), "INSERTED").otherwise("DELETED").alias("operation"))


def description_fallback(found: DataFrame, vendor: DataFrame, default: DataFrame) -> DataFrame:
    """vendor, default: cve, description, score, severity. Text and score each fall back to the default source."""
    v, d = (x.select("cve", F.struct("description", "score", "severity").alias(n)) for x, n in ((vendor, "v"), (default, "d")))
    out = found.join(v, "cve", "left").join(d, "cve", "left")
    text = F.coalesce((F.length("v.description") > 0) & (F.lower("v.description") != "not defined"), F.lit(False))
    scored = F.coalesce((F.col("v.score") >= 0.01) & (F.length("v.severity") > 0), F.lit(False))
    pick = lambda ok, c: F.when(ok, F.col(f"v.{c}")).otherwise(F.col(f"d.{c}")).alias(c)
    return out.select(*found.columns, pick(text, "description"), pick(scored, "score"), pick(scored, "severity"))


def correlated_events(alerts: DataFrame, events: DataFrame, entities: list[str], most: int = 10) -> DataFrame:
    """alert_id, event_id, rank of the first events that share an entity; ids are columns id, time is ts.

    Of each entity only its first most + 1 events (one may be the alert itself) go to the join, ranked within parts before they are merged.
    """

    def exploded(df: DataFrame, name: str) -> DataFrame:
        values = F.array_compact(F.array(*(F.when(F.col(e).isNotNull(), F.concat(F.lit(f"{e}:"), F.col(e).cast("string"))) for e in entities)))
        return df.select(F.col("id").alias(name), F.col("ts").alias(f"{name}_ts"), F.explode(values).alias("entity"))

    by_time = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("event_id_ts", "event_id"))
    parted = exploded(events, "event_id").distinct().withColumn("__part", F.pmod(F.xxhash64("event_id"), F.lit(64)))
    parts = parted.withColumn("__r", by_time("entity", "__part")).filter(F.col("__r") <= most + 1)
    first = parts.withColumn("__r", by_time("entity")).filter(F.col("__r") <= most + 1).drop("__part", "__r")
    pairs = exploded(alerts, "alert_id").join(first, "entity").filter("alert_id <> event_id").select("alert_id", "event_id", "event_id_ts").distinct()
    w = Window.partitionBy("alert_id").orderBy("event_id_ts", "event_id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("alert_id", "event_id", "rank")


def agent_group_join(agents: DataFrame, belongs: DataFrame, groups: DataFrame) -> DataFrame:
    """agent id, groups by priority. belongs: id_agent, id_group, priority."""
    named = belongs.join(groups.select(F.col("id").alias("id_group"), F.col("name").alias("group_name")), "id_group")
    lists = named.groupBy(F.col("id_agent").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("priority", "group_name"))), lambda x: x["group_name"]).alias("groups"))
    return agents.join(lists, "id", "left")


def agent_metadata_update(docs: DataFrame, updates: DataFrame, fields: list[str]) -> DataFrame:
    """updates: agent_id, version, fields. Documents whose version is null or at most the given one take the new values."""
    new = updates.select("agent_id", F.col("version").alias("__v"), *(F.col(f).alias(f"__{f}") for f in fields))
    due = F.col("__v").isNotNull() & (F.col("version").isNull() | (F.col("version") <= F.col("__v")))
    out = docs.join(new, "agent_id", "left")
    for f in fields:
        out = out.withColumn(f, F.when(due, F.col(f"__{f}")).otherwise(F.col(f)))
    return out.withColumn("version", F.when(due, F.col("__v")).otherwise(F.col("version"))).select(*docs.columns)


def agent_groups_update(docs: DataFrame, updates: DataFrame) -> DataFrame:
    return agent_metadata_update(docs, updates, ["groups"])


def agent_metadata_repair(docs: DataFrame, truth: DataFrame, fields: list[str]) -> DataFrame:
    """Rewritten copies of the documents that differ from the truth, and only those."""
    new = truth.select("agent_id", *(F.col(f).alias(f"__{f}") for f in fields))
    out = docs.join(new, "agent_id")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"__{f}"))
    return out.filter(~same).select(*(F.col(f"__{c}").alias(c) if c in fields else F.col(c) for c in docs.columns))


def known_item_anti_join(new: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return new.join(seen.select(key).distinct(), key, "left_anti")


def intel_to_event_match(events: DataFrame, top: DataFrame, intel: DataFrame, kinds: tuple[str, ...] = ("ip", "domain", "hash", "url", "file")) -> DataFrame:
    """top: event_id, intel_id, rank. Adds title and the indicators of the intel's entity map."""
    ioc = F.flatten(F.map_values(F.map_filter("entities", lambda k, v: k.isin(*kinds))))
    return events.join(top, "event_id").join(intel.select("intel_id", "title", ioc.alias("ioc")), "intel_id")


def technique_catalog(techniques: DataFrame, related: DataFrame, ids: str, name: str) -> DataFrame:
    """Techniques with the names of related rows (id, name) that their id array lists."""
    each = _entries(techniques, ids, "__rid").join(related.select(F.col("id").alias("__rid"), F.col("name").alias("__name")), "__rid")
    names = each.groupBy("__list").agg(F.sort_array(F.collect_set("__name")).alias(name))
    return techniques.join(names, F.col(ids) == F.col("__list"), "left").drop("__list")
