"""Extraction jobs over a raw column: typed columns, a quarantine for rows that don't fit, and the fit rate by source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.predicates import is_ipv4, is_ipv6, sure


def extract(df: DataFrame, value: Column, target: str = "extracted", ok: Column | None = None) -> DataFrame:
    """Adds target and fits: whether the raw value had the form."""
    return df.withColumn(target, value).withColumn("fits", sure(ok) if ok is not None else F.col(target).isNotNull())


def split_fit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, quarantine)."""
    return df.filter("fits"), df.filter(~F.col("fits"))


def fit_rate(df: DataFrame, source: str) -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("fit"))


def json_extract_job(df: DataFrame, raw: str, schema: StructType | str) -> DataFrame:
    parsed = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    return extract(df, F.when(F.try_parse_json(raw).isNotNull(), parsed))


def xml_extract_job(df: DataFrame, raw: str, schema: StructType | str, row_tag: str = "Event") -> DataFrame:
    return extract(df, F.when(F.trim(raw).rlike(rf"(?s)^<{row_tag}[\s>].*</{row_tag}>$"), F.from_xml(raw, schema, {"rowTag": row_tag})))


def event_data_map(xml: Column) -> Column:
    """EventData of a channel event: map of Data Name → text."""
    items = F.regexp_extract_all(xml, F.lit(r"(<Data Name=['\"][^'\"]*['\"]>[^<]*</Data>)"), F.lit(1))
    return F.map_from_entries(F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"Name=['\"]([^'\"]*)", 1), F.regexp_extract(x, r">([^<]*)<", 1))))


def dsv_extract_job(df: DataFrame, raw: str, names: list[str], separator: str = ",", quote: str = '"', escape: str = '"') -> DataFrame:
    """Named outputs of a delimited line: all of them or none."""
    values = F.from_csv(raw, ", ".join(f"`{n}` string" for n in [*names, "__more"]), {"sep": separator, "quote": quote, "escape": escape})
    whole = F.col("__v")[names[-1]].isNotNull() & F.col("__v")["__more"].isNull()
    out = df.withColumn("__v", values)
    return extract(out, F.when(whole, F.struct(*(F.col("__v")[n].alias(n) for n in names)))).drop("__v")


def csv_extract_job(df: DataFrame, raw: str, names: list[str]) -> DataFrame:
    return dsv_extract_job(df, raw, names)


def kv_extract_job(df: DataFrame, raw: str, pair: str = "=", separator: str = " ") -> DataFrame:
    """Map of key → value; values may be quoted, of equal keys the last counts."""
    p, s = (f"\\Q{x}\\E" for x in (pair, separator))
    item = rf"""([^\s"']+?){p}("(?:[^"\\]|\\.)*"|(?:(?!{s}).)*)"""
    keys, values = (F.regexp_extract_all(raw, F.lit(item), F.lit(k)) for k in (1, 2))
    plain = F.transform(values, lambda v: F.when(v.startswith('"'), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v))
    entries = F.arrays_zip(keys.alias("key"), plain.alias("value"))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return extract(df, F.when(F.size(keys) > 0, F.map_from_arrays(F.transform(last, lambda e: e["key"]), F.transform(last, lambda e: e["value"]))))


def timestamp_extract_job(df: DataFrame, raw: str, formats: list[str]) -> DataFrame:
    return extract(df, F.coalesce(*(F.try_to_timestamp(raw, F.lit(f)) for f in formats)))


#: Host, port, path, query and fragment of a URL with a scheme.
URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d{1,5}))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def url_parts(url: Column) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(url, URL, k), F.lit(""))
    return F.when(url.rlike(URL) & (F.regexp_extract(url, URL, 3) != ""), F.struct(F.lower(part(1)).alias("scheme"), part(2).alias("username"), part(3).alias("domain"), part(4).try_cast("int").alias("port"), part(5).alias("path"), part(6).alias("query"), part(7).alias("fragment")))


def url_extract_job(df: DataFrame, raw: str) -> DataFrame:
    return extract(df, url_parts(F.col(raw)))


def domain_validity_job(df: DataFrame, raw: str) -> DataFrame:
    c = F.col(raw)
    return extract(df, c, ok=c.rlike(r"^(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)*[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.?$") & (F.length(c) <= 255))


def path_parts(path: Column) -> Column:
    """Directory, name, extension and drive of a path with / or \\."""
    p = r"^(.*[\\/])?([^\\/]*)$"
    name = F.regexp_extract(path, p, 2)
    return F.struct(path.alias("path"), F.nullif(F.regexp_replace(F.regexp_extract(path, p, 1), r"(?<=.)[\\/]$", ""), F.lit("")).alias("directory"), F.nullif(name, F.lit("")).alias("name"), F.nullif(F.regexp_extract(name, r"\.([^.]+)$", 1), F.lit("")).alias("extension"), F.nullif(F.upper(F.regexp_extract(path, r"^([A-Za-z]):", 1)), F.lit("")).alias("drive_letter"))


def path_extract_job(df: DataFrame, raw: str) -> DataFrame:
    return extract(df, F.when(F.length(raw) > 0, path_parts(F.col(raw))))


def ip_validity_job(df: DataFrame, raw: str) -> DataFrame:
    c = F.col(raw)
    return extract(df, c, ok=is_ipv4(c) | is_ipv6(c))


def base64_validity_job(df: DataFrame, raw: str) -> DataFrame:
    return extract(df, F.try_to_binary(F.col(raw), F.lit("base64")))


def between_extract_job(df: DataFrame, raw: str, start: str, end: str) -> DataFrame:
    c = F.col(raw)
    inside = c.startswith(start) & c.endswith(end) & (F.length(c) >= len(start) + len(end))
    return extract(df, F.when(inside, F.substring(c, F.lit(len(start) + 1), F.length(c) - len(start) - len(end))))


def quoted_extract_job(df: DataFrame, raw: str, quote: str = '"', escape: str = "\\") -> DataFrame:
    q, e = f"\\Q{quote}\\E", f"\\Q{escape}\\E"
    whole = rf"^{q}((?:{e}.|(?!{q}).)*){q}"
    return extract(df, F.when(F.col(raw).rlike(whole), F.regexp_replace(F.regexp_extract(raw, whole, 1), rf"{e}(.)", "$1")))


#: Type → whether a text has it, narrowest first.
TYPES = {
    "boolean": lambda c: F.lower(c).isin("true", "false"),
    "byte": lambda c: c.rlike(r"^[+-]?\d+$") & c.try_cast("tinyint").isNotNull(),
    "long": lambda c: c.rlike(r"^[+-]?\d+$") & c.try_cast("bigint").isNotNull(),
    "float": lambda c: c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & (F.abs(c.try_cast("float")) < float("inf")),
    "double": lambda c: c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") & (F.abs(c.try_cast("double")) < float("inf")),
    "alphanumeric": lambda c: c.rlike("^[A-Za-z0-9]+$"),
}


def text_has_type(c: Column, kind: str) -> Column:
    return sure(TYPES[kind](c))


def type_profile_job(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: rows with a value, and how many have each type."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("x")).select("x.*").filter("v is not null")
    return stacked.groupBy("column").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(text_has_type(F.col("v"), k)).alias(k) for k in TYPES))
