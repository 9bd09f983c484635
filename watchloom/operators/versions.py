"""Comparable version keys as arrays, and policy checks over content lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which they are tried.
PATTERNS = {
    "calver": r"^(\d{4})\.(\d{1,2})\.(\d{1,2})(?:\.(\d+))?$",
    "pep440": r"(?i)^v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[._-]?(a|b|c|rc|alpha|beta|pre|preview)[._-]?(\d*))?(?:(?:[._-]?(post|rev|r)[._-]?(\d*))|-(\d+))?(?:[._-]?(dev)[._-]?(\d*))?$",
    "majorminor": r"^(\d+)\.(\d+)$",
    "semver": r"^(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$",
}


def _group(v: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(v, pattern, n)


def _number(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def _numbers(text: Column) -> Column:
    """Dotted numbers without trailing zeros, as decimals."""
    return F.transform(F.split(F.regexp_replace(text, r"(?:\.0+)+$", ""), r"\."), _number)


def _pep440(v: Column) -> Column:
    p = PATTERNS["pep440"]
    kind, post, post_number, dev = F.lower(_group(v, p, 3)), _group(v, p, 5), _group(v, p, 7), _group(v, p, 8)
    has_post = (post != "") | (post_number != "")
    # stages before, at and after the release; a development release comes before the stage it belongs to
    stage = F.when(kind.isin("a", "alpha"), 1).when(kind.isin("b", "beta"), 2).when(kind != "", 3).when((dev != "") & ~has_post, 0).otherwise(4)
    tail = F.array(stage.cast("decimal(38,0)"), _number(_group(v, p, 4)), has_post.cast("int").cast("decimal(38,0)"), _number(F.concat(_group(v, p, 6), post_number)), F.when(dev != "", F.lit(-1)).otherwise(0).cast("decimal(38,0)"), _number(_group(v, p, 9)))
    return F.struct(_number(_group(v, p, 1)).alias("epoch"), _numbers(_group(v, p, 2)).alias("release"), tail.alias("tail"))


def _char_weight(c: Column) -> Column:
    """dpkg: ~ before the end of a part, letters before other marks."""
    return F.when(c == "~", -1).when(c.rlike("^[A-Za-z]$"), F.ascii(c)).otherwise(F.ascii(c) + 256)


def dpkg_part_key(text: Column) -> Column:
    """Alternating non-digit and digit parts: weights of characters with an end weight 0, then the number."""
    parts = F.regexp_extract_all(text, F.lit(r"(\D*\d*)"), F.lit(1))

    def one(part: Column) -> Column:
        letters = F.filter(F.split(F.regexp_extract(part, r"^(\D*)", 1), ""), lambda c: c != "")
        return F.struct(F.concat(F.transform(letters, lambda c: _char_weight(c).cast("int")), F.array(F.lit(0))).alias("text"), _number(F.regexp_extract(part, r"(\d*)$", 1)).alias("number"))

    return F.transform(F.filter(parts, lambda x: x != ""), one)


def _ended(parts: Column) -> Column:
    """The end of a version compares like an empty part, so 1.0~rc1 < 1.0 < 1.0a."""
    end = F.struct(F.array(F.lit(0)).alias("text"), F.lit(0).cast("decimal(38,0)").alias("number"))
    return F.concat(parts, F.array(end))


def dpkg_key(v: Column) -> Column:
    rest = F.regexp_replace(v, r"^\d+:", "")
    upstream, revision = F.regexp_extract(rest, r"^(.*?)(?:-([^-]*))?$", 1), F.regexp_extract(rest, r"^(.*?)(?:-([^-]*))?$", 2)
    return F.struct(_number(F.regexp_extract(v, r"^(\d+):", 1)).alias("epoch"), _ended(dpkg_part_key(upstream)).alias("upstream"), _ended(dpkg_part_key(revision)).alias("revision"))


def rpm_part_key(text: Column) -> Column:
    """Segments: ~ first, then the end, then letters, then numbers."""
    parts = F.regexp_extract_all(text, F.lit(r"(~|\d+|[A-Za-z]+)"), F.lit(1))
    rank = lambda p: F.when(p == "~", -1).when(p.rlike(r"^\d"), 2).otherwise(1)
    keys = F.transform(parts, lambda p: F.struct(rank(p).alias("rank"), F.when(p.rlike(r"^\d"), _number(p)).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(p.rlike("^[A-Za-z]"), p).otherwise("").alias("text")))
    return F.concat(keys, F.array(F.struct(F.lit(0).alias("rank"), F.lit(0).cast("decimal(38,0)").alias("number"), F.lit("").alias("text"))))


def rpm_key(v: Column) -> Column:
    rest = F.regexp_replace(v, r"^\d+:", "")
    return F.struct(_number(F.regexp_extract(v, r"^(\d+):", 1)).alias("epoch"), rpm_part_key(F.regexp_extract(rest, r"^([^-]*)", 1)).alias("version"), rpm_part_key(F.regexp_extract(rest, r"-(.*)$", 1)).alias("release"))


def semver_key(v: Column) -> Column:
    p = PATTERNS["semver"]
    pre = _group(v, p, 4)
    ids = F.transform(F.filter(F.split(pre, r"\."), lambda x: x != ""), lambda x: F.struct((~x.rlike(r"^\d+$")).cast("int").alias("alpha"), F.when(x.rlike(r"^\d+$"), _number(x)).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(x.rlike(r"^\d+$"), "").otherwise(x).alias("text")))
    return F.struct(F.array(*(_number(_group(v, p, k)) for k in (1, 2, 3))).alias("release"), (pre == "").cast("int").alias("final"), ids.alias("pre"))


KEYS = {"calver": lambda v: F.array(*(_number(_group(v, PATTERNS["calver"], k)) for k in (1, 2, 3, 4))), "pep440": _pep440, "majorminor": lambda v: F.array(*(_number(_group(v, PATTERNS["majorminor"], k)) for k in (1, 2))), "semver": semver_key, "dpkg": dpkg_key, "rpm": rpm_key}


def version_kind(v: Column) -> Column:
    """The first kind whose form fits: calver, pep440, majorminor, semver, else dpkg."""
    out = F.lit("dpkg")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(v.rlike(pattern), kind).otherwise(out)
    return F.when(v.isNotNull(), out)


def version_key(v: Column, kind: str) -> Column:
    """A key of one kind that Spark orders as the versions are."""
    return KEYS[kind](v)


def version_compare(a: Column, b: Column, kinds: tuple[str, ...] = tuple(KEYS)) -> Column:
    """-1, 0 or 1 for versions of one kind; null where the kinds differ (an error row)."""
    ka, kb = version_kind(a), version_kind(b)
    out = F.lit(None).cast("int")
    for kind in kinds:
        x, y = version_key(a, kind), version_key(b, kind)
        out = F.when((ka == kind) & (kb == kind), F.when(x < y, -1).when(x > y, 1).otherwise(0)).otherwise(out)
    return out


def package_compare(a: Column, b: Column, kind: str = "dpkg") -> Column:
    """-1, 0 or 1 under a stated kind."""
    x, y = version_key(a, kind), version_key(b, kind)
    return F.when(x < y, -1).when(x > y, 1).when(a.isNotNull() & b.isNotNull(), 0)


def policy_check_eval(content: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_id, found. content: target, text; rules: rule_id, target, terms (array of struct kind, negate, pattern, op, value).

    A rule is found if one line meets all its terms: kind r is a regular expression, n compares the number that the pattern's group takes from
    the line, t is a plain text; negate turns a term round.
    """
    joined = rules.join(content, "target", "left")

    def holds(line: Column, term: Column) -> Column:
        number = F.call_function("regexp_extract", line, term["pattern"], F.lit(1)).try_cast("double")
        compared = F.when(term["op"] == "<", number < term["value"]).when(term["op"] == "<=", number <= term["value"]).when(term["op"] == ">", number > term["value"]).when(term["op"] == ">=", number >= term["value"]).when(term["op"] == "==", number == term["value"]).otherwise(number != term["value"])
        hit = F.coalesce(F.when(term["kind"] == "r", F.regexp_like(line, term["pattern"])).when(term["kind"] == "n", compared).otherwise(line == term["pattern"]), F.lit(False))
        return F.when(term["negate"], ~hit).otherwise(hit)

    found = F.exists(F.split("text", r"\r?\n"), lambda line: F.forall("terms", lambda term: holds(line, term)))
    return joined.select("rule_id", F.coalesce(found, F.lit(False)).alias("found"))
