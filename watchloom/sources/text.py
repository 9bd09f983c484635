"""Line and block sources: raw logs into events.

Files are read in splits, and no step orders a whole file: lines are numbered by the line counts of the splits before theirs, and sources that join
lines scan a file in chunks of CHUNK lines, in parallel. A chunk's summary is its last boundary (the greatest, so summaries compose in any grouping);
only the summaries of a file are put in order, and a line takes the nearest boundary of its own chunk or of the chunks before.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.mapping import epoch_timestamp
from . import records
from .landing import stored

#: Lines of a chunk.
CHUNK = 1 << 16


def json_lines_source(spark: SparkSession, path: str, schema: StructType | str, quarantine: bool = False) -> DataFrame:
    """Blank and malformed lines are dropped; quarantine keeps the malformed ones in _corrupt_record."""
    if quarantine:
        full = f"{schema}, _corrupt_record string" if isinstance(schema, str) else StructType([*schema.fields]).add("_corrupt_record", "string")
        return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def alert_history_source(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*alerts*.json") -> DataFrame:
    """All rotated files below a folder, with their path for ordering."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path).withColumn("file", F.col("_metadata.file_path"))


def plain_line_source(spark: SparkSession, path: str, longest: int | None = None) -> DataFrame:
    """line, file. longest: characters after which lines are cut; by default they are whole."""
    line = F.col("value") if longest is None else F.substring("value", 1, longest)
    return spark.read.text(path).select(line.alias("line"), F.col("_metadata.file_path").alias("file"))


def json_log_source(spark: SparkSession, path: str, schema: StructType | str, **labels: str) -> DataFrame:
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("event"), F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)).alias("labels") if labels else F.create_map().cast("map<string,string>").alias("labels"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 0), line. A line ends at \\n or \\r\\n; an empty file has none.

    The lines are written once with their split and place in it, so that counts and numbers rest on the same splits.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")]
    lines = stored(spark.read.option("lineSep", "\n").text(path).select(*place, F.regexp_replace("value", r"\r$", "").alias("line")), "lines")
    splits = lines.groupBy("file", "split").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return lines.join(stored(splits, "line-splits"), ["file", "split"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line_no"), "line")


def last_before(lines: DataFrame, name: str, value: Column, inclusive: bool = True, backward: bool = False) -> DataFrame:
    """Adds, under a name, the greatest value of the lines before (or with inclusive up to) each line of its file, null if there is none.

    value: null, or something that grows with line_no: then it is that of the nearest line. backward: from the file's end; value must grow towards its start.
    """
    return all_before(lines, {name: (value, inclusive)}, backward)


def all_before(lines: DataFrame, values: dict[str, tuple[Column, bool]], backward: bool = False, chunks_too: bool = False) -> DataFrame:
    """last_before for several values (name → (value, inclusive)) at once: the lines are sorted once for all. chunks_too: __chunk stays, by which they lie together."""
    temp = {name: (f"__value_{k}", f"__near_{k}", f"__ahead_{k}") for k, name in enumerate(values)}
    rows = lines.withColumns({"__chunk": F.floor(F.col("line_no") / CHUNK)} | {temp[name][0]: value for name, (value, _) in values.items()})
    sign = F.desc if backward else F.asc
    own = Window.partitionBy("file", "__chunk").orderBy(sign("line_no"))
    up_to = {inclusive: own.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1) for inclusive in (True, False)}
    chunks = rows.groupBy("file", "__chunk").agg(*(F.max(value).alias(ahead) for value, _, ahead in temp.values()))
    earlier = Window.partitionBy("file").orderBy(sign("__chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("file", "__chunk", *(F.max(ahead).over(earlier).alias(ahead) for _, _, ahead in temp.values()))
    near = rows.withColumns({temp[name][1]: F.max(temp[name][0]).over(up_to[inclusive]) for name, (_, inclusive) in values.items()}).join(chunks, ["file", "__chunk"])
    return near.withColumns({name: F.coalesce(n, ahead) for name, (_, n, ahead) in temp.items()}).drop(*(c for cs in temp.values() for c in cs), *(() if chunks_too else ("__chunk",)))


def _collect(lines: DataFrame, group: str, separator: str = "\n") -> DataFrame:
    """The lines of each group as one event. Those of a chunk are joined where they lie, if __chunk tells; then only the events' parts are shuffled."""
    n = F.count(F.lit(1))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    if "__chunk" in lines.columns:
        lines = lines.groupBy("file", "__chunk", group).agg(F.array_join(ordered, separator).alias("line"), n.alias("__n"), F.min("line_no").alias("line_no"))
        n = F.sum("__n")
    return lines.groupBy("file", group).agg(F.array_join(ordered, separator).alias("event"), n.alias("n_lines"), F.min("line_no").alias("line_no")).drop(group)


#: Joining of lines: replaced by nothing, a space, a tab, or kept.
JOINS = {"none": "", "space": " ", "tab": "\t", "keep": "\n"}


def fixed_multiline_source(lines: DataFrame, n: int, join: str = "space", strict: bool = False) -> DataFrame:
    """n lines are an event; strict drops a shorter last one."""
    out = _collect(lines.withColumn("__g", F.floor(F.col("line_no") / n)), "__g", JOINS[join])
    return out.filter(F.col("n_lines") == n) if strict else out


def strict_chunk_source(lines: DataFrame, n: int) -> DataFrame:
    return fixed_multiline_source(lines, n, "keep", strict=True)


def regex_start_source(lines: DataFrame, pattern: str, join: str = "keep") -> DataFrame:
    """A line that matches opens an event; lines before the first opener are left out."""
    marked = all_before(lines, {"__g": (F.when(F.col("line").rlike(pattern), F.col("line_no")), True)}, chunks_too=True)
    return _collect(marked.filter("__g is not null"), "__g", JOINS[join])


def regex_end_source(lines: DataFrame, pattern: str, join: str = "keep") -> DataFrame:
    """A line that matches closes an event; an open rest is an event too."""
    marked = all_before(lines, {"__g": (F.when(F.col("line").rlike(pattern), F.col("line_no")), False)}, chunks_too=True)
    return _collect(marked, "__g", JOINS[join])


BUFFERS = "file string, chunk bigint, kind int, event string, n_lines bigint, line_no bigint, numbers array<bigint>, texts array<string>"


def _gathered(pattern: str, sign: str, most: int | None):
    """Runs a chunk's lines, sorted, behind the buffer it begins with: its events, and the buffer it leaves."""
    import re

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled, held, now = re.compile(pattern), [], None
        for pdf in batches:
            rows = []
            for file, chunk, no, line, numbers, texts in pdf.itertuples(index=False):
                if (file, chunk) != now:
                    if now is not None:
                        rows.append((*now, 2, None, None, None, [n for n, _ in held], [x for _, x in held]))
                    now, held = (file, chunk), []
                if numbers is not None:
                    held = list(zip(numbers, texts, strict=True))
                    continue
                held.append((no, line))
                event = sign.join(x for _, x in held)
                if compiled.search(event):
                    rows.append((*now, 1, event, len(held), held[0][0], None, None))
                    held = []
                elif most and len(held) >= most:
                    held = []
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in BUFFERS.split(", ")])
        if now is not None:
            yield pd.DataFrame([(*now, 2, None, None, None, [n for n, _ in held], [x for _, x in held])], columns=[x.split()[0] for x in BUFFERS.split(", ")])

    return run


def regex_all_source(lines: DataFrame, pattern: str, most: int | None = None, join: str = "keep") -> DataFrame:
    """Lines gather until the whole buffer matches; with most, a buffer of so many lines is given up. An open rest is left out.

    Where an event begins hangs on all lines before it. Each chunk first runs as if it began with an empty buffer; then the chunks whose predecessor leaves
    another buffer than the one they began with run again, until none does. Most logs settle after one such round, as a chunk's last buffer seldom hangs on its
    first. A task holds a batch of lines and one buffer.
    """
    rows = stored(lines.select("file", F.floor(F.col("line_no") / CHUNK).alias("chunk"), "line_no", "line"), "gathered-lines")
    key, order, empty = ["file", "chunk"], ("file", "chunk", F.asc_nulls_first("line_no")), {"numbers": "array<bigint>", "texts": "array<string>"}
    begins = rows.select(*key).distinct().select(*key, *(F.lit(None).cast(kind).alias(c) for c, kind in empty.items()))
    rounds: list[DataFrame] = []
    while True:
        todo = rows.join(begins.select(*key), key, "left_semi") if rounds else rows
        given = begins.filter("numbers is not null").select(*key, F.lit(None).cast("bigint").alias("line_no"), F.lit(None).cast("string").alias("line"), *empty)
        stream = todo.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in empty.items())).unionByName(given)
        found = stream.repartition(*key).sortWithinPartitions(*order).mapInPandas(_gathered(pattern, JOINS[join], most), BUFFERS)
        rounds.append(stored(found.withColumn("round", F.lit(len(rounds))), "gathered"))
        every = rounds[0]
        for df in rounds[1:]:
            every = every.unionByName(df)
        # the buffer that each chunk left in its last round, and by where it begins the one its successor should have had
        left = every.filter("kind = 2").groupBy(*key).agg(F.max_by(F.struct("numbers", "texts"), "round").alias("left"))
        follows = Window.partitionBy("file").orderBy("chunk")
        due = left.select(*key, F.lag("left").over(follows).alias("due")).filter("due is not null")
        had = begins if len(rounds) == 1 else had.join(begins.select(*key), key, "left_anti").unionByName(begins)
        due = due.join(had.select(*key, F.try_element_at("numbers", F.lit(1)).alias("had")), key)
        due = due.filter(~F.try_element_at("due.numbers", F.lit(1)).eqNullSafe(F.col("had")))
        begins = stored(due.select(*key, "due.numbers", "due.texts"), "gathered-begins")
        had = stored(had, "gathered-had") if len(rounds) > 1 else had
        if begins.isEmpty():
            break
    last = every.filter("kind = 2").groupBy(*key).agg(F.max("round").alias("round"))
    return every.filter("kind = 1").join(last, [*key, "round"]).select("file", "event", "n_lines", "line_no")


#: How a record of each database's log begins.
DB_STARTS = {"postgresql": r"^\[?\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "mysql": r"^(?:\d{6} +\d{1,2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})", "mssql": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+"}


def db_log_source(lines: DataFrame, product: str) -> DataFrame:
    return regex_start_source(lines, DB_STARTS[product], "space")


def ids_block_source(lines: DataFrame) -> DataFrame:
    """Blocks of an intrusion detection log open with [**] and end at a blank line."""
    return regex_start_source(lines.filter(F.trim("line") != ""), r"^\[\*\*\]", "space")


def alert_block_source(lines: DataFrame) -> DataFrame:
    """Text blocks opened by ** Alert and closed by a blank line or the next opener."""
    blank = F.trim("line") == ""
    opens = F.when(F.col("line").startswith("** Alert"), F.col("line_no"))
    marked = all_before(lines, {"__blank": (F.when(blank, F.col("line_no")), False), "__open": (opens, True)})
    marked = marked.filter(~blank & F.col("__open").isNotNull() & (F.col("__open") > F.coalesce("__blank", F.lit(-1))))
    return _collect(marked, "__open").drop("__blank")


def alert_block_fields(blocks: DataFrame) -> DataFrame:
    """timestamp, hostname, program, level, rule_id, description, tags, user, message; kept if rule id or message is there."""
    rest = F.split("event", "\n")
    take = lambda p, k=1: F.nullif(F.regexp_extract("event", p, k), F.lit(""))
    rule = r"(?m)^Rule: (\d+) \(level (\d+)\) -> '(.*)'$"
    origin = r"(?m)^\d{4} \w{3} +\d+ \d{2}:\d{2}:\d{2} (?:\(([^)]*)\) )?(\S+?)->(\S+)$"
    message = F.array_join(F.filter(F.slice(rest, 3, F.size(rest)), lambda x: ~x.rlike(r"^(Rule:|User:|Src IP:|Dst IP:|Src Port:|Dst Port:)")), "\n")
    out = blocks.select(
        epoch_timestamp(F.regexp_extract("event", r"^\*\* Alert (\d+)", 1)).alias("timestamp"),
        F.coalesce(take(origin), take(origin, 2)).alias("hostname"),
        take(origin, 3).alias("location"),
        take(r"(?m)^\w{3} +\d+ [\d:]{8} \S+ ([\w./-]+)(?:\[\d+\])?:").alias("program"),
        take(rule).alias("rule_id"),
        take(rule, 2).try_cast("int").alias("level"),
        take(rule, 3).alias("description"),
        F.filter(F.split(F.regexp_extract("event", r"^\*\* Alert [^:]*: ?(?:mail +)?- ?(.*)", 1), ","), lambda x: x != "").alias("tags"),
        take(r"(?m)^User: (.*)$").alias("user"),
        take(r"(?m)^Src IP: (.*)$").alias("src_ip"),
        F.nullif(message, F.lit("")).alias("message"),
    )
    return out.filter("rule_id is not null or message is not null")


def forwarded_alert_source(fields: DataFrame) -> DataFrame:
    """One line for each alert block of another node."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    return fields.select(F.concat_ws("; ", part("level", "level"), part("rule", "rule_id"), part("location", "location"), part("srcip", "src_ip"), part("user", "user"), part("log", "message")).alias("line"))


def audit_record_source(lines: DataFrame, most: int | None = None) -> DataFrame:
    """Consecutive lines with the same msg=audit(id) are one event, of at most most lines if given; other lines are left out."""
    ided = lines.withColumn("audit_id", F.regexp_extract("line", r"msg=audit\(([^)]+)\)", 1)).filter("audit_id <> ''")
    marked = last_before(ided, "__before", F.struct("line_no", "audit_id"), inclusive=False)
    change = ~F.col("audit_id").eqNullSafe(F.col("__before.audit_id"))
    marked = last_before(marked, "__g", F.when(change, F.col("line_no")))
    held = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    ordered = F.transform(held if most is None else F.slice(held, 1, most), lambda x: x["line"])
    return marked.groupBy("file", "__g", "audit_id").agg(F.array_join(ordered, " ").alias("event"), F.min("line_no").alias("line_no")).drop("__g")


def delimiter_multiline_source(spark: SparkSession, path: str, marker: str) -> DataFrame:
    return spark.read.option("lineSep", marker).text(path).select(F.btrim("value", F.lit(" \t\r\n")).alias("event")).filter("event <> ''")


def event_channel_source(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Events of an exported channel, under a root element or one after the other; malformed ones are dropped.

    With a schema the files are read in splits that end with an event. Without one it is inferred, from files with a root element.
    """
    if schema is None:
        return spark.read.format("xml").option("rowTag", "Event").option("mode", "DROPMALFORMED").load(path)
    full = f"{schema}, _corrupt_record string" if isinstance(schema, str) else StructType([*schema.fields]).add("_corrupt_record", "string")
    body = F.regexp_extract("value", r"(?s)(<Event(?:\s[^>]*)?>.*)$", 1)
    rows = spark.read.option("lineSep", "</Event>").text(path).select(body.alias("x")).filter("x <> ''")
    events = rows.select(F.from_xml(F.concat("x", F.lit("</Event>")), full, {"rowTag": "Event"}).alias("e")).select("e.*")
    return events.filter("_corrupt_record is null").drop("_corrupt_record")


def scan_report_source(lines: DataFrame) -> DataFrame:
    """Host and open ports of a grepable scan report."""
    hosts = lines.filter(F.col("line").startswith("Host:") & F.col("line").contains("Ports:"))
    ports = F.explode(F.regexp_extract_all("line", F.lit(r"(\d+/open/[^/]*/[^/]*/[^/,]*)"), F.lit(1))).alias("p")
    each = hosts.select(F.regexp_extract("line", r"^Host: (\S+)", 1).alias("host"), ports)
    part = lambda k: F.get(F.split("p", "/"), F.lit(k))
    return each.select("host", part(0).cast("int").alias("port"), part(2).alias("proto"), part(4).alias("service"))


def utf16_source(spark: SparkSession, path: str, big_endian: bool = False) -> DataFrame:
    """file, start (byte), line of UTF-16 files of any size, read in ranges; empty lines are left out."""
    records.register(spark)
    rows = spark.read.format(records.NAME).option("path", path).option("encoding", "utf-16-be" if big_endian else "utf-16-le").load()
    return rows.select("file", "start", F.regexp_replace("record", "^\\uFEFF", "").alias("line")).filter("line <> ''")


FRAME = r"^(.):((?:[^:|]|\|.)+):(.*)$"


def framed_event_source(raw: DataFrame, column: str = "value") -> DataFrame:
    """queue, location, agent_id, agent_name, message, ok of queue:location:message frames; |: stands for a colon."""
    whole = rf"(?s){FRAME}"
    location = F.replace(F.regexp_extract(column, whole, 2), F.lit("|:"), F.lit(":"))
    agent = r"^\[([^\]]*)\] \(([^)]*)\) ([^>]*)->(.*)$"
    remote = location.rlike(agent)
    return raw.select(
        F.regexp_extract(column, whole, 1).alias("queue"), F.when(remote, F.regexp_extract(location, agent, 4)).otherwise(location).alias("location"), F.when(remote, F.regexp_extract(location, agent, 1)).alias("agent_id"), F.when(remote, F.regexp_extract(location, agent, 2)).alias("agent_name"), F.regexp_extract(column, whole, 3).alias("message"), F.coalesce(F.col(column).rlike(whole), F.lit(False)).alias("ok")
    )


PLAIN_LOG = r"^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) (\S+?)(?:\[\d+\])?(?: \S+ at \S+)?: (INFO|ERROR|WARNING|CRITICAL|DEBUG2?): (.*)$"


def manager_log_source(lines: DataFrame, column: str = "line") -> DataFrame:
    """timestamp, tag, level, description of plain or JSON log lines; other lines are dropped, rootcheck tags are one."""
    j = F.from_json(column, "timestamp string, tag string, level string, description string")
    is_json = F.col(column).startswith("{")
    pick = lambda k, name: F.when(is_json, F.col("__j")[name]).otherwise(F.nullif(F.regexp_extract(column, PLAIN_LOG, k), F.lit("")))
    out = lines.withColumn("__j", F.when(is_json, j)).select(F.try_to_timestamp(pick(1, "timestamp"), F.lit("yyyy/MM/dd HH:mm:ss")).alias("timestamp"), pick(2, "tag").alias("tag"), F.lower(F.regexp_replace(pick(3, "level"), "2$", "")).alias("level"), pick(4, "description").alias("description"))
    return out.filter("tag is not null").withColumn("tag", F.when(F.col("tag").contains("rootcheck"), "rootcheck").otherwise(F.col("tag")))


def hourly_totals_source(lines: DataFrame) -> DataFrame:
    """hour, alerts (structs of sigid, level, times), total_alerts, events, syscheck, firewall; alert lines belong to the close line that follows."""
    close = r"^(\d+)--(\d+)--(\d+)--(\d+)--(\d+)$"
    alert = r"^(\d+)-(\d+)-(\d+)-(\d+)$"
    marked = lines.withColumn("__close", F.col("line").rlike(close)).filter(F.col("__close") | F.col("line").rlike(alert))
    grouped = last_before(marked, "__g", F.when(F.col("__close"), -F.col("line_no")), backward=True).filter("__g is not null")
    number = lambda p, k: F.regexp_extract("line", p, k).try_cast("bigint")
    alerts = F.sort_array(F.collect_list(F.when(~F.col("__close"), F.struct("line_no", number(alert, 2).alias("sigid"), number(alert, 3).alias("level"), number(alert, 4).alias("times")))))
    totals = F.max(F.when(F.col("__close"), F.struct(*(number(close, k).alias(n) for k, n in enumerate(("hour", "total_alerts", "events", "syscheck", "firewall"), 1)))))
    out = grouped.groupBy("file", "__g").agg(F.transform(alerts, lambda a: F.struct(a["sigid"].alias("sigid"), a["level"].alias("level"), a["times"].alias("times"))).alias("alerts"), totals.alias("t"))
    return out.select("file", "t.hour", "alerts", "t.total_alerts", "t.events", "t.syscheck", "t.firewall")


def kv_state_source(lines: DataFrame) -> DataFrame:
    """name='number' lines of a file as a map of doubles; of equal names the last line counts."""
    p = r"^\s*([A-Za-z_]\w*)='(-?[\d.]+)'"
    hits = lines.filter(F.col("line").rlike(p)).select("file", "line_no", F.regexp_extract("line", p, 1).alias("k"), F.regexp_extract("line", p, 2).try_cast("double").alias("v"))
    return hits.groupBy("file", "k").agg(F.max_by("v", "line_no").alias("v")).groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("state"))


def multilog_source(spark: SparkSession, path: str) -> DataFrame:
    """@timestamp text lines of …/program/current."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.col("value").startswith("@"))
    return lines.select(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("program"), F.regexp_extract("value", r"^@(\S+) ", 1).alias("stamp"), F.regexp_extract("value", r"^@\S+ (.*)$", 1).alias("message"))
