"""State tables: snapshot diffs, versions, caps, pending changes, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.transform import delete_key
from .aggregates import checksum_tree
from .quantiles import largest, number_of


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], ignore: list[str] = ()) -> DataFrame:
    """keys, operation (INSERTED, MODIFIED, DELETED), changed (names of fields), old and new as structs.

    Fields in ignore are carried but don't make a change.
    """
    fields = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*fields).alias("old"))
    b = new.select(*keys, F.struct(*fields).alias("new"))
    both = a.join(b, keys, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.lit(f)) for f in fields if f not in ignore)))
    operation = F.when(F.col("old").isNull(), "INSERTED").when(F.col("new").isNull(), "DELETED").when(F.size("changed") > 0, "MODIFIED")
    return both.withColumn("changed", changed).withColumn("operation", operation).filter("operation is not null").select(*keys, "operation", "changed", "old", "new")


def row_upsert(state: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new state, changes) after rows are inserted or updated; untouched rows stay."""
    touched = state.join(rows.select(*keys), keys, "left_semi")
    return state.join(rows.select(*keys), keys, "left_anti").unionByName(rows), snapshot_diff(touched, rows, keys)


def transaction_diff(state: DataFrame, scan: DataFrame, keys: list[str]) -> DataFrame:
    """A complete scan: what it lacks is deleted."""
    return snapshot_diff(state, scan, keys)


def old_values(diff: DataFrame, fields: list[str]) -> DataFrame:
    """Adds previous: map of changed field → old value as text."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f"old.{f}").cast("string") for f in fields)))
    return diff.withColumn("previous", F.map_filter(pairs, lambda k, v: F.array_contains(F.col("changed"), k)))


def set_version(rows: DataFrame, version: int) -> DataFrame:
    return rows.withColumn("version", F.lit(version).cast("bigint"))


def version_bump(diff: DataFrame) -> DataFrame:
    """Version of each changed row: 1 for a new one, else one more."""
    return diff.withColumn("version", F.coalesce(F.col("old.version"), F.lit(0)) + 1)


def max_rows_cap(rows: DataFrame, cap: int, newest: str, tie: str) -> DataFrame:
    """The newest cap rows stay, of equals those with the least tie: numbers and times by thresholds (quantiles.largest), so caps may be table sizes."""
    by, then = number_of(rows, newest), number_of(rows, tie)
    if by is None or then is None:  # texts have no thresholds: a top-k, whose last merge holds cap rows
        return rows.orderBy(F.desc(newest), tie).limit(cap)
    return largest(rows, cap, by, then)


def cascade_delete(parents_deleted: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents_deleted.select(*keys), keys, "left_semi").withColumn("operation", F.lit("DELETED"))


def coalesce_changes(pending: DataFrame) -> DataFrame:
    """pending: id, seq, operation (CREATE, MODIFY, DELETE), data. One change for each id, or none.

    A creation that is deleted before a sync is nothing, and what follows begins anew. A modification or deletion where nothing is pending shows that the row
    exists: from then on the last operation wins. A pending creation stays one, with the last data.
    """
    before = F.lag("operation").over(Window.partitionBy("id").orderBy("seq"))
    shows = (F.coalesce(before, F.lit("DELETE")) == "DELETE") & (F.col("operation") != "CREATE")
    agg = pending.withColumn("__shows", shows).groupBy("id").agg(F.bool_or("__shows").alias("existing"), F.max_by(F.struct("operation", "data"), "seq").alias("last"), F.max("seq").alias("seq"))
    operation = F.when(F.col("existing"), F.col("last.operation")).otherwise("CREATE")
    return agg.filter(F.col("existing") | (F.col("last.operation") != "DELETE")).select("id", "seq", operation.alias("operation"), F.col("last.data").alias("data"), "existing")


def select_rows(table: DataFrame, columns: list[str], where: Column | None = None, distinct: bool = False, order: list[str] = (), count: int | None = None) -> DataFrame:
    out = table.filter(where) if where is not None else table
    out = out.select(*columns)
    out = out.distinct() if distinct else out
    out = out.orderBy(*order) if order else out
    return out.limit(count) if count is not None else out


def integrity_mismatch(mine: DataFrame, theirs: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, checksum, …) of mine in tables whose checksum differs from theirs or that they lack: what must be sent whole."""
    a = checksum_tree(mine, by).select(*by, F.concat_ws(":", "table_checksum", F.col("n").cast("string")).alias("a"))
    b = checksum_tree(theirs, by).select(*by, F.concat_ws(":", "table_checksum", F.col("n").cast("string")).alias("b"))
    differ = a.join(b, by, "left").filter(~F.col("a").eqNullSafe(F.col("b"))).select(*by)
    return mine.join(differ, by, "left_semi")


def integrity_extra(mine: DataFrame, theirs: DataFrame, by: list[str]) -> DataFrame:
    """Tables that only the other side has: what must be cleared there."""
    return theirs.select(*by).distinct().join(mine.select(*by).distinct(), by, "left_anti")


def agent_disconnect(agents: DataFrame, as_of: Column, disconnect_seconds: int, alert_seconds: int) -> DataFrame:
    """Adds new_status and alert: active agents that were silent too long, and those silent longer still, to the microsecond."""
    silent = as_of - F.col("last_keepalive")
    longer = lambda seconds: silent > F.make_dt_interval(secs=F.lit(seconds))
    gone = (F.col("status") == "active") & longer(disconnect_seconds)
    return agents.withColumn("new_status", F.when(gone, "disconnected").otherwise(F.col("status"))).withColumn("alert", (F.col("new_status") == "disconnected") & longer(disconnect_seconds + alert_seconds))


def feed_upsert(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state: key, payload map. changes: key, offset, type (create, update, delete), payload. Of a key the latest offset wins."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("type", "payload"), "offset").alias("c"))
    kept = state.join(last.select("key"), "key", "left_anti")
    return kept.unionByName(last.filter("c.type <> 'delete'").select("key", F.col("c.payload").alias("payload")))


def json_patch(payload: Column, patches: list[tuple[str, str, str | None]]) -> Column:
    """replace, add and remove on the top-level fields of a map."""
    for op, key, value in patches:
        rest = delete_key(payload, key)
        payload = rest if op == "remove" else F.map_concat(rest, F.create_map(F.lit(key), F.lit(value)))
    return payload


def candidate_replace(old: DataFrame, new: DataFrame, key: str = "cve") -> DataFrame:
    """Candidates of the records that came again are replaced as a whole."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def inventory_clean(rows: DataFrame, clean: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows to report as DELETED)."""
    return rows.join(clean.select(*keys), keys, "left_anti"), rows.join(clean.select(*keys), keys, "left_semi").withColumn("operation", F.lit("DELETED"))


def sync_due(bookmarks: DataFrame, as_of: Column) -> DataFrame:
    return bookmarks.filter(F.col("last_sync") + F.make_dt_interval(secs=F.col("interval_seconds")) <= as_of)
