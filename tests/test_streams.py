import datetime as dt

import pytest
from pyspark.sql import functions as F

from watchloom.streaming import streams as S


@pytest.fixture
def feed(spark, tmp_path):
    """Writes batches of rows as files, and returns a stream over them with one file for each trigger."""

    def make(schema, *batches):
        for i, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
        return S.incremental_files(spark, str(tmp_path / "in*"), spark.createDataFrame(batches[0], schema).schema, "parquet", 1)

    return make


def run(df, tmp_path, mode="append"):
    spark = df.sparkSession
    name = "out" + tmp_path.name.replace("-", "_")
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


T0 = dt.datetime(2024, 1, 1)
at = lambda m: T0 + dt.timedelta(minutes=m)


def test_stream_dedup_and_old(feed, tmp_path):
    s = feed("fp string, ts timestamp", [("a", at(0)), ("b", at(1))], [("a", at(2)), ("c", at(3)), ("d", at(-9999))])
    got = run(S.stream_dedup(S.discard_late_or_old(s, "2023-12-31", late=None), "fp").select("fp"), tmp_path)
    assert sorted(got) == [("a",), ("b",), ("c",)]


def test_hourly_totals_stream(feed, tmp_path, spark):
    batch = [(at(10 * i), i % 3 == 0) for i in range(30)]
    s = feed("ts timestamp, alert boolean", batch[:15], batch[15:], [(at(9999), False)])
    got = sorted(run(S.hourly_totals_stream(s, F.col("alert")), tmp_path))
    twin = spark.createDataFrame(batch, "ts timestamp, alert boolean").groupBy(F.date_trunc("hour", "ts")).agg(F.count(F.lit(1)), F.count_if("alert")).collect()
    assert got[: len(twin)] == sorted(map(tuple, twin))


def test_auth_and_port_scan_streams(feed, tmp_path):
    burst = [("u", at(0.1 * i), i, i < 7) for i in range(12)]
    s = feed("user string, ts timestamp, port int, failed boolean", burst, [("u", at(60), 1, False)], [("z", at(999), 1, False)])
    got = run(S.auth_episode_stream(s, "user", F.col("failed")).select("user", "attempts", "failed", "brute_force"), tmp_path)
    assert ("u", 12, 7, True) in got and ("u", 1, 0, False) in got


def test_port_scan_stream(feed, tmp_path):
    s = feed("user string, ts timestamp, port int", [("u", at(0.1 * i), i) for i in range(12)] + [("v", at(0), 1)], [("z", at(999), 1)])
    got = run(S.port_scan_stream(s, "user", "port"), tmp_path)
    assert {g[0] for g in got} == {"u"} and all(g[2] == 12 for g in got) and len(got) == 9


def test_coalesce_changes_stream(feed, tmp_path):
    s = feed("id bigint, seq bigint, operation string, data string", [(1, 1, "CREATE", "a"), (2, 1, "DELETE", ""), (3, 1, "CREATE", "x")], [(1, 2, "DELETE", ""), (2, 2, "CREATE", "b"), (3, 2, "MODIFY", "y")])
    got = run(S.stream_coalesce_changes(s), tmp_path, "update")
    assert ("1", "NONE", None, False) in got and ("2", "CREATE", "b", True) in got and ("3", "CREATE", "y", False) in got


def test_sequence_gaps_stream(feed, tmp_path):
    s = feed("session string, seq bigint, size bigint", [("s", 0, 5), ("s", 3, 5)], [("s", 1, 5), ("s", 2, 5), ("s", 4, 5)])
    got = run(S.stream_sequence_gaps(s), tmp_path, "update")
    assert got == [("s", False, "1-2,4-4"), ("s", True, "")]


def test_keepalive_stream(feed, tmp_path):
    s = feed("agent_id string, ts timestamp", [("a", at(0)), ("b", at(0))], [("b", at(30))], [("b", at(60))], [("b", at(90))])
    got = run(S.keepalive_timeout(s, 600, 1200), tmp_path)
    a = [g[1] for g in sorted((g for g in got if g[0] == "a"), key=lambda g: g[2])]
    assert a == ["active", "disconnected", "alert"]


def test_multiline_stream(feed, tmp_path):
    s = feed("file string, line_no bigint, line string", [("f", 0, "A one"), ("f", 1, "more")], [("f", 2, "A two"), ("f", 3, "A three")])
    got = run(S.multiline_timeout(s, "^A", 1), tmp_path)
    assert {("f", "A one\nmore"), ("f", "A two")} <= set(got)


def test_tail_and_score(feed, tmp_path, spark):
    s = feed("id bigint, value double", [(1, 1.0)], [(2, 2.0)])
    q = S.tail_and_score(s, lambda df: df.withColumn("score", F.col("value") * 10), str(tmp_path / "o"), str(tmp_path / "c"), once=True)
    q.awaitTermination(60)
    assert sorted((r.id, r.score) for r in spark.read.json(str(tmp_path / "o")).collect()) == [(1, 10.0), (2, 20.0)]
