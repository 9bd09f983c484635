"""Process trees against a walk over the events."""

import datetime
import random

import pytest

from watchloom.operators import process_trees as T

SCHEMA = "id int, host string, pid int, ppid int, ts timestamp, message string"
START = datetime.datetime(2024, 1, 1)


def walked(rows):
    """id → (parent, root, depth)."""
    seen, out = {}, {}
    for i, host, pid, ppid, ts, _ in sorted(rows, key=lambda r: (r[4] or START, r[0])):
        parent = seen.get((host, ppid)) if host is not None and ts is not None and ppid is not None else None
        out[i] = (parent, out[parent][1], out[parent][2] + 1) if parent is not None else (None, i, 1)
        if host is not None and ts is not None and pid is not None:
            seen[host, pid] = i
    return out


@pytest.mark.parametrize("bucket", [7, 10**9])
def test_parents_roots_and_depths(spark, bucket, monkeypatch):
    monkeypatch.setattr(T, "BUCKET", bucket)
    rng = random.Random(3)
    rows = [(k, rng.choice(["prod-1", "test-2", None]), rng.choice([1, 1, 2, 3, 4, None]), rng.choice([1, 2, 3, 4, 9, None]), START + datetime.timedelta(seconds=rng.randrange(60)), "") for k in range(400)]
    rows += [(500, "h", 5, 5, START, ""), (501, "h", 5, 5, START, ""), (502, "h", 6, 5, None, "")]
    linked = T.with_parents(spark.createDataFrame(rows, SCHEMA).repartition(4))
    want = walked(rows)
    assert {r.id: r.parent for r in linked.collect()} == {i: p for i, (p, _, _) in want.items()}
    assert {r.id: (r.root, r.depth) for r in T.roots(linked).collect()} == {i: x[1:] for i, x in want.items()}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    keep = T.stored
    monkeypatch.setattr(T, "stored", lambda df, name: rounds.append(name) or keep(df, name))
    n = 300
    chain = spark.range(n).selectExpr("cast(id as int) as id", "cast(if(id = 0, null, id - 1) as int) as parent")
    assert {r.id: (r.root, r.depth) for r in T.roots(chain).collect()} == {k: (0, k + 1) for k in range(n)}
    assert len(rounds) <= 11
    lost = spark.createDataFrame([(5, 99), (6, 5)], "id int, parent int")
    assert {r.id: (r.root, r.depth) for r in T.roots(lost).collect()} == {5: (99, 2), 6: (99, 3)}


def test_episodes_and_tags(spark):
    at = lambda k: START + datetime.timedelta(seconds=k)
    rows = [(1, "PROD-1", 10, 1, at(0), "sudo run"), (2, "PROD-1", 11, 10, at(1), "cmd base64"), (3, "PROD-1", 12, 11, at(2), "load dll"), (4, "test-9", 10, 1, at(3), "calm"), (5, "x", 7, 1, at(4), None)]
    out = {r.root: r for r in T.tree_episodes(spark.createDataFrame(rows, SCHEMA), T.F.col("message")).collect()}
    first = out[1]
    assert (first.process_count, first.depth, first.start, first.end) == (3, 3, at(0), at(2))
    assert first.indicators == ["suspicious_command", "privilege_escalation", "process_injection"]
    assert first.tags == ["process_episode", "environment:production", "technique:T1055", "technique:T1068", "severity:high"]
    assert out[4].tags == ["process_episode", "environment:development", "severity:low"] and out[5].tags == ["process_episode", "severity:low"]
    assert T.tree_episodes(spark.createDataFrame([], SCHEMA), T.F.col("message")).count() == 0
