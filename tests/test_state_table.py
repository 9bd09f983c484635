"""A table that a stream keeps: equal to the changes applied in their order, after failures and repetitions too."""

import random

import pytest

from watchloom.streaming.state_table import StateTable
from watchloom.streaming import streams

SCHEMA = "k bigint, seq bigint, v string"


def wanted(changes):
    state = {}
    for k, seq, v, gone in sorted(changes, key=lambda c: c[1]):
        state[k] = None if gone else (k, seq, v)
    return sorted(map(repr, (x for x in state.values() if x)))


def rows(table):
    return sorted(repr(tuple(r)) for r in table.read().collect())


@pytest.fixture
def batches():
    rng = random.Random(5)
    every = [(rng.choice([None, *range(40)]), seq, f"v{seq}", rng.random() < 0.2) for seq in range(300)]
    rng.shuffle(every)  # changes come in any order
    return [every[:150], every[150:160], [], every[160:]]


def frame(spark, batch):
    return spark.createDataFrame(batch, SCHEMA + ", gone boolean")


def test_batches_in_any_order_and_repeated(spark, tmp_path, batches):
    table = StateTable(spark, str(tmp_path / "t"), ["k"], "seq", SCHEMA, buckets=8)
    assert rows(table) == []
    for i, batch in enumerate(batches):
        assert table.apply(frame(spark, batch), i, "gone")
        assert not table.apply(frame(spark, [(1, 10**6, "wrong", False)]), i, "gone")
        assert rows(table) == wanted([c for b in batches[: i + 1] for c in b])
    held = table.manifest()
    assert held["batch"] == 3 and len(held["versions"]) <= 8
    before = rows(table)
    table.vacuum()
    assert rows(table) == before
    with pytest.raises(ValueError):
        StateTable(spark, str(tmp_path / "t"), ["k"], "seq", SCHEMA, buckets=9).read()


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = StateTable(spark, str(tmp_path / "t"), ["k"], "seq", SCHEMA, buckets=32)
    table.apply(frame(spark, [(k, 0, "a", False) for k in range(500)]), 0, "gone")
    table.apply(frame(spark, [(7, 1, "b", False)]), 1, "gone")
    versions = table.manifest()["versions"]
    assert sorted(versions.values()).count(1) == 1 and len(versions) == 32 and table.read().filter("v = 'b'").count() == 1


def test_a_batch_that_is_cut_off_leaves_nothing(spark, tmp_path, batches, monkeypatch):
    table = StateTable(spark, str(tmp_path / "t"), ["k"], "seq", SCHEMA, buckets=8)
    table.apply(frame(spark, batches[0]), 0, "gone")
    before = rows(table)

    def killed(manifest):
        raise RuntimeError("killed")

    monkeypatch.setattr(table, "_put", killed)
    with pytest.raises(RuntimeError):
        table.apply(frame(spark, batches[3]), 1, "gone")
    assert rows(table) == before
    again = StateTable(spark, str(tmp_path / "t"), ["k"], "seq", SCHEMA, buckets=8)
    assert again.apply(frame(spark, batches[3]), 1, "gone") and rows(again) == wanted(batches[0] + batches[3])
    # a driver that is lost between the two renames leaves the old manifest
    again._system.rename(again._file("manifest"), again._file("manifest.old.x"))
    assert rows(again) == before


def test_a_stream_is_killed_and_restarted(spark, tmp_path, batches, monkeypatch):
    base = str(tmp_path)
    for i, batch in enumerate(b for b in batches if b):
        frame(spark, batch).coalesce(1).write.parquet(f"{base}/in{i}")
    feed = lambda: streams.incremental_files(spark, f"{base}/in*", SCHEMA + ", gone boolean", "parquet", 1)
    table = StateTable(spark, f"{base}/t", ["k"], "seq", SCHEMA, buckets=8)
    put, calls = StateTable._put, []

    def fails_once(self, manifest):
        calls.append(manifest["batch"])
        if len(calls) == 2:
            raise RuntimeError("killed")
        put(self, manifest)

    monkeypatch.setattr(StateTable, "_put", fails_once)
    with pytest.raises(Exception, match="killed"):
        table.follow(feed(), f"{base}/cp", "gone").awaitTermination(120)
    table.follow(feed(), f"{base}/cp", "gone").awaitTermination(120)
    assert calls == [0, 1, 1, 2] and rows(table) == wanted([c for b in batches for c in b])
