"""New items against a history with Bloom filters: no false drop, whatever the filters say."""

import pytest

from watchloom.sources import history as H

SCHEMA = "bucket_name string, name bigint, size int"


def keys(df):
    return sorted(repr((r.bucket_name, r.name)) for r in df.collect())


@pytest.mark.parametrize("size", [64, 1 << 14])
def test_nothing_new_is_dropped_and_nothing_old_comes(spark, tmp_path, size):
    history = H.History(spark, str(tmp_path / "h"), ["bucket_name", "name"], buckets=8, size=size)
    first = [("a" if k % 3 else None, k, 1) for k in range(400)] + [("a", None, 2), ("a", 7, 3)]
    df = spark.createDataFrame(first, SCHEMA)
    assert keys(history.unseen(df)) == keys(df)
    history.extend(df, "one")
    history.extend(spark.createDataFrame([("z", 1, 1)], SCHEMA), "one")  # a run that is in isn't added again
    later = first[::7] + [("a" if k % 3 else None, k, 1) for k in range(1000, 1300)] + [("z", 1, 1), (None, None, 1), ("a", None, 9)]
    old = {x[:2] for x in first}
    fresh = history.unseen(spark.createDataFrame(later, SCHEMA))
    assert fresh.columns == ["bucket_name", "name", "size"]
    assert keys(fresh) == sorted(repr(x[:2]) for x in later if x[:2] not in old)
    history.extend(fresh, "two")
    assert history.unseen(spark.createDataFrame(later + first, SCHEMA)).count() == 0
    rate = history.false_alarms(spark.createDataFrame([("q", k, 1) for k in range(2000)], SCHEMA))
    assert rate > 0.9 if size == 64 else rate < 0.02
    assert history.unseen(df.limit(0)).count() == 0


def test_a_run_that_was_cut_off_counts_for_nothing(spark, tmp_path, monkeypatch):
    history = H.History(spark, str(tmp_path / "h"), ["name"], buckets=4)
    df = spark.createDataFrame([(None, k, 1) for k in range(50)], SCHEMA)
    history.extend(df.filter("name < 10"), "a")
    history.extend(df, "b")
    history._system.delete(history._file("done/b"), False)
    assert history.runs() == ["a"] and history.unseen(df).count() == 40
    history.extend(df, "b")
    assert history.unseen(df).count() == 0


def test_only_buckets_of_possible_members_are_read(spark, tmp_path):
    history = H.History(spark, str(tmp_path / "h"), ["name"], buckets=64)
    history.extend(spark.createDataFrame([(None, k, 1) for k in range(5000)], SCHEMA), "a")
    out = history.unseen(spark.createDataFrame([(None, 17, 1), (None, 10**9, 1)], SCHEMA))
    read = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in out.inputFiles() if "/keys/" in f}
    assert len(read) <= 2 and [r.name for r in out.collect()] == [10**9]
