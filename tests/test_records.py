"""The record source: ranges of any size, encodings, formats, and streams that read nothing twice."""

import gzip
import json
import random

import pytest

from watchloom.sources import records as R


@pytest.fixture(scope="module")
def spark(spark):
    R.register(spark)
    return spark


def load(spark, path, **options):
    df = spark.read.format(R.NAME).option("path", str(path))
    for k, v in options.items():
        df = df.option(k, v)
    return df.load()


def texts(seed=1, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("aüਊĊ\U0001f600 ,x1") for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16-le", "utf-16-be"])
def test_every_record_is_read_once_by_ranges(tmp_path, encoding):
    for mark, end in ((True, "\n"), (False, "\r\n")):
        own = texts()
        data = end.join(own).encode(encoding)
        head = {"utf-8": b"\xef\xbb\xbf", "utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}[encoding] if mark else b""
        path = tmp_path / f"x{mark}"
        path.write_bytes(head + data)
        said = "auto" if mark else encoding
        for split in (1, 7, 64, 10**6):
            got = [x for r in R.ranges(str(path), 0, path.stat().st_size, split) for x in R.Records(str(path), said).between(r.lo, r.hi)] if split > 1 or encoding == "utf-8" else None
            if got is not None:
                assert [x for _, x in got] == [x for x in own if x] and len({s for s, _ in got}) == len(got), (encoding, mark, split)


def test_large_chunks_and_records(tmp_path, monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 10)
    own = ["a" * 95, "b", "", "c" * 33, "d"]
    path = tmp_path / "f"
    path.write_text("\n".join(own))
    for split in (3, 10, 40):
        assert [x for r in R.ranges(str(path), 0, path.stat().st_size, split) for _, x in R.Records(str(path)).between(r.lo, r.hi)] == [x for x in own if x]
    assert R.Records(str(path)).complete(0, path.stat().st_size) == path.stat().st_size - 1
    assert R.Records(str(path)).complete(0, 60) == 0 and R.Records(str(path)).complete(0, 98) == 98


def test_files_formats_and_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "sub" / "b.csv").write_text('name,note\nx,"a, b"\ny\n')
    (tmp_path / "sub" / "c.log").write_bytes("plain 1\r\n\r\nzwei ü".encode())
    (tmp_path / "d.gz").write_bytes(gzip.compress(b"p 1\np 2\n" * 50))
    (tmp_path / "_hidden").write_text("no")
    (tmp_path / "empty").write_text("")
    got = load(spark, tmp_path, kind="auto", splitBytes="6").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.start):
        by.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.kind, r.record))
    assert by["a.json"] == [("json", '{"k": 1}'), ("json", '{"k": 2}')]
    assert [(k, json.loads(x)) for k, x in by["b.csv"]] == [("csv", {"name": "x", "note": "a, b"}), ("csv", {"name": "y", "note": ""})]
    assert by["c.log"] == [("plain", "plain 1"), ("plain", "zwei ü")] and len(by["d.gz"]) == 100 and set(by) == {"a.json", "b.csv", "c.log", "d.gz"}
    assert load(spark, tmp_path, splitBytes="6").select("kind").distinct().count() == 1
    assert load(spark, tmp_path / "none").count() == 0


def test_a_stream_reads_nothing_twice(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()

    def run():
        stream = spark.readStream.format(R.NAME).option("path", str(src)).option("splitBytes", "9").load().select("record")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r[0] for r in spark.read.schema("record string").parquet(out).collect())

    (src / "a").write_text("one\ntwo\nhalf")
    assert run() == ["one", "two"]
    (src / "a").write_text("one\ntwo\nhalf done\nmore\n")
    (src / "b").write_text("other\n")
    assert run() == ["half done", "more", "one", "other", "two"]
    assert run() == ["half done", "more", "one", "other", "two"]
    (src / "a").write_text("anew\n")  # rotated: shorter than what was read
    assert run() == ["anew", "half done", "more", "one", "other", "two"]
