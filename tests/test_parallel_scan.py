"""Multi-line sources scan a file in chunks: equal to a scan from front to back, whatever the chunks, and without a window over a file."""

import random
import re

import pytest
from pyspark.sql import functions as F

from watchloom.sources import text


def scanned(lines, opens, closes):
    """(first line, lines) of events in order: a line that opens begins one, the line after one that closes too."""
    events, fresh = [], True
    for no, line in enumerate(lines):
        if fresh or opens(line):
            events.append((no, []))
        events[-1][1].append(line)
        fresh = closes(line)
    return events


@pytest.fixture(scope="module")
def files():
    rng = random.Random(11)
    made = {f"f{k}": [rng.choice(["open a", "x", "y", "", "end", "** Alert 5", "msg=audit(1) k", "msg=audit(2) k"]) for _ in range(rng.choice([1, 7, 60, 200]))] for k in range(6)}
    return made | {"none": ["x"] * 50, "all": ["open a"] * 20}


@pytest.fixture
def lines(spark, files):
    rows = [(f, no, line) for f, own in files.items() for no, line in enumerate(own)]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, "file string, line_no bigint, line string").repartition(5)


def got(df, *more):
    return sorted((r.file, r.line_no, r.event, *(r[m] for m in more)) for r in df.collect())


@pytest.mark.parametrize("chunk", [3])
def test_chunks_do_not_change_events(lines, files, chunk, monkeypatch):
    monkeypatch.setattr(text, "CHUNK", chunk)
    never, want = (lambda _: False), []
    starts = [(f, no, "\n".join(x)) for f, own in files.items() for no, x in scanned(own, lambda x: x.startswith("open"), never) if x[0].startswith("open")]
    assert got(text.regex_start_source(lines, "^open")) == sorted(starts)
    ends = [(f, no, " ".join(x), len(x)) for f, own in files.items() for no, x in scanned(own, never, lambda x: x == "end")]
    assert got(text.regex_end_source(lines, "^end$", "space"), "n_lines") == sorted(ends)
    blocks = [(f, no, "\n".join(x)) for f, own in files.items() for no, x in scanned(own, lambda x: x.startswith("** Alert"), lambda x: x == "") if x[0].startswith("** Alert")]
    assert got(text.alert_block_source(lines)) == sorted((f, no, x.rstrip("\n")) for f, no, x in blocks)
    for f, own in files.items():
        before = None
        for no, line in enumerate(own):
            if m := re.search(r"msg=audit\((\d)\)", line):
                if m[1] == before:
                    want[-1] = (*want[-1][:2], want[-1][2] + " " + line)
                else:
                    want.append((f, no, line))
                before = m[1]
    assert got(text.audit_record_source(lines)) == sorted(want)
    assert max(len(r[2].split(" m")) for r in got(text.audit_record_source(lines, most=2))) == 2


@pytest.mark.parametrize(("pattern", "most"), [(r"open a\n(.*\n)*end$", None), (r"x\n(.*\n)*y$", 4), ("never", None)])
@pytest.mark.parametrize("chunk", [40])
def test_gathered_buffers_settle(lines, files, pattern, most, chunk, monkeypatch):
    monkeypatch.setattr(text, "CHUNK", chunk)
    want = []
    for f, own in files.items():
        held = []
        for no, line in enumerate(own):
            held.append((no, line))
            event = "\n".join(x for _, x in held)
            if re.search(pattern, event):
                want.append((f, held[0][0], event, len(held)))
                held = []
            elif most and len(held) >= most:
                held = []
    assert got(text.regex_all_source(lines, pattern, most), "n_lines") == sorted(want)


def test_totals_belong_to_the_close_that_follows(spark, monkeypatch):
    monkeypatch.setattr(text, "CHUNK", 2)
    rows = ["1-5-3-2", "junk", "1-6-3-1", "1--3--9--4--2", "2-5-3-7", "2--7--1--0--0", "3-1-1-1"]
    lines = spark.createDataFrame([("t", k, x) for k, x in enumerate(rows)], "file string, line_no bigint, line string")
    out = {r.hour: ([tuple(a) for a in r.alerts], r.total_alerts, r.events) for r in text.hourly_totals_source(lines).collect()}
    assert out == {1: ([(5, 3, 2), (6, 3, 1)], 3, 9), 2: ([(5, 3, 7)], 7, 1)}


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    n = 40_000
    (tmp_path / "big.log").write_text("".join(f"id {k}\nstatus {k % 7}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = text.numbered_lines(spark, str(tmp_path))
        assert lines.agg(F.min("line_no"), F.max("line_no"), F.count_distinct("line_no")).first() == (0, 2 * n - 1, 2 * n)
        events = text.regex_start_source(lines, "^id ")
        assert events.filter("n_lines = 2").count() == n
        plan = events._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    windows = re.findall(r"windowspecdefinition\((\w+)#\d+, (\w+)", plan)
    assert set(windows) == {("file", "__chunk")}  # rows of the text are only ordered within a chunk; the summaries by chunk, the splits when they are written
