"""Indicator matching, order statistics and checksum trees against brute force."""

import hashlib
import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from watchloom.operators import aggregates as A
from watchloom.operators import indicators as I
from watchloom.operators import merkle as M
from watchloom.operators import quantiles as Q
from watchloom.operators import scoring as R
from watchloom import queries as own
from watchloom.operators import search as S
from watchloom.operators import state as D
from watchloom.operators import vector_index as V


# ---- indicators


def occurrences(text, literal):
    return [k for k in range(len(text or "")) if text.startswith(literal, k)]


@pytest.mark.parametrize("shard_bytes", [40, 1 << 20])
def test_literal_hits_equal_brute_force(spark, shard_bytes):
    rng = random.Random(4)
    texts = [(k, "".join(rng.choice("aabcé\U0001f600") for _ in range(rng.choice([0, 3, 40, 400])))) for k in range(60)] + [(None, "abab"), (7, "abab"), (7, None)]
    literals = {"".join(rng.choice("aabcé") for _ in range(rng.randrange(1, 5))) for _ in range(60)} | {"abab", "\U0001f600a"}
    rows = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("literal", F.lit("clash")).repartition(3)
    listed = spark.createDataFrame([(x,) for x in [*literals, "aa", "aa", "", None]], "literal string")
    literals.add("aa")
    want = sorted(((i is None, i or 0), x, at[0], len(at)) for i, t in texts for x in literals if (at := occurrences(t, x)))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.literal, r.first_at, r.n) for r in I.literal_hits(rows, listed, "text", "doc_id", shard_bytes=shard_bytes).collect()) == want
    assert len(I.shards(listed, shard_bytes=shard_bytes)) == (-(-sum(len(x.encode()) for x in literals) // 40) if shard_bytes == 40 else 1)
    assert I.literal_hits(rows, listed.limit(0), "text", "doc_id").count() == I.literal_hits(rows.limit(0), listed, "text", "doc_id").count() == 0


def test_intelligence_meets_events(spark):
    intel = spark.createDataFrame([(1, "one", {"ip": ["10.0.0.1", "10.0.0.1"], "domain": ["evil.org"], "actor": ["bob"]}), (2, "two", {"domain": ["evil.org"]}), (3, "three", {}), (4, "four", None)], "intel_id int, title string, entities map<string,array<string>>")
    events = spark.createDataFrame([("a", "to 10.0.0.1 and evil.org by bob"), ("b", "evil.org"), ("c", "bob"), ("d", None)], "event_id string, log string")
    got = sorted((r.event_id, r.intel_id, r.title, r.ioc) for r in I.intel_in_texts(events, intel, "log", "event_id").collect())
    assert got == [("a", 1, "one", ["10.0.0.1", "evil.org"]), ("a", 2, "two", ["evil.org"]), ("b", 1, "one", ["evil.org"]), ("b", 2, "two", ["evil.org"])]


def test_hits_and_pairs_leave_in_slices(spark, monkeypatch):
    """Workers pass on some hits at a time, and texts meet intelligence in blocks without a shuffle of the pairs."""
    rng = random.Random(6)
    letters = [a + b for a in "abcdé" for b in "xyz"]
    texts = [(k if k % 9 else None, " ".join(rng.choice(letters) for _ in range(rng.randrange(12)))) for k in range(300)]
    told = [(k % 70, f"t{k % 70}", {"ip": rng.sample(letters, 3), "actor": ["ax"]}) for k in range(90)]
    rows = spark.createDataFrame(texts, "id int, t string").repartition(2)
    intel = spark.createDataFrame(told, "intel_id int, title string, entities map<string,array<string>>")
    for name, n in (("HELD", 50), ("FOUND", 40), ("PIECES", 16), ("BLOCKS", 2)):
        monkeypatch.setattr(I, name, n)
    want = {}
    for i, t in texts:
        for k, title, e in told:
            for x in e["ip"]:
                if x in t:
                    want.setdefault((str(i), k, title), set()).add(x)
    out = I.intel_in_texts(rows, intel, "t", "id", shard_bytes=20)
    got = out.collect()
    assert {(str(r.id), r.intel_id, r.title): r.ioc for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "intel_id" not in "".join(x for x in plan.split("MapInArrow")[0].splitlines() if "Exchange" in x)
    listed = spark.createDataFrame([(x,) for x in letters], "literal string")
    hits = I.literal_hits(rows, listed, "t", "id")
    assert hits.count() == sum(x in t for _, t in texts for x in letters)
    slices = list(I._meetings(pa.array(range(200)), pa.array([letters] * 200), pa.array([1, 2]), pa.array(["a", "b"]), pa.array([letters[:5], letters[3:]])))
    assert sum(x.num_rows for x in slices) == 400 and max(x.num_rows for x in slices) <= 50


def test_texts_are_shuffled_once_and_like_pairs_leave_together(spark):
    """The result grows with the square: neighbours of one piece and of the same literals take little room in its files, and blocks are made where texts lie."""
    pieces, literals = pa.array([7, 8, 9]), pa.array([["a", "b"], ["b"], ["a", "c"]])
    (got,) = I._meetings(pa.array(range(40)), pa.array([["a", "b"], ["a"], ["b"], ["c", "a"]] * 10), pieces, pa.array(["x", "y", "z"]), literals)
    runs = lambda *names: 1 + sum(x != y for x, y in itertools.pairwise(zip(*(got[n].to_pylist() for n in names), strict=True)))
    assert got.num_rows == 40 + 20 + 30 and runs("intel_id", "title") == 3 and runs("intel_id", "ioc") == 6
    intel = spark.createDataFrame([(1, "one", {"ip": ["a"]})], "intel_id int, title string, entities map<string,array<string>>")
    out = I.intel_in_texts(spark.createDataFrame([("e", "a")], "id string, t string"), intel, "t", "id")
    plan = out._jdf.queryExecution().executedPlan().toString().split("CartesianProduct")[1]
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan  # one shuffle of each side


def test_workers_pass_on_some_hits_at_a_time(spark, monkeypatch):
    """A batch of ten thousand texts gives its hits in slices, and its texts are unpacked few at a time."""
    runs, rows = [], spark.createDataFrame([(1, "x")], "id int, t string")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    monkeypatch.setattr(I, "HELD", 100)
    I.literal_hits(rows, spark.createDataFrame([(x,) for x in "abc"], "literal string"), "t", "id")
    I.regex_hits(rows, {"a": ("a", [["a"]])}, "t", "id")
    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": ["abcabc"] * 999 + [None]})
    hits = list(runs[0](iter([batch])))
    assert sum(x.num_rows for x in hits) == 2997 and max(x.num_rows for x in hits) < 103
    assert [(r["id"], r["literal"], r["first_at"], r["n"]) for r in hits[0].slice(0, 3).to_pylist()] == [(0, "a", 0, 2), (0, "b", 1, 2), (0, "c", 2, 2)]
    named = list(runs[1](iter([batch])))[0].to_pylist()
    assert [r["names"] for r in named] == [["a"]] * 999 + [[]]


def test_expressions_run_on_hits_only(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Drop the TABLE"), (2, "drop it"), (3, "table drop"), (4, None), (5, "x9")], "id int, t string")
    rules = {"sql": (r"drop.*table", [["drop", "table"]]), "digit": (r"\d", []), "never": (r".", [["absent"]])}
    assert {r.id: r.names for r in I.regex_hits(rows, rules, "t", "id").collect()} == {1: ["sql"], 2: [], 3: [], 4: [], 5: ["digit"]}


def test_patterns_by_columns_are_those_of_the_struct(spark):
    texts = ["sudo wget; rm -rf; trojan", "nothing", "Failed SSH login", "union all select", None, "port 22 scan"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    a = {r.id: r.p for r in R.with_attack_patterns(rows, "t", "p").collect()}
    assert a == {r.id: r.p for r in rows.select("id", R.attack_patterns(F.col("t")).alias("p")).collect()}


# ---- order statistics


@pytest.mark.parametrize("kind", ["double", "bigint"])
@pytest.mark.parametrize("buckets", [3, 4096])
def test_order_statistics_of_any_distribution(spark, kind, buckets, monkeypatch):
    monkeypatch.setattr(Q, "BUCKETS", buckets)
    rng = np.random.default_rng(5)
    values = {"double": [*rng.normal(size=200), *(10.0 ** rng.integers(-3, 9, 60)), 1.5, 1.5, 1.5, -0.0, 1e300, -1e300], "bigint": [*rng.integers(-50, 50, 200).tolist(), 2**62, 2**62 + 1, -(2**62), 0, 0, 0]}[kind]
    values = [float(x) if kind == "double" else int(x) for x in values]
    rows = spark.createDataFrame([(x,) for x in [*values, None, *([float("nan")] if kind == "double" else [])]], f"v {kind}").repartition(3)
    ordered = sorted(values)
    ranks = [0, 1, 57, 100, len(values) - 1, -1, -2, len(values)]
    n, got = Q.order_statistics(rows, "v", ranks)
    assert n == len(values) and got == [*(ordered[r] for r in ranks[:-1]), None]
    want = spark.createDataFrame([(float(x),) for x in values], "v double").agg(F.percentile("v", F.array(*map(F.lit, (0.02, 0.5, 0.98))))).first()[0]
    assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(Q.percentiles(rows, "v", [0.02, 0.5, 0.98]), want, strict=True))


def test_statistics_of_no_rows_and_one(spark):
    none = spark.createDataFrame([], "score double")
    assert Q.percentiles(none, "score", [0.5]) == [None] and Q.percentiles(none.unionByName(spark.createDataFrame([(4.0,)], "score double")), "score", [0.1, 1.0]) == [4.0, 4.0]
    assert A.score_statistics(none).first().median is None and A.anomaly_threshold(none).first().threshold == 40
    assert A.calibration_percentiles(none, "score").first().score_min is None


@pytest.mark.parametrize("cap", [0, 1, 7, 40, 100, 1000])
def test_the_newest_rows_stay(spark, cap):
    rng = random.Random(6)
    data = [(k, rng.choice([None, *range(12)]), rng.choice([None, *range(30)])) for k in range(90)]
    rows = spark.createDataFrame(data, "id int, day int, tie int").repartition(4)
    order = lambda r: (r[1] is None, -(r[1] or 0), r[2] is None, r[2] or 0)
    kept = {r.id: (None, r.day, r.tie) for r in D.max_rows_cap(rows, cap, "day", "tie").collect()}
    assert sorted(map(order, kept.values())) == sorted(map(order, data))[:cap]
    dated = rows.withColumn("at", F.expr("timestamp_ntz'2020-03-08 01:59:59.5' + make_dt_interval(day)"))
    assert {(r.day, r.tie) for r in D.max_rows_cap(dated, cap, "at", "tie").collect()} <= {(x[1], x[2]) for x in data}
    assert sorted(order((0, r.day, r.tie)) for r in D.max_rows_cap(dated, cap, "at", "tie").collect()) == sorted(map(order, data))[:cap]


# ---- checksum trees


def sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


@pytest.mark.parametrize("leaf_rows", [2, 50, 100_000])
def test_resync_makes_both_sides_equal(spark, leaf_rows):
    rng = random.Random(7)
    mine = [(g, k, sha(f"{g}{k}")) for g in ("a", "b", None) for k in range(700)] + [("new", k, "x") for k in range(5)] + [("a", None, "n")]
    theirs = [(g, k, "changed" if rng.random() < 0.004 else c) for g, k, c in mine if rng.random() > 0.004 and g != "new"] + [("a", k, "more") for k in range(900, 903)] + [("old", 1, "y")]
    schema = "g string, k int, checksum string"
    a, b = spark.createDataFrame(mine, schema).repartition(3), spark.createDataFrame(theirs, schema).repartition(2)
    sent, spans = M.resync(a, b, ["g"], ["k"], leaf_rows=leaf_rows)
    assert sorted(map(repr, M.applied(b, sent, spans, ["g"], ["k"]).collect())) == sorted(map(repr, a.collect()))
    differing = len(set(mine) ^ set(theirs))
    assert sent.count() <= max(4 * leaf_rows, 8) * differing
    assert {r.g for r in spans.filter("action = 'clear'").collect()} >= {"old"}
    same, none = M.resync(a, a, ["g"], ["k"], leaf_rows=leaf_rows)
    assert same.count() == none.count() == 0
    gone, cleared = M.resync(a.limit(0), b, ["g"], ["k"], leaf_rows=leaf_rows)
    assert gone.count() == 0 and M.applied(b, gone, cleared, ["g"], ["k"]).count() == 0


def test_descent_follows_only_nodes_that_differ(spark):
    mine = spark.range(20_000).select(F.lit("t").alias("g"), F.col("id").alias("k"), F.sha1(F.col("id").cast("string")).alias("checksum"))
    theirs = mine.withColumn("checksum", F.when(F.col("k") == 77, "old").otherwise(F.col("checksum")))
    a, b = (M.build(x, ["g"], ["k"], depth=2) for x in (mine, theirs))
    differ = M.descend(a, b).collect()
    assert len(differ) == 1 and differ[0].leaf == sha("2:77")[:4] and differ[0].mine == differ[0].theirs < 20
    assert [level.count() for level in a.levels[:2]] == [1, 256]
    assert [r.k for r in M.to_send(a, M.descend(a, b)).filter("k = 77").collect()] == [77]


# ---- vector index


def test_index_holds_every_row_and_recalls(spark, monkeypatch):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(20, 16))
    data = [(k if k % 50 else None, (middles[k % 20] + 0.35 * rng.normal(size=16)).tolist()) for k in range(3000)]
    data += [(9000 + k, [1.0] * 16) for k in range(1500)] + [(1, [0.0] * 16), (2, None), (3, [1.0]), (4, [None] * 16)]  # a third are copies of one vector
    monkeypatch.setattr(V, "ROWS", 100)
    rows = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(4)
    index = V.build(rows, cells=40)
    sizes = [(r.cell, len(r.ids) // 8) for r in index.blocks.collect()]
    assert sum(n for _, n in sizes) == 4501 and max(n for _, n in sizes) <= 200 and len({c for c, _ in sizes}) > 20
    asked = rows.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    exact = S.vector_topk(rows, asked, 10)
    got = V.recall(V.search(index, asked, 10, 8), exact).first()
    assert got.queries == exact.select("query").distinct().count() and got.recall >= 0.9
    whole = V.search(index, asked, 10, 40)
    assert {(r["query"], r["rank"]): r["id"] for r in whole.collect()} == {(r["query"], r["rank"]): r["id"] for r in exact.collect()}
    assert 1 <= V.tuned_probes(index, rows, asked.limit(40), 10, 0.9) <= 16
    assert V.search(index, asked.limit(0), 10, 4).count() == V.search(V.build(rows.limit(0)), asked, 10, 4).count() == 0


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    got = V.recall(own.QUERIES["vector_topk_index"](spark, "/root/testdata/sf0.1"), S.vector_topk(vectors, asked, 10).withColumn("similarity", F.round("similarity", 6)))
    assert got.first().recall >= 0.9


def test_queries_are_copied_for_their_cells_in_slices(spark, monkeypatch):
    """A batch of queries that look into many cells would be thousands of copies of each vector."""
    runs, rng = [], np.random.default_rng(3)
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query bigint, vector array<double>")

    def caught(self, run, schema):
        runs.append(run)
        raise LookupError

    monkeypatch.setattr(type(asked), "mapInPandas", caught)
    monkeypatch.setattr(V, "AT_ONCE", 1000)
    with pytest.raises(LookupError):
        V.search(V.Index(V.unit(rng.normal(size=(50, 2))), asked), asked, 3, 40)
    batch = pd.DataFrame({"id": [str(k) for k in range(100)], "v": list(rng.normal(size=(100, 2)))})
    out = list(runs[0](iter([batch])))
    assert sum(map(len, out)) == 4000 and max(len(x) * 2 for x in out) <= 1000
    assert all(n == 40 for n in pd.concat(out).groupby("id")["asked"].nunique())
