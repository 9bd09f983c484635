"""Operators do the whole job: every query, alert, change and row counts."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from watchloom import queries as own
from watchloom.operators import aggregates as A
from watchloom.operators import enrich as J
from watchloom.operators import filters as L
from watchloom.operators import scoring as R
from watchloom.operators import search as S
from watchloom.operators import state as D

SF = "/root/testdata/sf0.001"


def test_every_vector_query_is_answered(spark, monkeypatch):
    monkeypatch.setattr(S, "VECTORS", 7)
    monkeypatch.setattr(S, "QUERIES", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32).astype(float)
    v[41] = v[40]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    got = S.vector_topk(df, df.filter("vec_id % 4 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 5).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, r + 1): i for q in range(0, 60, 4) for r, i in enumerate(sorted(range(60), key=lambda i: (-round(float(u[q] @ u[i]), 9), i))[:5])}
    assert {(r["query"], r["rank"]): r["id"] for r in got} == want


def test_vector_blocks_are_scored_some_queries_at_a_time(monkeypatch):
    rng = np.random.default_rng(7)
    qs, vs = rng.normal(size=(25, 4)), rng.normal(size=(30, 4))
    monkeypatch.setattr(S, "SCORES", 100)
    out = list(S._near(qs, np.arange(25), vs, np.arange(30), np.ones(30, bool), 2))
    assert len(out) == 9 and [r["query"] for x in out for r in x.to_pylist()] == np.repeat(np.arange(25), 2).tolist()
    assert [r["id"] for x in out for r in x.to_pylist()] == np.argsort(-(qs @ vs.T), axis=1)[:, :2].ravel().tolist()


def test_every_text_query_with_all_words(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 30) % 200) for _ in range(50)]
    texts[7] = texts[3]
    words = [t.split() for t in texts]
    avg, n = sum(map(len, words)) / 50, 50
    df = {t: sum(t in w for w in words) for w in words for t in w}

    def raw(q, d):
        return sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * words[d].count(t) * 2.5 / (words[d].count(t) + 1.5 * (0.25 + 0.75 * len(words[d]) / avg)) for t in set(words[q]) if t in words[d])

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = S.bm25_topk(docs, docs.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("query"), "text"), 4, "doc_id", "text").collect()
    want = {(q, r + 1): d for q in range(0, 50, 5) for r, d in enumerate(sorted((d for d in range(50) if raw(q, d) > 0), key=lambda d: (-round(raw(q, d), 9), d))[:4])}
    assert {(r["query"], r["rank"]): r["id"] for r in got} == want
    assert all(abs(r["raw"] - raw(r["query"], r["id"])) < 1e-9 for r in got)
    near = docs.filter("doc_id < 9").select(F.lit(0).cast("long").alias("query"), F.col("doc_id").alias("id"), (F.col("doc_id") / 9).alias("similarity"))
    best = max(raw(0, x) for x in range(50))
    total = {d: 0.6 * (d / 9 if d < 9 else 0) + 0.3 * raw(0, d) / best + 0.1 * d / 50 for d in range(50) if d < 9 or raw(0, d) > 0}
    top = S.hybrid_topk(near, docs, docs.filter("doc_id = 0").select(F.col("doc_id").alias("query"), "text"), F.col("id") / 50, 6, "doc_id", "text")
    assert [r["id"] for r in top.orderBy("rank").collect()] == sorted(total, key=lambda d: (-round(total[d], 6), d))[:6]


def test_texts_share_blocks_by_kind_and_sums_are_exact(monkeypatch):
    rng = np.random.default_rng(3)
    docs = [rng.choice(np.arange(60), 40) + 1000 * (i % 2) for i in range(80)]  # two kinds without a common word
    marks, kinds = S._kinds(docs[:20], 2)
    pdf = S.pd.DataFrame({"id": [str(i) for i in range(80)], "w": docs, "prior": 0.0})
    packed = S.pd.concat(S._doc_blocks(marks, kinds)([pdf]))
    assert sorted({i % 2 for i in np.frombuffer(x, np.int64).tolist()} == {k} for x, k in zip(packed["ids"], (0, 1), strict=True)) in ([False, False], [True, True])
    assert [len(np.frombuffer(x, np.int64)) for x in packed["ids"]] == [40, 40]
    asked = S.pd.DataFrame({"query": ["0", "2"], "scale": [1.0, 0.5], "t": [np.unique(docs[0]), np.unique(docs[2])], "near": [[], []], "plus": [[], []]})
    asked["idf"] = [1 + t / 7 for t in asked["t"]]
    q, d = S.pd.concat(S._query_blocks(marks, kinds)([asked])).iloc[0], next(x for _, x in packed.iterrows() if 0 in np.frombuffer(x["ids"], np.int64))
    read = lambda row, **kinds: [np.frombuffer(row[c], k) for c, k in kinds.items()]
    (tf,), ids = read(d, tf=np.int32), np.frombuffer(d["ids"], np.int64)
    for common in (0.0, 0.5, 2.0):
        monkeypatch.setattr(S, "COMMON", common)
        sums = S._Sums(len(ids), *read(q, qt=np.int64, idf=float, qe=np.int32, qn=np.int32, scale=float), *read(d, dt=np.int64, dn=np.int32, dd=np.uint16), tf.astype(float))
        want = np.array([[s * sum((1 + t / 7) * (docs[i] == t).sum() for t in ts) for i in ids] for s, ts in zip(asked["scale"], asked["t"], strict=True)])
        near = sums.near(0, 2)
        assert (np.abs(near - want) <= want * sums.slack).all()
        i, j = np.nonzero(want >= 0)
        assert np.allclose(sums.exact(i, j), want.ravel(), rtol=1e-13)


def test_hybrid_scores_all_pairs_once(spark, monkeypatch):
    calls, hits = [], S._text_hits
    monkeypatch.setattr(S, "_text_hits", lambda docs, asked, *a: (calls.append(asked.select("query").collect()), hits(docs, asked, *a))[1])
    docs = spark.createDataFrame([(0, "a b c"), (1, "a d e f g h i"), (2, "d d d d"), (3, "b c x"), (4, "d z y")], "doc_id long, text string").repartition(2)
    near = spark.createDataFrame([(0, 3, 0.5)], "query long, id long, similarity double")
    ask = lambda ids: docs.filter(F.col("doc_id").isin(ids)).select(F.col("doc_id").alias("query"), "text")
    run = lambda ids: {(r["query"], r["rank"]): r["id"] for r in S.hybrid_topk(near, docs, ask(ids), F.lit(0.0), 2, "doc_id", "text").collect()}
    assert run([0]) == {(0, 1): 3, (0, 2): 0} and len(calls) == 1
    calls.clear()
    foreign = spark.createDataFrame([(7, "d")], "query long, text string")  # the best text for it is another than its own
    got = S.hybrid_topk(near.limit(0), docs, foreign, F.lit(0.0), 3, "doc_id", "text").orderBy("rank").collect()
    assert [r["id"] for r in got] == [2, 4, 1] and abs(got[0]["score"] - 0.3) < 1e-9 and len(calls) == 3


def copied_texts():
    """(id, text) with three copies of most, some in other case, and rows that stand for themselves: without an id, of a repeated id, null and empty texts."""
    rng = np.random.default_rng(5)
    own = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 12) % 40) for _ in range(14)]
    rows = [(7 * i + 3, own[i % 14].upper() if i % 5 == 0 else own[i % 14]) for i in range(56)]
    return [*rows, (None, own[2]), (None, own[2]), (500, own[3]), (500, "w1 w2"), (501, None), (502, "")]


def raw_scores(rows):
    """(query, text) places in rows → BM25."""
    words = [(t or "").lower().split() for _, t in rows]
    avg, n = sum(map(len, words)) / sum(t is not None for _, t in rows), len(rows)
    df = {t: sum(t in w for w in words) for w in words for t in w}
    idf = {t: math.log((n - x + 0.5) / (x + 0.5) + 1) for t, x in df.items()}
    part = [{t: idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in set(w)} for w in words]
    return {(i, j): x for i in range(n) for j in range(n) if (x := sum(part[j].get(t, 0) for t in set(words[i]))) > 0}


def best_of(scores, k, digits):
    order = sorted(scores, key=lambda x: (-round(x[1], digits), x[0] is None, x[0]))[:k]
    return [(i, round(s, 6)) for i, s in order]


def test_copies_of_texts_and_queries_are_met_once(spark, monkeypatch):
    rows = copied_texts()
    raw, met, packed = raw_scores(rows), [], S._text_hits
    asking = [i for i, (d, _) in enumerate(rows) if d not in (None, 500) and d % 2 == 0]

    def counted(texts, asked, *a):
        met.append((sum(len(x.ids) // 8 for x in texts.select("ids").collect()), asked.count()))
        return packed(texts, asked, *a)

    monkeypatch.setattr(S, "_text_hits", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(rows[i][0], rows[i][1]) for i in asking], "query long, text string")
    got = {}
    for r in sorted(S.bm25_topk(docs, asked, 6, "doc_id", "text").collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r["id"], round(r["raw"], 6)))
    want = {rows[i][0]: best_of([(rows[j][0], raw[i, j]) for j in range(len(rows)) if (i, j) in raw], 6, 9) for i in asking}
    assert got == {q: x for q, x in want.items() if x}
    texts = len({t.lower() for d, t in rows[:56]})
    assert met == [(texts + 5, len({(rows[i][1] or "").lower() for i in asking} - {""}))]  # two without an id, two of one id and an empty one


def test_copies_in_hybrid_search_keep_their_own_nearness_and_freshness(spark, monkeypatch):
    """Copies of a text differ by nearness (below zero too) and freshness, some by less than scores are rounded to."""
    rows = copied_texts()
    raw, rng = raw_scores(rows), np.random.default_rng(6)
    asking = [i for i, (d, _) in enumerate(rows) if d not in (None, 500) and d % 2 == 0]
    near = {(rows[i][0], int(d)): round(float(x), 3) for i in asking for d, x in zip(rng.permutation([d for d, _ in rows if d not in (None, 500)] + [900])[:7], rng.uniform(-0.5, 1, 7), strict=True)}
    near |= {(9999, 3): 0.5, (rows[asking[0]][0], None): 0.4}
    fresh = lambda d: 0.0 if d is None else (d % 11) / 11 + (d % 4) * 4e-6
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(rows[i][0], rows[i][1]) for i in asking], "query long, text string")
    semantic = spark.createDataFrame([(q, d, x) for (q, d), x in near.items()], "query long, id long, similarity double")
    id_ = F.col("id")
    prior = id_ % 11 / 11 + (id_ % 4) * 4e-6
    want = {}
    for i in asking:
        q = rows[i][0]
        best = max((raw[i, j] for j in range(len(rows)) if (i, j) in raw), default=1)
        scores = [(d, 0.3 * raw[i, j] / best + 0.1 * fresh(d) + 0.6 * (near.get((q, d), 0) if d is not None else 0)) for j, (d, _) in enumerate(rows) if (i, j) in raw]
        scores += [(d, 0.6 * x + 0.1 * fresh(d)) for (a, d), x in near.items() if a == q and (d is None or not any((i, j) in raw for j in range(len(rows)) if rows[j][0] == d))]
        want[q] = best_of(scores, 5, 6)
    want[9999] = best_of([(3, 0.3 + 0.1 * fresh(3))], 5, 6)
    for share in (0.1, 9.0):
        monkeypatch.setattr(S, "COPIED", share)
        got = {}
        for r in sorted(S.hybrid_topk(semantic, docs, asked, prior, 5, "doc_id", "text").collect(), key=lambda r: (r["query"], r["rank"])):
            got.setdefault(r["query"], []).append((r["id"], round(r["score"], 6)))
        assert got.keys() == want.keys()
        for q, x in want.items():
            assert [i for i, _ in got[q]] == [i for i, _ in x] and np.allclose([s for _, s in got[q]], [s for _, s in x], atol=1.1e-6)


def test_words_are_cut_as_spark_cuts_them(spark, monkeypatch):
    """And some texts at a time."""
    monkeypatch.setattr(S, "CUT", 7)
    texts = ["a  b\tc\n", "", " ", "x\x0by\x0cz\rw", "é\xa0é\x1cé\u2003é", "b a b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr(r"filter(split(t, '\\s+'), x -> x <> '') AS w")
    want, got = [r.w for r in df.collect()], [w.tolist() for w in S._words(pa.array(texts))]
    slices, batch = [], pa.RecordBatch.from_pydict({"id": list(range(6)), "text": texts})
    list(S._worded(lambda each: (slices.append(x) or x.drop(columns="w") for x in each))(iter([batch, batch.slice(0, 0)])))
    assert [w.tolist() for x in slices for w in x["w"]] == got and [i for x in slices for i in x["id"]] == list(range(6)) and max(map(len, slices)) < 4
    assert [len(w) for w in got] == [len(w) for w in want]
    assert len({(h, x) for a, b in zip(got, want, strict=True) for h, x in zip(a, b, strict=True)}) == len({h for a in got for h in a}) == len({x for a in want for x in a})


def test_ids_that_are_null_or_very_large_and_vectors_of_any_kind(spark):
    big = 2**60 + 1
    near = [(big, [1.0, 0.0]), (big + 1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (7, [0.0, 0.0])]
    odd = [(20, [1.0]), (21, [1.0, 2.0, 3.0]), (22, [1.0, None]), (23, [float("nan"), 1.0]), (24, None), (25, []), (26, [float("inf"), 1.0])]
    df = spark.createDataFrame(near + odd, "vec_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(big + 2, [2.0, 0.0]), (None, [1.0, 0.0]), (5, [3.0]), (6, [1.0, 1.0, 1.0, 1.0]), (8, [None, 1.0])], "query long, vector array<double>")
    got = {(r["query"], r["rank"]): (r["id"], round(r["similarity"], 9)) for r in S.vector_topk(df, asked, 4).collect()}
    assert got == {(big + 2, 1): (big, 1.0), (big + 2, 2): (big + 1, 1.0), (big + 2, 3): (None, 1.0), (big + 2, 4): (7, 0.0), (5, 1): (20, 1.0)}
    assert S.vector_topk(df.limit(0), asked, 4).count() == S.vector_topk(df, asked.limit(0), 4).count() == 0
    docs = spark.createDataFrame([(big, "a b"), (None, "a b"), (big + 1, "a b"), (3, None), (4, ""), (None, "z")], "doc_id long, text string").repartition(2)
    asked = spark.createDataFrame([(big + 1, "a a b"), (None, "a"), (9, "z"), (10, None)], "query long, text string")
    got = {(r["query"], r["rank"]): r["id"] for r in S.bm25_topk(docs, asked, 5, "doc_id", "text").collect()}
    assert got == {(big + 1, 1): big, (big + 1, 2): big + 1, (big + 1, 3): None, (9, 1): None}
    assert S.bm25_topk(docs.limit(0), asked, 5, "doc_id", "text").count() == 0


def test_every_alert_gets_its_events_without_a_product(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(rng.integers(0, 50)), "u1" if i % 3 else f"u{i % 7}", f"h{i % 5}" if i % 4 else None) for i in range(300)]
    df = spark.createDataFrame(data, "id int, ts int, user string, host string").repartition(3)
    out = J.correlated_events(df, df, ["user", "host"])
    want = {}
    for a in data:
        hits = sorted((e[1], e[0]) for e in data if e[0] != a[0] and (e[2] == a[2] or (a[3] and e[3] == a[3])))
        want |= {(a[0], r + 1): e for r, (_, e) in enumerate(hits[:10])}
    assert {(r["alert_id"], r["rank"]): r["event_id"] for r in out.collect()} == want
    severities = own.QUERIES["alert_episodes"](spark, SF)
    assert severities.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert {r[0] for r in severities.select("severity").distinct().collect()} >= {"high", "medium", "low"}  # sf0.001 has no critical one


def test_no_join_of_an_entity_with_itself(spark):
    df = spark.range(3000).select("id", F.col("id").alias("ts"), F.lit("u").alias("user"))
    joins = J.correlated_events(df, df, ["user"])
    joins.collect()
    plan = joins._jdf.queryExecution().executedPlan().toString()
    assert "<= 11" in plan


def test_agent_ids_keep_all_digits(spark):
    tasks = spark.createDataFrame([(1, 7, 0, 0), (2, 999, 0, 0), (3, 1000, 0, 0), (4, 123456, 0, 0)], "task_id int, agent_id int, create_time long, last_update_time long")
    assert [r["agent_id"] for r in L.task_query(tasks).collect()] == ["007", "999", "1000", "123456"]


def test_every_customer_and_user_is_in_the_feed(spark):
    got = {r["key"]: r["payload"] for r in own.QUERIES["feed_upsert"](spark, SF).collect()}
    state = {r["c_custkey"]: r["c_name"] for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    for e in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda e: e["event_id"]):
        state.pop(e["user_id"], None)
        if e["event_type"] != "error":
            state[e["user_id"]] = e["props"]
    assert got == state


def test_checksum_tree_grows_with_the_table(spark):
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    sizes = {"empty": 1, "one": 20, "two": 300, "three": 3000}
    data = [(g, sha(f"{g}{i // 2 if g == 'two' else i}")) for g, n in sizes.items() for i in range(n)]

    def tree(cs, depth):
        kept = {}
        for c in cs:
            kept.setdefault(sha(c)[:depth], []).append(c)
        sums = {b: sha(",".join(sorted(f"{c}:{v.count(c)}" for c in set(v)))) for b, v in kept.items()}
        for level in range(depth, 0, -1):
            up = {}
            for b, c in sums.items():
                up.setdefault(b[: level - 1], []).append(b + c)
            sums = {b: sha("".join(sorted(v))) for b, v in up.items()}
        return sums[""]

    want = {g: (tree(cs := [c for x, c in data if x == g], min(3, max(0, math.ceil(math.log(len(set(cs)) / 4) / math.log(16))))), n) for g, n in sizes.items()}
    got = A.checksum_tree(spark.createDataFrame(data, "g string, checksum string").repartition(3), ["g"], bucket_rows=4, digits=1)
    assert {r["g"]: (r["table_checksum"], r["n"]) for r in got.collect()} == want


def test_integrity_mismatch_holds_no_table(spark):
    mine = spark.range(20000).select((F.col("id") % 2).alias("g"), F.sha1(F.col("id").cast("string")).alias("checksum"))
    theirs = mine.withColumn("checksum", F.when((F.col("g") == 1) & F.col("checksum").startswith("00"), F.lit("old")).otherwise(F.col("checksum")))
    out = D.integrity_mismatch(mine, theirs, ["g"])
    assert {r["g"]: r["count"] for r in out.groupBy("g").count().collect()} == {1: 10000}
    assert "depth" in out._jdf.queryExecution().optimizedPlan().toString()


def test_forest_has_all_trees_and_scores_as_walked(spark, monkeypatch):
    seen = []
    fit = R.isolation_forest_fit
    monkeypatch.setattr(R, "isolation_forest_fit", lambda *a, **b: seen.append(fit(*a, **b)) or seen[-1])
    own.QUERIES["anomaly_scores"](spark, SF)
    assert seen[0].select("tree").distinct().count() == 200
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    nodes = fit(df)
    walk = {(n["tree"], n["node"]): n for n in nodes.collect()}

    def depth(tree, r):
        n = walk[tree, 0]
        while n["feature"] >= 0:
            n = walk[tree, n["left"] if r[n["feature"]] < n["cut"] else n["right"]]
        return n["depth"]

    norm = R._mean_path(256)
    got = {r["id"]: r["raw"] for r in R.isolation_forest_score(df, nodes).collect()}
    for i in range(0, 300, 30):
        assert abs(got[i] - (0.5 - 2 ** (-np.mean([depth(t, x[i]) for t in range(200)]) / norm))) < 1e-9
