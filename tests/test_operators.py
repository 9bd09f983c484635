import datetime as dt
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchloom.operators import aggregates as A
from watchloom.operators import enrich as J
from watchloom.operators import filters as L
from watchloom.operators import ranking as W
from watchloom.operators import scoring as R
from watchloom.operators import state as D
from watchloom.operators import versions as V


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


# versions --------------------------------------------------------------------------------------
ORDERED = {
    "dpkg": ["1.0~beta", "1.0", "1.0-1", "1.0-2", "1.0a", "1.0+b", "1.2", "1.10", "2:0.1"],
    "rpm": ["1.0~rc1-1", "1.0-1", "1.0-2", "1.0a-1", "1.0.1-1", "1.10-1", "1:0.5-1"],
    "semver": ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.2.0", "1.10.0"],
    "pep440": ["1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.1", "1.10", "1!0.1"],
    "calver": ["2023.12.31", "2024.1.2", "2024.01.10", "2024.1.10.1"],
    "majorminor": ["1.2", "1.10", "2.0"],
}


@pytest.mark.parametrize("kind", ORDERED)
def test_version_order(spark, kind):
    versions = ORDERED[kind]
    pairs = [(i, j, a, b) for i, a in enumerate(versions) for j, b in enumerate(versions)]
    df = spark.createDataFrame(pairs, "i int, j int, a string, b string").withColumn("s", V.package_compare(F.col("a"), F.col("b"), kind))
    for r in df.collect():
        want = (r.i > r.j) - (r.i < r.j)
        assert r.s == want, (r.a, r.b, r.s)


def test_golden_package(spark):
    v = "2:2.6.2+samba4.17.12+dfsg-0+deb12u1"
    pairs = [(v, "2:2.6.2+samba4.17.10+dfsg-0+deb12u1"), (v.replace(".12+", ".9+"), "2:2.6.2+samba4.17.10+dfsg-0+deb12u1")]
    df = spark.createDataFrame(pairs, "a string, b string").select(V.package_compare(F.col("a"), F.col("b")).alias("s"))
    assert rows(df) == [(1,), (-1,)]


def test_version_kinds(spark):
    df = spark.createDataFrame([("2024.1.2", "2024.1.3"), ("1.0rc1", "1.0"), ("1.0.0-x.y", "1.0.0-x.z"), ("1.0", "2024.1.2"), ("2:1.0-1", "2:1.0-2"), (None, "1.0")], "a string, b string")
    assert rows(df.select(V.version_kind(F.col("a")), V.version_compare(F.col("a"), F.col("b")))) == [("calver", -1), ("pep440", -1), ("semver", -1), ("pep440", None), ("dpkg", -1), (None, None)]


def test_policy_checks(spark):
    content = spark.createDataFrame([("f", "PermitRoot no\nMaxAuth 3\n# x")], "target string, text string")
    term = "struct<kind:string,negate:boolean,pattern:string,op:string,value:double>"
    r = lambda p, neg=False: ("r", neg, p, None, None)
    rules = spark.createDataFrame([(1, "f", [r("^PermitRoot"), r("yes$", True)]), (2, "f", [r("^PermitRoot"), r("yes$")]), (3, "f", [("n", False, r"MaxAuth\s+(\d+)", "<=", 4.0)]), (4, "f", [("n", False, r"MaxAuth\s+(\d+)", ">", 4.0)]), (5, "g", [r("x")])], f"rule_id int, target string, terms array<{term}>")
    assert dict(rows(V.policy_check_eval(content, rules))) == {1: True, 2: False, 3: True, 4: False, 5: False}


# scoring ---------------------------------------------------------------------------------------
def test_isolation_forest_finds_outliers(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(2000)] + [(2000 + i, [8.0, -8.0, 8.0, -8.0]) for i in range(5)]
    df = spark.createDataFrame(data, "id bigint, features array<double>")
    clean = df.filter("id < 2000")
    nodes = R.isolation_forest_fit(clean, trees=60)
    scored = R.isolation_forest_score(df, nodes)
    again = R.isolation_forest_fit(clean, trees=60)
    assert sorted(rows(nodes)) == sorted(rows(again))
    worst = [r.id for r in scored.orderBy("raw").limit(5).collect()]
    assert set(worst) == set(range(2000, 2005))
    assert scored.count() == 2005 and R.contamination_offset(scored, 0.05) < scored.agg(F.avg("raw")).first()[0]


def test_features_and_standardise(spark):
    df = spark.createDataFrame([("5710", 5, ["attack", "x"], ["T1"], "10.0.0.1", {"srcip": "1.1.1.1", "srcport": "22"}, "Failed password invalid user exec", None, dt.datetime(2024, 1, 1, 3))], "rule_id string, level int, groups array<string>, techniques array<string>, agent_ip string, data map<string,string>, full_log string, message string, ts timestamp")
    f = dict(zip(R.FEATURES, R.event_features(df).first().features))
    f.pop("log_size")
    assert f == {"words": 5, "failures": 2, "hour": 3, "off_hours": 1, "ips": 2, "ports": 1, "processes": 1, "level": 5, "rule_id": 5710, "techniques": 1, "suspicious": 1, "data_fields": 2}
    x = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    assert rows(R.standardise(x, x, n=2)) == [([-1.0, 0.0],), ([1.0, 0.0],)]


def test_scores_and_labels(spark):
    one = lambda *c: list(spark.range(1).select(*(x.alias(f"c{i}") for i, x in enumerate(c))).first())
    lit = F.lit
    assert one(R.score_normalise(lit(0.0), lit(-1.0), lit(1.0)), R.score_normalise(lit(-9.0), lit(-1.0), lit(1.0)), R.score_normalise(lit(1.0), lit(1.0), lit(1.0))) == [50, 100, 50]
    assert one(R.multi_dimensional_score(lit(80), lit(3), lit(9), lit(3))["combined_score"], R.time_score(lit(23)), R.time_score(lit(20))) == [57, 20, 0]
    p = one(R.attack_patterns(lit("sudo wget; rm -rf; trojan")))[0]
    assert (p.pattern, p.risk_score, p.suspicious) == ("Malware Execution", 95, True) and "Command Injection" in p.all_patterns
    assert one(R.attack_patterns(lit("nothing")))[0].pattern == "No known pattern"
    assert one(R.severity_boost(lit(80), lit("CRITICAL")), R.severity_boost(lit(95), lit("HIGH")), R.severity_boost(lit(10), lit("LOW")), R.suspicious(lit(71), lit(0.1)), R.similarity_severity(lit(0.65))) == [95, 100, 10, True, "HIGH"]
    a = one(R.threat_assessment(lit(10), lit(30), lit(90), lit(False)))[0]
    assert (a.final_score, a.is_anomaly, a.threat_level) == (90, True, "CRITICAL")
    intel = F.struct(lit("desc").alias("description"), lit("").alias("mitigation"))
    rec = one(R.recommendations(lit(90), lit(30), lit(0), lit("SQL Injection"), lit(True), intel))[0]
    assert len(rec) == 5 and rec[-1] == "Similar to known threat: desc"
    assert one(R.event_class(lit("user login"), lit(False), lit(None)), R.event_tags(lit("ssh port file")), R.event_ips(lit("from 1.2.3.4 to 5.6.7.8"), lit("9.9.9.9")), R.indicator_flags(lit("PowerShell encoded")), R.triage_decision(lit(True), lit(0.65))) == ["authentication", ["authentication", "network", "file_integrity"], ["9.9.9.9", "1.2.3.4", "5.6.7.8"], ["powershell_encoded"], "likely"]
    assert abs(one(R.hypothesis_confidence(lit(0.5), lit(0.5), lit(10)))[0] - 0.65) < 1e-9
    assert abs(one(R.freshness(lit("2024-01-01").cast("timestamp"), lit("2024-01-08").cast("timestamp")))[0] - np.exp(-1)) < 1e-9


def test_technique_match(spark):
    q = spark.createDataFrame([(1, "brute force login")], "query int, text string")
    t = spark.createDataFrame([("T1", "Brute Force", "guess passwords"), ("T2", "Phishing", "fake login page"), ("T3", "Other", "none")], "technique string, name string, description string")
    assert [(r.technique, round(r.score, 3)) for r in R.technique_keyword_match(q, t).orderBy("rank").collect()] == [("T1", 0.5), ("T2", 0.3)]


# state, joins, filters -------------------------------------------------------------------------
def test_diffs_and_changes(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, 1)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "a", 2), (2, "c", 2), (4, "d", 2)], "k int, v string, t int")
    assert sorted(rows(D.snapshot_diff(old, new, ["k"], ignore=["t"]), "k", "operation")) == [(2, "MODIFIED"), (3, "DELETED"), (4, "INSERTED")]
    diff = D.old_values(D.snapshot_diff(old, new, ["k"]), ["v", "t"])
    assert {r.k: r.previous for r in diff.filter("operation = 'MODIFIED'").collect()} == {1: {"t": "1"}, 2: {"v": "b", "t": "1"}}
    state, changes = D.row_upsert(old, new, ["k"])
    assert state.count() == 4 and sorted(rows(changes, "k", "operation")) == [(1, "MODIFIED"), (2, "MODIFIED"), (4, "INSERTED")]
    p = spark.createDataFrame([(1, 1, "CREATE", "x"), (1, 2, "DELETE", ""), (2, 1, "DELETE", ""), (2, 2, "CREATE", "y"), (3, 1, "CREATE", "a"), (3, 2, "MODIFY", "b")], "id int, seq int, operation string, data string")
    assert sorted(rows(D.coalesce_changes(p), "id", "operation", "data", "existing")) == [(2, "CREATE", "y", True), (3, "CREATE", "b", False)]
    m = spark.createDataFrame([({"a": "1"},)], "m map<string,string>").select(D.json_patch(F.col("m"), [("add", "b", "2"), ("remove", "a", None)]).alias("m"))
    assert rows(m) == [({"b": "2"},)]
    keep, gone = D.inventory_clean(old, spark.createDataFrame([(1,)], "k int"), ["k"])
    assert keep.count() == 2 and rows(gone, "k", "operation") == [(1, "DELETED")]
    assert D.candidate_replace(old, new.filter("k = 2"), "k").count() == 3
    assert rows(D.set_version(old, 7).select("version").distinct()) == [(7,)]
    due = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 60), ("b", dt.datetime(2024, 1, 1), 6000)], "t string, last_sync timestamp, interval_seconds int")
    assert rows(D.sync_due(due, F.lit("2024-01-01 00:10:00").cast("timestamp")), "t") == [("a",)]


def test_vulnerability_helpers(spark):
    found = spark.createDataFrame([("a", "i", "1", "C1", "s1"), ("a", "i", "1", "C1", "s2"), ("b", "i", "1", "C2", "s2")], "agent_id string, item string, version string, cve string, source string")
    best = J.source_priority_dedup(found, F.when(F.col("source") == "s2", 0).otherwise(1))
    assert sorted(rows(best, "cve", "source")) == [("C1", "s2"), ("C2", "s2")]
    fix = spark.createDataFrame([("C1", "KB1")], "cve string, update string")
    hot = spark.createDataFrame([("a", "KB1")], "agent_id string, hotfix string")
    assert J.remediation_filter(found, fix, hot).count() == 0
    assert {(r.cve, r.operation) for r in J.solved_by_hotfix(best, fix, hot).collect()} == {("C1", "DELETED"), ("C2", "KEPT")}
    vendor = spark.createDataFrame([("C1", "not defined", 5.0, "high"), ("C2", "text", 0.0, "")], "cve string, description string, score double, severity string")
    default = spark.createDataFrame([("C1", "d1", 1.0, "low"), ("C2", "d2", 2.0, "low")], vendor.schema)
    out = J.description_fallback(best, vendor, default)
    assert {r.cve: (r.description, r.score, r.severity) for r in out.collect()} == {"C1": ("d1", 5.0, "high"), "C2": ("text", 2.0, "low")}
    doc = {r.vulnerability.id: r.vulnerability for r in L.vulnerability_document(out.withColumn("severity", F.when(F.col("cve") == "C1", F.col("severity")))).collect()}
    assert doc["C1"].severity == "High" and not doc["C1"].under_evaluation and doc["C2"].severity == "-" and doc["C2"].under_evaluation


def test_lookups(spark):
    kv = spark.createDataFrame([("S-1-1-0", "Everyone")], "key string, value string")
    dom = spark.createDataFrame([("512", "Domain Admins")], "key string, value string")
    df = spark.createDataFrame([(1, ["S-1-5-21-1-2-3-512", "S-1-1-0", "S-9"])], "id int, sids array<string>")
    assert rows(J.sid_list_describe(df, kv, dom, "sids", "names"), "names") == [(["Domain Admins", "Everyone", "S-9"],)]
    twice = spark.createDataFrame([(1, ["S-9"]), (1, ["S-1-1-0", "S-1-1-0"]), (2, ["S-1-1-0", "S-1-1-0"]), (3, []), (4, None)], df.schema)
    assert sorted(rows(J.lookup_array(twice, kv, "sids", "names"), "id", "sids", "names"), key=str) == sorted([(1, ["S-9"], None), (1, ["S-1-1-0"] * 2, ["Everyone"] * 2), (2, ["S-1-1-0"] * 2, ["Everyone"] * 2), (3, [], None), (4, None, None)], key=str)
    bits = spark.createDataFrame([(0, "read"), (4, "run"), (31, "all")], "bit int, value string")
    masks = spark.createDataFrame([(1, "0x11"), (1, "0x80000001"), (2, "0x2"), (3, None)], "id int, mask string")
    assert sorted(rows(J.lookup_bitmask(masks, bits, "mask", "names"), "mask", "names"), key=str) == sorted([("0x11", ["read", "run"]), ("0x80000001", ["read", "all"]), ("0x2", None), (None, None)], key=str)
    nets = spark.createDataFrame([(167772160, 184549375, "ten"), (167772160, 167772415, "small")], "net_lo bigint, net_hi bigint, record string")
    ips = spark.createDataFrame([(1, "10.0.0.5"), (2, "10.200.0.1"), (3, "11.0.0.1"), (4, None)], "id int, ip string")
    assert dict(rows(J.range_enrich(ips, nets, "ip", "net"), "id", "net")) == {1: "small", 2: "ten", 3: None, 4: None}
    deep = spark.createDataFrame([(1, {"x": {"a": "1"}})], "key int, value map<string,map<string,string>>")
    base = spark.createDataFrame([(1, {"x": {"b": "2"}}), (2, {"x": {"b": "2"}})], "k int, m map<string,map<string,string>>")
    assert dict(rows(J.lookup_merge(base, deep, "k", "m", recursive=True), "k", "m")) == {1: {"x": {"a": "1", "b": "2"}}, 2: {"x": {"b": "2"}}}
    techniques = spark.createDataFrame([("T1", ["G1", "G2"])], "id string, groups array<string>")
    groups = spark.createDataFrame([("G1", "one"), ("G2", "two")], "id string, name string")
    assert rows(J.technique_catalog(techniques, groups, "groups", "names"), "names") == [(["one", "two"],)]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, ["y"])], "id int, s string, tags array<string>")
    with pytest.raises(ValueError):
        L.check_list(df, [])
    assert L.check_list(df, [F.col("s") != "b"]).count() == 1
    assert L.check_expression(df, "s = 'a' or id = 2").count() == 2
    assert L.discard_regex(df, F.col("tags"), "x", is_array=True).count() == 1
    assert L.metadata_prefilter(df, tags=F.array_contains("tags", "zz")).count() == 2
    assert L.metadata_prefilter(df, tags=F.array_contains("tags", "x"), window=F.col("id") < 5).count() == 1
    assert rows(df.select(L.condition_then_stages(F.col("id") == 1, up=F.upper("s")).alias("r"))) [1] == (None,)
    assert rows(df.select(L.value_equals(F.col("s"), "a"), L.field_equals_field(F.col("s"), F.col("s")))) == [(True, True), (False, False)]
    assert L.text_search(df, "a", ["s"], complementary=True).count() == 1
    assert rows(df.select(L.threat_description(F.lit(None).cast("string"), F.col("s")))) == [("Event from unknown: a",), ("Event from unknown: ",)]
    ok = L.schema_conformance(spark.createDataFrame([("1", "x", "1.2.3.4"), ("300", "true", "bad")], "a string, b string, c string"), {"a": "byte", "b": "boolean", "c": "ip"})
    assert rows(ok, "violations") == [(["b"],), (["a", "c"],)]


def test_aggregates_and_sequences(spark):
    r = spark.createDataFrame([(1, "all", 1, "Found", ""), (1, "all", 2, "Invalid", "r2"), (2, "any", 1, "Invalid", "x"), (2, "any", 2, "Found", ""), (3, "none", 1, "Invalid", "x"), (4, "all", 1, "NotFound", ""), (4, "all", 2, "Invalid", "y")], "check_id int, condition string, rule_no int, result string, reason string")
    assert dict(rows(A.check_conditions(r), "check_id", "status")) == {1: "Not applicable", 2: "Passed", 3: "Not applicable", 4: "Failed"}
    s = spark.createDataFrame([("s", i) for i in (0, 1, 2, 5, 6, 9)], "k string, n bigint")
    assert sorted(rows(W.sequence_intervals(s, ["k"], "n"))) == [("s", 0, 2), ("s", 5, 6), ("s", 9, 9)]
    assert sorted(rows(W.sequence_gaps(s, ["k"], "n", F.lit(12)))) == [("s", 3, 4), ("s", 7, 8), ("s", 10, 11)]
    with pytest.raises(ValueError):
        W.sort_fields(s, ["-x"], ["n"])
    assert rows(W.sort_fields(s, ["-n"], ["n"]))[0] == ("s", 9)
    kv = spark.createDataFrame([(f"a{i}",) for i in range(5)] + [("b",)], "key string")
    assert rows(W.prefix_page(kv, "a", 2, 2)) == [("a2",), ("a3",)]
    assert W.merge_knowledge([kv, s]).columns == ["key", "k", "n"]
    files = spark.createDataFrame([("/a", 1, 1), ("/b", 1, 1), ("/c", 2, 1)], "path string, inode int, device int")
    assert rows(A.entry_counts(files)) == [(3, 2)] and rows(L.file_state_search(files, like="/a%")) == [("/a",)]


def test_networks_of_both_kinds(spark):
    nets = [("10.0.0.0/8", "ten"), ("10.1.0.0/16", "ten one"), ("2001:db8::/32", "doc"), ("2001:db8:0:0:0:0:0:1/128", "one"), ("0.0.0.0/0", "any"), ("x/8", "no")]
    ips = {1: "10.1.2.3", 2: "10.2.2.3", 3: "2001:db8::1", 4: "2001:0db8:0000::2", 5: "8.8.8.8", 6: "fe80::1", 7: "no", 8: None, 9: "2001:DB8::0:1"}
    got = J.geo_enrich(spark.createDataFrame([*ips.items()], "id int, ip string"), spark.createDataFrame(nets, "network string, record string"), "ip", "net")
    assert dict(rows(got, "id", "net")) == {1: "ten one", 2: "ten", 3: "one", 4: "doc", 5: "any", 6: None, 7: None, 8: None, 9: "one"}


def test_changes_equal_the_stream_over_all_short_sequences(spark):
    """The batch against the fold that the stream keeps, for every sequence of up to four operations."""
    ops = ("CREATE", "MODIFY", "DELETE")
    every = [s for n in range(1, 5) for s in itertools.product(ops, repeat=n)]

    def fold(seq):
        held = None
        for i, op in enumerate(seq):
            if held is None:
                held = (op != "CREATE", op, i)
            elif not held[0]:
                held = None if op == "DELETE" else (False, "CREATE", i)
            else:
                held = (True, op, i)
        return held

    pending = spark.createDataFrame([(k, i, op, str(i)) for k, s in enumerate(every) for i, op in enumerate(s)], "id int, seq int, operation string, data string")
    got = {r.id: (r.existing, r.operation, r.seq) for r in D.coalesce_changes(pending).collect()}
    assert got == {k: fold(s) for k, s in enumerate(every) if fold(s)}


def test_tables_that_only_one_side_has(spark):
    mine = spark.createDataFrame([(1, "a"), (2, "b")], "t int, checksum string")
    theirs = spark.createDataFrame([(1, "a"), (3, "c")], "t int, checksum string")
    assert rows(D.integrity_mismatch(mine, theirs, ["t"]), "t") == [(2,)] and rows(D.integrity_extra(mine, theirs, ["t"])) == [(3,)]


def test_attack_pattern_literals_miss_nothing(spark):
    texts = ["failed SSH login for bob", "invalid x login", "authentication failure; sshd", "login failed", "failed\nssh", "union all select", "drop the table", "'; x --", "exec master xp_", "powershell -enc", "su - root", ";rm", "; x wget", "plain", ""]
    got = rows(spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.attack_patterns(F.col("t"))["all_patterns"]))
    for t, names in got:
        assert names == [n for n, p, _ in R.ATTACK_PATTERNS if re.search(p, t.lower())], t
    assert got[0][1] == ["SSH Brute Force"]


def test_forest_equals_a_plain_walk(spark):
    """Scores of the forest against a walk node by node; each tree gets about its share of a large table."""
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=3).round(3).tolist()) for i in range(3000)]
    df = spark.createDataFrame(data, "id bigint, features array<double>")
    nodes = R.isolation_forest_fit(df, trees=20, sample=64)
    table = {(r.tree, r.node): r for r in nodes.collect()}
    got = dict(rows(R.isolation_forest_score(df, nodes, sample=64), "id", "raw"))
    mean = lambda n: 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    assert {t for t, _ in table} == set(range(20))
    for i, x in data[:200]:
        total = 0.0
        for t in range(20):
            n = table[t, 0]
            while n.feature >= 0:
                n = table[t, n.left if x[n.feature] < n.cut else n.right]
            total += n.depth
        assert abs(got[i] - (0.5 - 2 ** (-total / 20 / mean(64)))) < 1e-9


def test_silence_counts_fractions_of_a_second(spark):
    now = dt.datetime(2024, 1, 2, 0, 0, 0, 900000)
    silent = [dt.timedelta(hours=6), dt.timedelta(hours=6, microseconds=1), dt.timedelta(hours=6, milliseconds=500), dt.timedelta(hours=18), dt.timedelta(hours=18, microseconds=1)]
    agents = spark.createDataFrame([(k, now - x, "active", now) for k, x in enumerate(silent)], "id int, last_keepalive timestamp_ntz, status string, now timestamp_ntz")
    got = rows(D.agent_disconnect(agents, F.col("now"), 21600, 43200).orderBy("id"), "new_status", "alert")
    assert got == [("active", False), ("disconnected", False), ("disconnected", False), ("disconnected", False), ("disconnected", True)]
