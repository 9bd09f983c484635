import json

from pyspark.sql import functions as F

from watchloom.operators import extract as X
from watchloom.sources import cloud, incremental, sinks, text


def put(tmp_path, name, content, mode="w", **kw):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    with open(p, mode, **kw) as f:
        f.write(content)
    return str(p)


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_json_lines_and_history(spark, tmp_path):
    p = put(tmp_path, "a/x-alerts-1.json", '{"id":1}\n\nbad\n{"id":2}\n')
    assert sorted(rows(text.json_lines_source(spark, p, "id int"))) == [(1,), (2,)]
    kept = text.json_lines_source(spark, p, "id int", quarantine=True)
    assert (None, "bad") in rows(kept, "id", "_corrupt_record")
    assert text.alert_history_source(spark, str(tmp_path), "id int").count() == 2
    assert rows(text.json_log_source(spark, p, "id int", team="x").filter("event.id = 2"), "event.id", "labels") == [(2, {"team": "x"})]
    assert rows(text.plain_line_source(spark, p, 3).filter("line = 'bad'"), "line") == [("bad",)]


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name in "ab":
        put(tmp_path, f"many/{name}.log", "".join(f"{name}{i}{chr(13) if i % 2 else ''}\n" for i in range(3000)))
    put(tmp_path, "many/none.log", "")
    put(tmp_path, "many/open.log", "x\n\ny", "w")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = text.numbered_lines(spark, str(tmp_path / "many"))
        got = {(r.file.rsplit("/", 1)[-1], r.line_no): r.line for r in lines.collect()}
        pairs = [(r.event, r.n_lines, r.line_no) for r in text.regex_all_source(lines.filter("file like '%a.log'"), r"a\d+\na\d+$").orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {(f"{n}.log", i): f"{n}{i}" for n in "ab" for i in range(3000)} | {("open.log", 0): "x", ("open.log", 1): "", ("open.log", 2): "y"}
    assert pairs == [(f"a{i}\na{i + 1}", 2, i) for i in range(0, 3000, 2)]


def test_multiline_sources(spark, tmp_path):
    p = put(tmp_path, "m.log", "a1\na2\nb1\nb2\nc1\n")
    lines = text.numbered_lines(spark, p)
    events = lambda df: [r.event for r in df.orderBy("line_no").collect()]
    assert events(text.fixed_multiline_source(lines, 2)) == ["a1 a2", "b1 b2", "c1"]
    assert events(text.strict_chunk_source(lines, 2)) == ["a1\na2", "b1\nb2"]
    assert events(text.regex_start_source(lines, "1$", "none")) == ["a1a2", "b1b2", "c1"]
    assert events(text.regex_end_source(lines, "2$", "tab")) == ["a1\ta2", "b1\tb2", "c1"]
    assert events(text.regex_all_source(lines, r"^a1\na2$|^b1\nb2$")) == ["a1\na2", "b1\nb2"]
    assert rows(text.delimiter_multiline_source(spark, put(tmp_path, "d.log", "x\ny---\n z ---  "), "---")) == [("x\ny",), ("z",)]


def test_lines_of_a_chunk_are_joined_before_they_are_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "CHUNK", 2)  # events reach over chunks
    lines = text.numbered_lines(spark, put(tmp_path, "m.log", "x\na1\na2\na3\na4\nb1\n\nc1\n"))
    for df, want in ((text.regex_start_source(lines, "1$"), ["a1\na2\na3\na4", "b1\n", "c1"]), (text.regex_end_source(lines, "4$"), ["x\na1\na2\na3\na4", "b1\n\nc1"])):
        assert [(r.event, r.n_lines) for r in df.orderBy("line_no").collect()] == [(x, x.count("\n") + 1) for x in want]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate(keys=[file" in plan and any("Aggregate(keys=" in x and "__chunk" in x and "__g" in x for x in plan.splitlines())
        assert not any("Exchange hashpartitioning" in x and "__chunk" in x and "__g" in x for x in plan.splitlines())


ALERT = """** Alert 1700000000.123: - syslog,sshd,
2023 Nov 14 22:13:20 host1->/var/log/auth.log
Rule: 5710 (level 5) -> 'Attempt to login'
Src IP: 10.0.0.9
User: bob
Nov 14 22:13:20 host1 sshd[99]: Invalid user bob

** Alert 1700000001.1: - agentd,
2023 Nov 14 22:13:21 (agent7) 10.1.1.1->syscheck
Rule: 550 (level 7) -> 'Changed'
Integrity changed
** Alert 1700000002.1: - x,
2023 Nov 14 22:13:22 h->y
"""


def test_alert_blocks(spark, tmp_path):
    blocks = text.alert_block_source(text.numbered_lines(spark, put(tmp_path, "alerts.log", ALERT)))
    fields = text.alert_block_fields(blocks)
    got = rows(fields.orderBy("timestamp"), "hostname", "location", "rule_id", "level", "description", "user", "tags", "program", "src_ip")
    assert got[0] == ("host1", "/var/log/auth.log", "5710", 5, "Attempt to login", "bob", ["syslog", "sshd"], "sshd", "10.0.0.9")
    assert got[1][:5] == ("agent7", "syscheck", "550", 7, "Changed") and len(got) == 2
    line = rows(text.forwarded_alert_source(fields.filter("rule_id = '5710'")))[0][0]
    assert line.startswith("level: 5; rule: 5710; location: /var/log/auth.log; srcip: 10.0.0.9; user: bob")


def test_alert_blocks_sort_their_lines_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text, "CHUNK", 4)  # blocks reach over chunks
    blocks = text.alert_block_source(text.numbered_lines(spark, put(tmp_path, "alerts.log", ALERT)))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in x and "__chunk" in x and "line_no" in x for x in plan.splitlines()) == 1
    assert sorted(r.n_lines for r in blocks.collect()) == [2, 4, 6]


def test_audit_and_databases(spark, tmp_path):
    p = put(tmp_path, "audit.log", "type=A msg=audit(1.0:5): a\ntype=B msg=audit(1.0:5): b\nnoise\ntype=C msg=audit(1.0:6): c\n")
    got = rows(text.audit_record_source(text.numbered_lines(spark, p)).orderBy("line_no"), "audit_id", "event")
    assert [g[0] for g in got] == ["1.0:5", "1.0:6"] and got[0][1].endswith("audit(1.0:5): b")
    p = put(tmp_path, "pg.log", "2024-01-01 00:00:00 UTC LOG: a\n\tmore\n2024-01-01 00:00:01 UTC LOG: b\n")
    assert [r.n_lines for r in text.db_log_source(text.numbered_lines(spark, p), "postgresql").orderBy("line_no").collect()] == [2, 1]
    p = put(tmp_path, "ids.log", "[**] [1:1] x [**]\nPriority: 1\n\n[**] [1:2] y [**]\n")
    assert text.ids_block_source(text.numbered_lines(spark, p)).count() == 2


def test_other_text_sources(spark, tmp_path):
    p = put(tmp_path, "scan.log", "Host: 1.2.3.4 (h)\tPorts: 22/open/tcp//ssh///, 80/open/tcp//http///, 81/closed/tcp//x///\n")
    assert rows(text.scan_report_source(text.numbered_lines(spark, p)).orderBy("port")) == [("1.2.3.4", 22, "tcp", "ssh"), ("1.2.3.4", 80, "tcp", "http")]
    p = put(tmp_path, "u16.log", "one\r\nzwei ü\r\n".encode("utf-16"), "wb")
    assert rows(text.utf16_source(spark, p).orderBy("start"), "line") == [("one",), ("zwei ü",)]
    framed = spark.createDataFrame([("1:/var/log/x:msg: text",), ("1:[7] (web) 10.0.0.1->/var/log/y:hi",), ("1:a|:b:m",), ("bad",)], "value string")
    got = rows(text.framed_event_source(framed), "queue", "location", "agent_id", "agent_name", "message", "ok")
    assert got[:3] == [("1", "/var/log/x", None, None, "msg: text", True), ("1", "/var/log/y", "7", "web", "hi", True), ("1", "a:b", None, None, "m", True)] and not got[3][5]
    p = put(tmp_path, "m.log", '2024/01/02 03:04:05 w-rootcheck[1]: INFO: start\nnoise\n{"timestamp":"2024/01/02 03:04:06","tag":"x","level":"error","description":"d"}\n')
    assert rows(text.manager_log_source(text.numbered_lines(spark, p)).orderBy("timestamp"), "tag", "level", "description") == [("rootcheck", "info", "start"), ("x", "error", "d")]
    p = put(tmp_path, "totals.log", "0-5710-5-3\n0-550-7-1\n0--4--90--2--0\n1--0--10--0--0\n")
    got = rows(text.hourly_totals_source(text.numbered_lines(spark, p)).orderBy("hour"), "hour", "total_alerts", "events", "alerts")
    assert got[0][:3] == (0, 4, 90) and [tuple(a) for a in got[0][3]] == [(5710, 5, 3), (550, 7, 1)] and got[1][3] == []
    p = put(tmp_path, "state", "# x\nreceived='12'\ndropped='0.5'\n")
    assert rows(text.kv_state_source(text.numbered_lines(spark, p)), "state") == [({"received": 12.0, "dropped": 0.5},)]
    p = put(tmp_path, "svc/qmail/current", "@4000 hello there\nskip\n")
    assert rows(text.multilog_source(spark, p)) == [("qmail", "4000", "hello there")]
    p = put(tmp_path, "ev.xml", "<Events><Event><System><EventID>5</EventID></System></Event><Event><System><EventID>6</EventID></System></Event></Events>")
    assert sorted(rows(text.event_channel_source(spark, p, "System struct<EventID:int>"), "System.EventID")) == [(5,), (6,)]


def test_flow_and_balancers(spark, tmp_path):
    p = put(tmp_path, "flow.log", "version account-id x x x x x x x x x x x x\n2 123 eni 10.0.0.1 10.0.0.2 443 5000 6 10 840 1700000000 1700000060 ACCEPT OK\n")
    assert rows(cloud.flow_log_source(spark, p), "srcaddr", "start", "action") == [("10.0.0.1", "2023-11-14T22:13:20Z", "ACCEPT")]
    alb = ["h2", "t", "app/x", "10.0.0.1:2817", "10.0.0.5:80", *["0.1"] * 3, "200", "200", "0", "57", '"GET https://x/ HTTP/2"', '"curl 7"', *["-"] * 13, '"10.0.0.5:80 10.0.0.6:81"', "-"][:26]
    line = " ".join([*alb[:25], '"10.0.0.5:80 10.0.0.6:81"', '"200 200"', "-", "-"])
    got = rows(cloud.app_lb_log_source(spark, put(tmp_path, "alb.log", line + "\n")), "client_ip", "client_port", "request", "target_ip_list", "target_port_list")
    assert got == [("10.0.0.1", "2817", "GET https://x/ HTTP/2", "10.0.0.5 10.0.0.6", "80 81")]
    nlb = " ".join(["tls", "2.0", "t", "net/x", "l", "72.21.218.154:51341", "172.100.100.185", *["5"] * 13])
    assert rows(cloud.network_lb_log_source(spark, put(tmp_path, "nlb.log", nlb)), "client_ip", "client_port", "destination_ip", "destination_port") == [("72.21.218.154", "51341", "172.100.100.185", None)]
    clb = " ".join(["t", "x", "1.1.1.1:1", "2.2.2.2:2", *["0"] * 7, '"GET / HTTP/1.1"', '"a b"', "-", "-"])
    assert rows(cloud.classic_lb_log_source(spark, put(tmp_path, "clb.log", clb)), "request", "user_agent") == [("GET / HTTP/1.1", "a b")]


def test_json_cloud_sources(spark, tmp_path):
    one = lambda i: json.dumps({"timestamp": i, "httpRequest": {"headers": [{"name": "Host", "value": f"h{i}"}, {"name": "Secret", "value": "x"}]}}, separators=(",", ":"))
    p = put(tmp_path, "waf.log", one(1) + one(2) + "\nbad\n" + '{"timestamp":3}\n')
    got = rows(cloud.firewall_json_source(spark, p, "timestamp bigint, httpRequest struct<headers:array<struct<name:string,value:string>>>"), "timestamp", "headers")
    assert got == [(1, {"host": "h1"}), (2, {"host": "h2"})]
    f = {"service": {"serviceName": "Guard", "action": {"portProbeAction": {"portProbeDetails": [{"p": 1}, {"p": 2}]}}}}
    schema = "service struct<serviceName:string,action:struct<portProbeAction:struct<portProbeDetails:array<struct<p:int>>>>>"
    found = cloud.findings_jsonl_source(spark, put(tmp_path, "g.jsonl", json.dumps(f) + "\n"), schema)
    assert rows(cloud.probe_detail_explode(found), "source", "probe_detail.p") == [("guard", 1), ("guard", 2)]
    lines = [{"resourceId": "r", "configuration": {"g": ["a", "b"], "z": "one"}}, {"resourceId": "s", "configuration": {"g": "c", "z": {"name": "two"}}}]
    p = put(tmp_path, "conf.json", "\n".join(map(json.dumps, lines)))
    assert rows(cloud.config_history_source(spark, p, {"g": "id", "z": "name"}).orderBy("resource_id"), "g", "z") == [(["a", "b"], ["one"]), (["c"], ["two"])]
    p = put(tmp_path, "trail.json", json.dumps({"Records": [{"eventName": "E", "requestParameters": "text"}, {"eventName": "F", "requestParameters": {"a": 1}}]}))
    assert rows(cloud.audit_trail_source(spark, p).orderBy("eventName"), "requestParameters") == [('{"string":"text"}',), ('{"a":1}',)]
    p = put(tmp_path, "hub.json", json.dumps({"id": "1", "detail-type": "Findings", "source": "s", "detail": {"findings": ["f1", "f2"]}}))
    assert rows(cloud.hub_findings_source(spark, p), "detail_type", "finding") == [("Findings", "f1")]
    p = put(tmp_path, "cols.json", json.dumps({"tables": [{"name": "T", "columns": [{"name": "a", "type": "s"}, {"name": "b", "type": "s"}], "rows": [["1", "2"], ["3", "4"]]}]}))
    assert rows(cloud.columnar_rows_source(spark, p), "record") == [({"a": "1", "b": "2"},), ({"a": "3", "b": "4"},)]


def test_csv_and_blob_sources(spark, tmp_path):
    put(tmp_path, "u/dnslogs/a.csv", ",".join(f'"d{i}"' for i in range(13)) + "\n")
    put(tmp_path, "u/iplogs/b.csv", ",".join(f'"i{i}"' for i in range(7)) + "\n")
    got = cloud.dns_security_log_source(spark, str(tmp_path / "u"))
    assert sorted(rows(got, "kind", "timestamp", "destination_port")) == [("dnslogs", "d0", None), ("iplogs", "i0", "i5")]
    line = "own bkt [06/Feb/2019:00:00:38 +0000] 192.0.2.3 req id REST.GET key \"GET /x HTTP/1.1\" 200 - 1 2 3 4 \"-\" 'S3 Console' - host SigV4 c a h t"
    assert rows(cloud.object_access_log_source(spark, put(tmp_path, "s3.log", line)), "time", "request_uri", "user_agent", "tls_version") == [("06/Feb/2019:00:00:38 +0000", "GET /x HTTP/1.1", "S3 Console", "t")]
    put(tmp_path, "auto/a.json", '{"a":1}\n{"a":2}\n')
    put(tmp_path, "auto/b.csv", 'x,y\n1,"2,3"\n')
    put(tmp_path, "auto/c.log", "plain 1\n")
    got = rows(cloud.auto_format_source(spark, str(tmp_path / "auto")).orderBy("kind", "record"), "kind", "record")
    assert got == [("csv", '{"x":"1","y":"2,3"}'), ("json", '{"a":1}'), ("json", '{"a":2}'), ("plain", "plain 1")]
    put(tmp_path, "blob/a.json", json.dumps({"records": [{"x": 1}, {"x": 2}]}))
    put(tmp_path, "blob/empty.json", "")
    assert sorted(rows(cloud.blob_records_source(spark, str(tmp_path / "blob"), "json_file", "t", ".json"))) == [('{"x":1}', "t"), ('{"x":2}', "t")]
    assert rows(cloud.blob_records_source(spark, put(tmp_path, "i.json", '{"a":1}\nbad\n'), "json_inline", "t"), "record") == [('{"a":1}',)]
    assert rows(cloud.gcs_access_log_source(spark, put(tmp_path, "gcs.csv", '"a","b"\n"1","2"\n'))) == [("1", "2")]
    events = spark.createDataFrame([("s", 5, '{"a":"x"}'), ("s", 10, "y"), ("t", 5, "z")], "stream string, ts_ms bigint, message string")
    assert cloud.log_stream_range_source(events, "s", 0, 10).count() == 1 and cloud.log_stream_range_source(events, "s", 0, 10, "x", "a").count() == 0


def test_knowledge_bases_and_rules(spark, tmp_path):
    p = put(tmp_path, "attack.json", json.dumps([{"id": "T1", "name": "n", "description": "d", "tactics": ["x"]}]))
    assert rows(cloud.attack_kb_source(spark, p), "episode_id", "summary") == [("ATTACK-T1", "n: d")]
    p = put(tmp_path, "yara.json", json.dumps([{"name": "n", "strings": ["s"]}]))
    assert rows(cloud.yara_kb_source(spark, p), "episode_id", "tags") == [("YARA-n", [])]
    p = put(tmp_path, "adv.json", json.dumps([{"id": "1", "title": "t", "severity": "HIGH", "cves": ["C"]}]))
    assert rows(cloud.advisory_kb_source(spark, p), "tags", "entities") == [(["high"], {"cve": ["C"]})]
    p = put(tmp_path, "rules.json", json.dumps({"id": 1, "level": 3, "groups": ["syslog", "pci_dss_10.2.5", "gdpr_IV"]}))
    assert rows(cloud.rule_catalog_source(spark, p), "groups", "pci_dss", "gdpr", "hipaa") == [(["syslog"], ["10.2.5"], ["IV"], [])]


def test_incremental(spark):
    objects = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", 3)], "name string, created int")
    seen = objects.filter("name in ('a', 'b')")
    assert sorted(rows(incremental.high_water_mark_filter(objects, seen), "name")) == [("c",), ("d",)]
    assert incremental.high_water_mark_filter(objects, seen.limit(0)).count() == 4
    assert sorted(rows(incremental.already_processed_filter(objects, seen, ["name"]), "name")) == [("c",), ("d",)]
    bounds = spark.createDataFrame([(2, 2)], "lo int, hi int")
    m = objects.withColumnRenamed("created", "modified")
    assert sorted(rows(incremental.processed_window_filter(m, bounds, F.lit(1)), "name")) == [("a",), ("d",)]
    assert rows(incremental.widened_window(bounds, m)) == [(1, 3)]
    a = spark.createDataFrame([("s", "t1", 5, 9)], "k string, token string, start_time int, end_time int")
    b = spark.createDataFrame([("s", "t2", 3, 7), ("n", "t", 1, 2)], "k string, token string, start_time int, end_time int")
    assert sorted(rows(incremental.merge_range_bookmark(a, b, ["k"]))) == [("n", "t", 1, 2), ("s", "t2", 3, 9)]
    assert rows(incremental.retain_last_n(objects, ["created"], "name", 1).orderBy("name"), "name") == [("a",), ("c",), ("d",)]
    paths = spark.createDataFrame([("/x/2024/1/5/f",), ("/x/2023/12/31/f",), ("/none",)], "p string")
    assert rows(incremental.path_date_filter(paths, "p", "2024-01-01"), "p") == [("/x/2024/1/5/f",)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "2024-01-01"), (2, "", "2024-03-01"), (1, "a", "2024-01-01")], "id int, raw string, day string")
    p = str(tmp_path)
    sinks.append_file_sink(df, f"{p}/f")
    assert spark.read.json(f"{p}/f").count() == 3
    bad = sinks.index_sink(df, f"{p}/i", F.when(F.col("id") == 1, "wl-x").otherwise("Bad"))
    assert bad.count() == 1 and spark.read.json(f"{p}/i").count() == 2
    sinks.routed_outputs(df, f"{p}/r", {"one": F.col("id") == 1, "all": F.lit(True)})
    assert spark.read.json(f"{p}/r").groupBy("output").count().orderBy("output").collect()[0]["count"] == 3
    sinks.daily_snapshot_sink(df, None, "id", F.col("day"), f"{p}/d")
    sinks.daily_snapshot_sink(df, spark.read.json(f"{p}/d"), "id", F.col("day"), f"{p}/d")
    assert spark.read.json(f"{p}/d").count() == 2
    sinks.raw_archive_sink(df, "raw", F.col("day"), f"{p}/a")
    assert spark.read.text(f"{p}/a").count() == 2
    sinks.enriched_alert_sink(df, ["id"], ["raw"], f"{p}/e")
    assert spark.read.json(f"{p}/e").count() == 3
    assert sinks.retention_delete(spark, f"{p}/d", "2024-03-02", 30) == ["day=2024-01-01"]
    assert spark.read.json(f"{p}/d").count() == 1


def test_extraction_jobs(spark):
    def got(job, *raws, **kw):
        df = spark.createDataFrame([(r,) for r in raws], "raw string")
        return [(r.extracted, r.fits) for r in job(df, "raw", **kw).collect()]

    assert got(X.url_extract_job, "https://u@h.example:8443/p?q=1#f", "nope")[0][0].asDict() == {"scheme": "https", "username": "u", "domain": "h.example", "port": 8443, "path": "/p", "query": "q=1", "fragment": "f"}
    assert got(X.url_extract_job, "nope") == [(None, False)]
    assert got(X.json_extract_job, '{"a":1}', "{", schema="a int")[1] == (None, False)
    assert [x[1] for x in got(X.csv_extract_job, 'a,"b,c"', "a", names=["x", "y"])] == [True, False]
    assert got(X.dsv_extract_job, "a|'b|c'", names=["x", "y"], separator="|", quote="'")[0][0].y == "b|c"
    assert got(X.kv_extract_job, 'a=1 b="x y" a=2')[0][0] == {"a": "2", "b": "x y"}
    assert [x[1] for x in got(X.timestamp_extract_job, "2024-01-02", "02/01/2024", "x", formats=["yyyy-MM-dd", "dd/MM/yyyy"])] == [True, True, False]
    assert [x[1] for x in got(X.domain_validity_job, "a.example.com", "-bad.com", "a" * 256)] == [True, False, False]
    path = got(X.path_extract_job, "C:\\dir\\file.txt")[0][0]
    assert (path.directory, path.name, path.extension, path.drive_letter) == ("C:\\dir", "file.txt", "txt", "C")
    assert [x[1] for x in got(X.ip_validity_job, "1.2.3.4", "::1", "x")] == [True, True, False]
    assert [x[1] for x in got(X.base64_validity_job, "aGk=", "%")] == [True, False]
    assert got(X.between_extract_job, "<<x>>", "x", start="<<", end=">>") == [("x", True), (None, False)]
    assert got(X.quoted_extract_job, '"a \\"b\\" c" rest', "x") == [('a "b" c', True), (None, False)]
    xml = "<Event><EventData><Data Name='A'>1</Data></EventData></Event>"
    assert got(X.xml_extract_job, xml, "<x>", schema="EventData struct<Data:string>")[1] == (None, False)
    df = spark.createDataFrame([(xml,)], "x string").select(X.event_data_map(F.col("x")).alias("m"))
    assert df.first().m == {"A": "1"}
    prof = {r["column"]: r for r in X.type_profile_job(spark.createDataFrame([("1", "x"), ("true", "300"), ("1.5", None)], "a string, b string"), ["a", "b"]).collect()}
    assert (prof["a"].n, prof["a"].boolean, prof["a"].byte, prof["a"].double, prof["b"].byte, prof["b"]["long"]) == (3, 1, 1, 2, 0, 1)
    fit = X.fit_rate(X.ip_validity_job(spark.createDataFrame([("s", "1.1.1.1"), ("s", "x")], "src string, raw string"), "raw"), "src")
    assert tuple(fit.first()) == ("s", 2, 1)
