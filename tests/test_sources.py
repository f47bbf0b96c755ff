import json

from pyspark.sql import functions as F

from trailguard.functions import render
from trailguard.operators import enrich, metrics
from trailguard.sources import readers, writers


def test_logs_frames_and_feed(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"session_id":"a","seq":1,"tool_args":{"x": [1, 2]}}\n{"kind":"unattributed_syscall","reason":"r"}\nnot json at all\n\n[1]\n{"session_id":"b","seq":"one"}\n{"other":1}\n')
    events, audit, rejects = readers.event_log(spark, str(log))
    assert sorted(r["reason"] for r in rejects.collect()) == ["a field has another type", "no field of an event", "not JSON", "not a JSON object"]
    readers.quarantine(rejects, str(tmp_path / "rejects"))
    assert {r["head"] for r in spark.read.parquet(str(tmp_path / "rejects")).collect()} == {"not json at all", "[1]", '{"session_id":"b","seq":"one"}', '{"other":1}'}
    assert events.count() == 1 and audit.first()["reason"] == "r" and json.loads(events.first()["tool_args"]) == {"x": [1, 2]}
    raw = tmp_path / "frames"
    raw.write_text('{"id":1,"method":"m"}\r\n\n   \n' + "x" * (1 << 20) + 'y\ngarbage {\n"text"\n')
    good, bad = readers.frames(spark, str(raw))
    assert [r[0] for r in good.collect()] == ['{"id":1,"method":"m"}']
    assert sorted(r["reason"] for r in bad.collect()) == ["frame exceeds 1 MiB", "not JSON", "not a JSON object"]
    feed = tmp_path / "feed"
    ok = {"op": "register_taint", "pod_uid": " u1 ", "value": "acct_12345678", "hash": "h", "source": "s"}
    feed.write_text("\n".join(json.dumps(x) for x in (ok, ok | {"op": "x"}, ok | {"pod_uid": " "}, ok | {"value": ""}, ok | {"hash": ""}, ok | {"value": "v" * 70000})) + "\nnot json\n")
    good, bad = readers.taint_feed(spark, str(feed))
    assert sorted(r["reason"] for r in bad.collect()) == ["no hash", "no pod uid", "no value", "not a message", "unknown op", "value exceeds 64 KiB"]
    t = readers.feed_taint(good).first()
    assert t["session_id"] == "k8s:u1" and t["hash"] == "h" and t["preview"] == "acc...5678" and len(t["forms"]) == 9


def test_outbox_and_sinks(spark, tmp_path):
    e = spark.createDataFrame([("a", 5, "EXFIL", "prevented"), ("b", 9, "SUSPICIOUS", "allowed_monitor")], "session_id string, trip_ts_ns long, verdict string, action string")
    e = e.withColumns({"sink_call": F.struct(F.lit("send").alias("tool_name"), F.lit(None).cast("string").alias("syscall"), F.lit(None).cast("string").alias("dest_ip"))})
    box = writers.outbox(e, [("chat", "t", render.chat_alert()), ("hook", "", render.chat_alert())], "EXFIL")
    assert {(r["kind"], r["status"]) for r in writers.deliver(box, lambda *a: 200).collect()} == {("chat", "ok"), ("hook", "skipped")}

    def broken(*a):
        raise OSError

    assert {r["status"] for r in writers.deliver(writers.outbox(e, [("chat", "t", render.chat_alert())]), broken).collect()} == {"error"}
    assert writers.latest(e).first()["session_id"] == "b"
    seen = []
    sink = writers.fan_out([writers.evidence_sink(str(tmp_path / "e")), lambda df, i: seen.append((i, df.count()))])
    sink(e, 3)
    sink(e, 3)
    assert seen == [(3, 2), (3, 2)] and spark.read.json(str(tmp_path / "e")).count() == 2


def test_store_keeps_the_latest(spark, tmp_path):
    path, day = str(tmp_path / "store"), 86_400_000_000_000
    for first in (0, 5):
        rows = spark.range(first, first + 5).select(F.format_string("s%02d", "id").alias("session_id"), (F.col("id") * (day // 2)).alias("trip_ts_ns"), F.lit("EXFIL").alias("verdict"))
        writers.append_evidence(rows, path)
    new = writers.compact_evidence(spark, path, 4)
    kept = spark.read.json(new)
    assert sorted(r["session_id"] for r in kept.collect()) == ["s06", "s07", "s08", "s09"] and "trip_date" in kept.columns
    assert spark.read.json(path).count() == 10
    assert spark.read.json(writers.compact_evidence(spark, new, 0)).count() == 4


def test_old_days_go_without_rewriting_others(spark, tmp_path):
    path, day = str(tmp_path / "store"), 86_400_000_000_000
    rows = spark.range(10).select(F.format_string("s%02d", "id").alias("session_id"), (F.col("id") * (day // 2)).alias("trip_ts_ns"), F.lit("EXFIL").alias("verdict"))
    writers.append_evidence(rows, path)
    before = {p.name for d in sorted((tmp_path / "store").glob("trip_date=*"))[2:] for p in d.iterdir()}
    assert writers.drop_old_days(spark, path, 5) == ["1970-01-02", "1970-01-01"] and writers.drop_old_days(spark, path, 0) == []
    kept = spark.read.json(path)
    assert sorted(r["session_id"] for r in kept.collect()) == ["s04", "s05", "s06", "s07", "s08", "s09"]
    assert before == {p.name for d in (tmp_path / "store").glob("trip_date=*") for p in d.iterdir()}
    assert metrics.retain(kept.withColumn("id", F.col("session_id")), 5).count() == 5


def test_system_calls_findings_audit_and_summaries(spark, tmp_path):
    calls = [(1, 7, 7, "curl", "write", "1.1.1.1", 443, False, None, bytearray(b"\xff\x00x"), "s", None), (2, 8, 8, "sh", "openat", None, None, None, "/secrets/a", None, None, None)]
    df = spark.createDataFrame(calls, "ts_mono_ns long, pid int, tid int, comm string, syscall string, dest_ip string, dest_port int, allowlisted boolean, path string, payload_excerpt binary, session_id string, extra string")
    df.write.parquet(str(tmp_path / "calls"))
    got = readers.syscalls(spark, str(tmp_path / "calls"))
    assert "extra" not in got.columns and {"pod_context", "node", "start_ts"} <= set(got.columns)
    assert [(r["syscall"], r["payload_excerpt"]) for r in got.orderBy("ts_mono_ns").collect()] == [("write", bytearray(b"\xff\x00x")), ("openat", None)]
    # findings, of at least the verdict asked for, a line of JSON each; a batch that is run again doesn't double them
    e = spark.createDataFrame([("a", 5_000_000_000, "EXFIL", "prevented", "proxy_variant_a", 0.95), ("b", 6_000_000_000, "SUSPICIOUS", "allowed_monitor", "proxy_variant_a", 0.6)], "session_id string, trip_ts_ns long, verdict string, action string, variant string, confidence double")
    none = F.lit(None).cast("string")
    e = e.withColumns({"sink_call": F.struct(F.lit("send").alias("tool_name"), none.alias("syscall"), none.alias("dest_ip")), "legs": F.struct(none.alias("x")), "value_overlap": none})
    sink = writers.findings_sink(str(tmp_path / "ocsf"), "EXFIL")
    sink(e, 4)
    sink(e, 4)
    found = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "ocsf")).select("value").collect()]
    assert [(f["class_uid"], f["time"], f["severity"], f["finding_info"]["uid"], f["unmapped"]["confidence"]) for f in found] == [(2004, 5000, "Critical", "a-5000000000", 0.95)]
    _, audit = enrich.split_attributed(got.withColumn("ts", F.lit("2024-01-01").cast("timestamp")))
    for _ in range(2):
        writers.append_audit(audit, str(tmp_path / "audit"))
    assert [(r["kind"], r["detail"]) for r in spark.read.json(str(tmp_path / "audit")).collect()] == [("unattributed_syscall", "openat pid=8")] * 2
    rows = spark.createDataFrame([("in", "tools/call", "send", "s", 3, "é", None, "blocked", "why"), ("out", None, None, "s", 4, None, None, None, None)], "direction string, jsonrpc_method string, tool_name string, session_id string, seq long, tool_args string, result string, decision string, block_reason string")
    lines = [r[0] for r in rows.orderBy("seq").select(render.event_summary()).collect()]
    assert lines == ["in tools/call send session=s seq=3 2B BLOCKED why", "out response session=s seq=4 0B"]


def test_forwarded_taint_is_what_the_feed_takes(spark, tmp_path):
    rows = [("k8s:u1", 3, "srv/t", "acct_12345678", "h1", "acc...5678"), ("k8s:bad", 4, "srv/t", "acct_99999999", "h2", "acc...9999"), ("plain", 1, "srv/t", "acct_00000000", "h3", "p")]
    taint = spark.createDataFrame(rows, "session_id string, n long, source string, value string, hash string, preview string")
    sent = str(tmp_path)

    def send(pod, message):
        if pod == "bad":
            raise OSError
        with open(f"{sent}/{pod}", "a") as f:
            f.write(message + "\n")
        return 202

    out = writers.forward_taint(taint, send).collect()
    assert sorted((r["session_id"], r["hash"], r["status"]) for r in out) == [("k8s:bad", "h2", "error"), ("k8s:u1", "h1", "ok")]
    good, bad = readers.taint_feed(spark, f"{sent}/u1")
    got = readers.feed_taint(good).first()
    assert bad.isEmpty() and (got["session_id"], got["value"], got["hash"], got["seq"], len(got["forms"])) == ("k8s:u1", "acct_12345678", "h1", 3, 9)


def test_attribution(spark):
    ts = "timestamp'2024-01-01 00:00:0{}'"
    calls = spark.sql(f"select * from values ('n', 1, {ts.format(1)}, 'connect', '1.1.1.1', 80, 1), ('n', 1, {ts.format(6)}, 'write', null, null, 2), ('n', 1, {ts.format(7)}, 'write', null, null, 3) as t(node, pid, ts, syscall, dest_ip, dest_port, ingest_seq)")
    kept = enrich.correlate_writes(calls, 5, ("node", "pid")).where("syscall = 'write'").collect()
    assert [(r["ingest_seq"], r["dest_ip"]) for r in kept] == [(2, "1.1.1.1")]  # five seconds still count
    registry = spark.sql(f"select * from values ('n', 1, {ts.format(0)}, {ts.format(5)}, 's1', 'v'), ('n', 1, {ts.format(6)}, null, 's2', 'v') as t(node, pid, start_ts, end_ts, session_id, server_id)")
    owners = {r["ingest_seq"]: r["session_id"] for r in enrich.attribute_processes(calls, registry).collect()}
    assert owners == {1: "s1", 2: "s2", 3: "s2"}
    known, audit = enrich.split_attributed(enrich.attribute_processes(calls, registry.limit(1)).withColumn("comm", F.lit("c")))
    assert known.count() == 1 and audit.count() == 2


def test_malformed_lines_of_streams_are_quarantined(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text('{"session_id":"a","seq":1}\nnot json at all\n')
    for k, (df, want) in enumerate(zip(readers.event_log(spark, str(tmp_path / "in"), streaming=True), (1, 0, 1), strict=True)):
        q = df.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"c{k}")).trigger(availableNow=True).start(str(tmp_path / f"out{k}"))
        q.awaitTermination(60)
        assert spark.read.schema(df.schema).parquet(str(tmp_path / f"out{k}")).count() == want


def test_of_intervals_that_hold_a_call_the_last_to_start_owns_it(spark):
    import random

    day = lambda d: f"timestamp'2024-01-01 00:00:00' + make_dt_interval({d})"
    registry = spark.sql(f"select * from values ('n', 1, {day(0)}, {day(100)}, 'A', 'v'), ('n', 1, {day(1)}, {day(2)}, 'B', 'v'), ('n', null, {day(0)}, null, 'victim', 'v'), (null, 1, {day(0)}, null, 'victim', 'v') as t(node, pid, start_ts, end_ts, session_id, server_id)")
    calls = spark.sql(f"select * from values ('n', 1, {day(0)}, 1), ('n', 1, {day(1)}, 2), ('n', 1, {day(2)}, 3), ('n', 1, {day(50)}, 4), ('n', 1, {day(100)}, 5), ('n', null, {day(1)}, 6), (null, 1, {day(1)}, 7) as t(node, pid, ts, id)")
    got = {r["id"]: r["session_id"] for r in enrich.attribute_processes(calls, registry).collect()}
    assert got == {1: "A", 2: "B", 3: "A", 4: "A", 5: None, 6: None, 7: None}
    rng = random.Random(3)
    spans = [(rng.choice("xy"), rng.randrange(2), s := rng.randrange(500), rng.choice([None, s + rng.randrange(300)]), f"s{i}") for i in range(200)]
    at = [(rng.choice("xy"), rng.randrange(2), rng.randrange(800), i) for i in range(500)]
    df = spark.createDataFrame(spans, "node string, pid int, s long, e long, session_id string").selectExpr("node", "pid", "timestamp_seconds(s * 3600) start_ts", "timestamp_seconds(e * 3600) end_ts", "session_id", "'v' server_id")
    calls = spark.createDataFrame(at, "node string, pid int, t long, id long").selectExpr("node", "pid", "timestamp_seconds(t * 3600) ts", "id")
    got = {r["id"]: r["session_id"] for r in enrich.attribute_processes(calls, df, slice_s=36_000).collect()}
    top = lambda e: 1 << 40 if e is None else e
    want = {i: max(((s, top(e), name) for n, p, s, e, name in spans if (n, p) == (node, pid) and s <= t < top(e)), default=(0, 0, None))[2] for node, pid, t, i in at}
    assert got == want and len(set(got.values())) > 50


def test_nothing_answers_a_notification(spark):
    ts = "timestamp'2024-01-01 00:00:0{}'"
    asked = spark.sql(f"select * from values ('s', null, {ts.format(1)}, 'note'), ('s', 'a', {ts.format(1)}, 'tool'), (null, 'a', {ts.format(1)}, 'tool') as t(session_id, rpc_id, ts, tool_name)")
    answers = spark.sql(f"select * from values ('s', cast(null as string), {ts.format(2)}, 'parse error'), (null, 'a', {ts.format(2)}, 'other') as t(session_id, rpc_id, ts, result)")
    got = {(r["session_id"], r["rpc_id"]): (r["result"], r["timed_out"]) for r in enrich.pair_responses(asked, answers).collect()}
    assert got == {("s", None): (None, False), ("s", "a"): (None, True), (None, "a"): (None, False)}


def test_filters(spark):
    calls = spark.createDataFrame([("sendto", "::ffff:10.0.0.1", 53, None, b"x" * 2000), ("connect", "10.0.0.2", 80, None, None), ("openat", None, None, "/secretsX", None), ("openat", None, None, "/home", None)], "syscall string, dest_ip string, dest_port int, path string, payload_excerpt binary")
    out = enrich.prepare_syscalls(calls, ["/secrets", ""], 512)
    assert sorted(r["syscall"] for r in out.collect()) == ["connect", "dns", "openat"] and out.agg(F.max(F.length("payload_excerpt"))).first()[0] == 512
    assert enrich.prepare_syscalls(calls, []).where("syscall = 'openat'").isEmpty()
    assert enrich.drop_allowlisted(calls, spark.createDataFrame([("10.0.0.1",)], "ip string")).where("dest_ip like '%0.1'").isEmpty()


def test_pods_and_processes(spark):
    cid = "ab" * 32
    pods = spark.sql(f"select timestamp'2024-01-01' as snapshot_ts, 'ns' as namespace, 'p' as pod_name, 'u' as pod_uid, 'n' as node_name, map('watch', 'true') as labels, array(cast(7 as decimal(20,0))) as cgroup_ids, array(named_struct('id', 'containerd://{cid}', 'kind', 'regular', 'running', true), named_struct('id', 'docker://x', 'kind', 'init', 'running', false)) as containers")
    assert enrich.pod_containers(pods).count() == 1 and enrich.watched_pods(pods, "watch", "n", "ns").count() == 1 and enrich.watched_pods(pods, "other").isEmpty()
    procs = spark.createDataFrame([("n", 5, f"0::/kubepods/cri-containerd-{cid}.scope")], "node string, pid int, cgroup_text string")
    assert enrich.processes_of_pods(procs, pods).first()["pod_uid"] == "u"
    calls = spark.createDataFrame([("n", 5, None, ""), ("n", 9, None, "own")], "node string, pid int, cgroup_id decimal(20,0), session_id string")
    cg = enrich.pod_cgroups(pods)
    pids = spark.createDataFrame([("n", 5)], "node string, pid int").crossJoin(cg.select("pod"))
    got = {r["pid"]: r["session_id"] for r in enrich.attribute_pods(calls, cg, pids).collect()}
    assert got == {5: "k8s:u", 9: "own"}


def test_routing(spark):
    reg = spark.createDataFrame([("s", 0, "a", 0, "t"), ("s", 1, "b", 0, "t")], "session_id string, server_pos int, server_id string, tool_pos int, tool_name string")
    assert enrich.shadow_audit(reg).first()["reason"] == "tool t of b is already owned by a"
    calls = spark.createDataFrame([("s", "t", "tools/call", None), ("s", "q", "tools/call", None), ("s", None, "odd", None)], "session_id string, tool_name string, jsonrpc_method string, server_id string")
    assert sorted(r["error"] for r in enrich.unknown_calls(calls, reg, ["tools/call"]).collect()) == [-32602, -32601]
    assert enrich.own_servers(calls, reg).where("tool_name = 't'").first()["server_id"] == "a"
    bound = spark.createDataFrame([("x", "s1", 1), ("x", "s2", 2)], "transport_session_id string, session_id string, ts int")
    assert enrich.bind_transport(spark.createDataFrame([("x", "?")], "transport_session_id string, session_id string"), bound).first()["session_id"] == "s2"


def test_metrics(spark):
    rows = [(f"2024-01-01 00:00:{i:02d}", i) for i in range(7)]
    e = spark.createDataFrame([(i * 86_400_000_000_000 // 3, i) for i in range(20)], "trip_ts_ns long, id long")
    assert sorted(r["id"] for r in metrics.retain(e, 5).collect()) == [15, 16, 17, 18, 19] and metrics.retain(e, 0).count() == 20 and metrics.retain(e, 99).count() == 20
    c = spark.createDataFrame([("a", t, v) for (t, _), v in zip(rows, (1, 3, 2, 5), strict=False)], "name string, ts string, value long")
    assert [r["increment"] for r in metrics.counter_increments(c).orderBy("ts").collect()] == [1, 2, 0, 2]
    q = metrics.latency_quantiles(spark.createDataFrame([("x", i) for i in range(101)], "label string, duration_ns long")).first()
    assert (q["p50"], q["p95"], q["p999"], q["samples"]) == (50, 95, 99, 101)
    log = spark.createDataFrame([("2024-01-01", "2025-06-18", "application/json, text/event-stream", None, "m", "tools/call", "t", "Bearer abcdefgh", None, '{"id":1,"method":"tools/call","params":{"name":"u"}}')], "ts string, protocol_version string, accept string, origin string, mcp_session_id string, mcp_method string, mcp_name string, authorization string, cookie string, body string")
    assert metrics.check_requests(log, ["2025-06-18"], []).first()["reason"] == "tool header and body differ"
