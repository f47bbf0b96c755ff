import dataclasses
import time
from datetime import timedelta

from pyspark.sql import functions as F

from trailguard.config import server_tags, tool_tags
from trailguard.operators import detect, enrich, metrics
from trailguard.plans.agent_log import SETTINGS
from trailguard.tables import cut
from trailguard.sources import readers
from trailguard.sources.writers import taint_sink
from trailguard.streaming.late import ingest_sink, late_rows, redecide
from trailguard.streaming.ordered import correlate_stream, fuse_stream
from trailguard.streaming.sessions import Dimensions, Drops, detect_raw_stream, detect_stream, secrets_stream, session_ends, tag_sink, trip_counts

from .scenarios import COLUMNS, NOTE, PARTS, SECRET, START, b64, call, page, read, rows, send

PLAIN = dataclasses.replace(SETTINGS, leg_ttl_s=1800, idle_timeout_s=7200)
OUT = ["session_id", "n", "verdict", "match_form", "where_found", "tainted_hash", "preview", "source_lit", "untrusted_lit", "sink_lit"]


def source(spark, df, folder, files=3, event_time="ts"):
    """A stream of df's rows dealt at random over so many micro-batches, and one far later row that moves the watermark on."""
    df = df.withColumn("_file", F.floor(F.rand(7) * files)).persist()
    for i in range(files):
        df.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    last = df.drop("_file").limit(1).withColumns({event_time: F.lit("2039-01-01").cast("timestamp")} | ({"session_id": F.lit("~last")} if "session_id" in df.columns else {}))
    last.coalesce(1).write.mode("append").parquet(folder)
    return df.sparkSession.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return stream.sparkSession.table(name)


def decided(rows):
    return {tuple(r[c] for c in OUT) for r in rows.where("session_id <> '~last'").select(*OUT).collect()}


def more_rows():
    """Sessions besides the labelled ones: secrets over many chunks, newlines, repeated secrets, gzip of two secrets, odd texts."""
    import base64
    import gzip
    import json

    other = "api_key_0123456789abcdefXYZ"
    both = base64.b64encode(gzip.compress(f"{other} {SECRET}".encode(), 1)).decode()
    steps = {
        "many_chunks": [read(f"chunk {i}") for i in range(20)] + [read(PARTS[0]), page("x"), read(PARTS[1] + "\n\n"), send(SECRET), send(b64(SECRET))],
        "evicted_chunk": [read(PARTS[0])] + [read(f"chunk {i}") for i in range(16)] + [read(PARTS[1]), send(SECRET)],
        "two_secrets": [read(f"{other} and token: {SECRET}"), send(f"{SECRET} {other}"), send(both), send(json.dumps({"z": other[:9], "zz": other[9:]}))],
        "odd_texts": [read(None, result=None), read("é" * 40_000), send(None, tool_args=None), send(""), page("  \n "), send("日本" * 5000), call("write", None), call("write", b"\xff\xfe" + SECRET.encode())],
        "nested_leaf": [read(), send(json.dumps({"b": [{"c": b64(b64(SECRET))}], "a": "AAAA"})), call("sendto", b64(SECRET[::-1]).encode())],
        "same_time": [read(), *[send(SECRET, after=0) for _ in range(5)], page(after=0), send(f"FYI {NOTE}", after=0)],
    }
    return rows(steps)


def test_stream_equals_batch_from_raw_events_of_both_planes(spark, tmp_path):
    raw = spark.createDataFrame(rows() + more_rows(), COLUMNS)
    dims = tool_tags(spark, PLAIN), server_tags(spark, PLAIN)
    log = cut(detect.prepare(enrich.resolve_tags(enrich.first_event(raw), *dims), PLAIN))
    want = decided(detect.decide(log, PLAIN).withColumn("where_found", F.col("where_found")))
    tools = source(spark, raw.where("plane = 'tool'"), str(tmp_path / "tools"))
    calls = source(spark, raw.where("plane <> 'tool'"), str(tmp_path / "calls"))
    got = decided(drain(detect_raw_stream(tools, calls, *dims, PLAIN, "1 day"), "decisions", tmp_path))
    assert got == want
    verdicts = {(r[0], r[2]) for r in got}
    assert {("three_layers", "EXFIL"), ("gzip", "EXFIL"), ("split_in_args", "EXFIL"), ("split_over_results", "EXFIL"), ("many_chunks", "EXFIL"), ("bound_text", "SUSPICIOUS"), ("sensor_file", "EXFIL")} <= verdicts
    assert ("evicted_chunk", "EXFIL") not in verdicts and ("xor", "EXFIL") not in verdicts


def test_repeated_deliveries_change_nothing(spark, tmp_path):
    raw = spark.createDataFrame([r for r in rows() if r[0] in ("literal", "decayed_by_count", "split_over_results")], COLUMNS)
    dims = tool_tags(spark, PLAIN), server_tags(spark, PLAIN)
    log = cut(detect.prepare(enrich.resolve_tags(enrich.first_event(raw), *dims), PLAIN))
    twice = source(spark, raw.union(raw), str(tmp_path / "in"))
    got = drain(detect_stream(detect.prepare(enrich.resolve_tags(twice, *dims), PLAIN), PLAIN, "1 day"), "twice", tmp_path)
    assert decided(got) == decided(detect.decide(log, PLAIN)) and got.where("session_id <> '~last'").count() == len(decided(got))


def test_state_ends_with_the_session(spark, tmp_path):
    """After the idle time a session begins anew: what it had read before is forgotten, and numbers start again."""
    raw = spark.createDataFrame(rows({"again": [read(), send(SECRET), send(SECRET, after=3 * 3600)]}), COLUMNS)
    dims = tool_tags(spark, PLAIN), server_tags(spark, PLAIN)
    late = spark.createDataFrame(rows({"clock": [send("x", after=2 * 3600 + 1800)]}), COLUMNS)
    folder = str(tmp_path / "in")
    for df in (raw.where("ingest_seq < 3"), late, late.limit(0), raw.where("ingest_seq = 3")):
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = source(spark, late.withColumn("session_id", F.lit("other")), folder, files=1)
    got = drain(detect_stream(detect.prepare(enrich.resolve_tags(stream, *dims), PLAIN), PLAIN, "1 minute"), "ended", tmp_path)
    assert [(r["n"], r["verdict"]) for r in got.where("session_id = 'again'").orderBy("ts").collect()] == [(2, "EXFIL"), (1, None)]


def test_numbered_stream_equals_batch(spark, tmp_path):
    raw = spark.createDataFrame(rows() + more_rows(), COLUMNS)
    tools = source(spark, raw.where("plane = 'tool'"), str(tmp_path / "tools"))
    calls = source(spark, raw.where("plane <> 'tool'"), str(tmp_path / "calls"))
    got = drain(fuse_stream(tools, calls, 7200, "1 day"), "numbered", tmp_path).where("session_id <> '~last'")
    want = enrich.fuse(raw.where("plane = 'tool'"), raw.where("plane <> 'tool'"))
    assert got.select(want.columns).exceptAll(want).isEmpty() and got.count() == want.count()


def test_correlated_stream_equals_batch(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    data = [
        ("n1", 1, START, at(0), 1, "connect", "10.0.0.1", 80), ("n1", 1, START, at(5), 2, "write", None, None), ("n1", 1, START, at(5.001), 3, "write", None, None),
        ("n1", 1, at(60), at(61), 4, "write", None, None), ("n1", 2, START, at(1), 5, "write", None, None), ("n1", 2, START, at(1), 6, "sendto", "10.0.0.2", 53),
        ("n1", 2, START, at(3), 7, "connect", "10.0.0.3", 443), ("n1", 2, START, at(4), 8, "write", "9.9.9.9", 1), ("n2", 2, START, at(4), 9, "write", None, None),
        ("n2", 2, START, at(9), 10, "openat", None, None), (None, 2, START, at(9), 11, "openat", None, None),
    ]
    df = spark.createDataFrame(data, "node string, pid int, start_ts timestamp, ts timestamp, ingest_seq long, syscall string, dest_ip string, dest_port int")
    want = {tuple(r) for r in enrich.correlate_writes(df).select(df.columns).collect()}
    got = drain(correlate_stream(source(spark, df, str(tmp_path / "in"), 4), lateness="1 hour"), "correlated", tmp_path)
    assert {tuple(r) for r in got.where("ts < '2030-01-01'").select(df.columns).collect()} == want and any(r[6] == "10.0.0.2" and r[5] == "write" for r in want)


def test_paired_streams_equal_batch(spark, tmp_path):
    import random

    rng = random.Random(5)
    asked = [("s" + str(rng.randrange(3)), str(rng.randrange(3)), START + timedelta(seconds=rng.randrange(600) + i / 1000), f"tool{i}") for i in range(120)]
    answers = [("s" + str(rng.randrange(3)), str(rng.randrange(3)), START + timedelta(seconds=rng.randrange(600)), f"r{i}") for i in range(60)]
    answers += [("s0", None, START, "parse error"), ("s0", "1", asked[0][2] + timedelta(hours=5), "late")]
    q = spark.createDataFrame([*asked, ("s0", "9", START, "edge")], "session_id string, rpc_id string, ts timestamp, tool_name string")
    r = spark.createDataFrame([*answers, ("s0", "9", START + timedelta(seconds=30), "in time")], "session_id string, rpc_id string, ts timestamp, result string")
    columns = ["session_id", "rpc_id", "tool_name", "ts_response", "result", "timed_out"]
    want = {tuple(x) for x in enrich.pair_responses(q, r).select(columns).collect()}
    out = enrich.pair_responses_stream(source(spark, q, str(tmp_path / "q")), source(spark, r, str(tmp_path / "r")), lateness="1 day")
    got = [tuple(x) for x in drain(out, "pairs", tmp_path).where("session_id <> '~last'").select(columns).collect()]
    assert set(got) == want and len(got) == len(want) and {x[5] for x in got} == {True, False}


def test_streamed_secrets_reach_the_sensors(spark, tmp_path):
    raw = spark.createDataFrame(rows({"k8s:pod-1": [read(PARTS[0]), read(PARTS[1]), read(f"token: {SECRET}")], "local": [read()]}), COLUMNS)
    dims = tool_tags(spark, PLAIN), server_tags(spark, PLAIN)
    stream = source(spark, raw, str(tmp_path / "in"))
    told = str(tmp_path / "told")

    def send_(pod, message):
        with open(f"{told}-{pod}", "a") as f:
            f.write(message + "\n")
        return 200

    q = secrets_stream(detect.prepare(enrich.resolve_tags(stream, *dims), PLAIN), PLAIN, "1 day").writeStream.foreachBatch(taint_sink(send_, str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    feed, bad = readers.split_feed(spark.read.text(f"{told}-pod-1"))
    assert [(r["session_id"], r["value"], r["seq"]) for r in readers.feed_taint(feed).collect()] == [("k8s:pod-1", SECRET, 2)] and bad.isEmpty()


def test_session_ends_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    data = [("a", START), ("a", START + timedelta(minutes=5)), ("a", START + timedelta(hours=2)), ("b", START + timedelta(hours=5))]
    df = spark.createDataFrame(data, "session_id string, ts timestamp")
    df.coalesce(1).write.parquet(src)
    q = session_ends(spark.readStream.schema(df.schema).parquet(src)).writeStream.format("memory").queryName("ends").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(r["events"] for r in spark.table("ends").collect()) == [1, 2]


def test_late_rows_are_decided_again_with_their_sessions(spark, tmp_path):
    raw = spark.createDataFrame(rows(), COLUMNS)
    dims = tool_tags(spark, PLAIN), server_tags(spark, PLAIN)
    number = lambda df: cut(detect.prepare(enrich.resolve_tags(enrich.first_event(df), *dims), PLAIN))
    # the reading of two sessions comes an hour late
    is_late = F.col("session_id").isin("literal", "bound_text") & (F.col("ingest_seq") == 1)
    folder, to = str(tmp_path / "in"), str(tmp_path / "split")
    clock = raw.limit(1).withColumns({"session_id": F.lit("~clock"), "ts": F.lit(START + timedelta(hours=3))})
    for df in (raw.where(~is_late), clock, raw.where(is_late)):
        df.coalesce(1).write.mode("append").parquet(folder)
        q = spark.readStream.schema(raw.schema).parquet(folder).writeStream.foreachBatch(ingest_sink(to, 3600)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    late = late_rows(spark, to, COLUMNS)
    log = spark.read.schema(COLUMNS).parquet(f"{to}/log").drop("batch").where("session_id <> '~clock'")
    assert {(r["session_id"], r["ingest_seq"]) for r in late.collect()} == {("literal", 1), ("bound_text", 1)}
    first = cut(detect.decide(number(log), PLAIN).select(*OUT))
    whole = decided(detect.decide(number(raw), PLAIN))
    assert decided(first) != whole and decided(redecide(log, late, first, PLAIN, number)) == whole


def test_observed_counts_of_jobs_and_streams(spark, tmp_path):
    e = spark.createDataFrame([("EXFIL", "proxy_variant_a", "prevented"), ("EXFIL", "proxy_variant_a", "prevented"), ("SUSPICIOUS", None, "allowed_monitor")], "verdict string, variant string, action string")
    by = tuple(metrics.DETECTIONS)
    df, seen = metrics.observed(e, "detections", *by, values=metrics.DETECTIONS)
    df.write.parquet(str(tmp_path / "e"))
    metrics.export_counters(spark, seen, "nightly", str(tmp_path / "counters"))
    got = {r["name"]: r["value"] for r in spark.read.parquet(str(tmp_path / "counters")).where("value > 0").collect()}
    assert got == {"nightly/detections/EXFIL|proxy_variant_a|prevented": 2, "nightly/detections/other": 1}
    drops = Drops()
    spark.streams.addListener(drops)
    try:
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")).observe("detections", *metrics.counts(*by, values=metrics.DETECTIONS))
        q = stream.writeStream.format("parquet").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(60)
        end = time.time() + 20
        while time.time() < end and not any("detections" in s[0] for s in drops.samples):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(drops)
    streamed = {r["name"]: r["value"] for r in drops.counters(spark).where("value > 0 and name like '%detections%'").collect()}
    assert streamed == {"seen/detections/EXFIL|proxy_variant_a|prevented": 2, "seen/detections/other": 1}
    for i in range(3 * Drops.MOST):
        drops._count("r", "q", "late", i % 2)
    assert len(drops.samples) <= Drops.MOST and drops.samples[-1][2] == 3 * Drops.MOST // 2


def test_dimensions_keep_the_last_good_version(spark, tmp_path):
    p = tmp_path / "tags.json"
    p.write_text('{"tool_name":"t","tags":["external_sink"]}\n')
    d = Dimensions(spark, str(p))
    assert d.current().count() == 1
    p.write_text('{"other": 1}\n')
    assert "tags" in d.current().columns and d.errors


def test_tags_are_those_of_each_batch(spark, tmp_path):
    tools, servers, src, to = (tmp_path / x for x in ("tools.json", "servers.json", "in", "out"))
    tools.write_text('{"tool_name":"t","tags":["external_sink"]}\n')
    servers.write_text('{"server_id":"v","tags":["sensitive_source"]}\n')
    sink = tag_sink(Dimensions(spark, str(tools)), Dimensions(spark, str(servers), "server_id"), str(to))
    schema = "session_id string, n long, tool_name string, server_id string"

    def feed(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = spark.readStream.schema(schema).parquet(str(src)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)

    feed(("s", 1, "t", "v"), ("s", 2, "u", "v"))
    tools.write_text('{"tool_name":"u","tags":["external_sink"]}\n')
    feed(("s", 3, "t", "v"), ("s", 4, "u", "v"))
    got = {r["n"]: (r["is_source"], r["is_sink"]) for r in spark.read.parquet(str(to)).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False), 4: (False, True)}


def test_late_rows_are_counted(spark, tmp_path):
    src, drops = str(tmp_path / "in"), Drops()
    schema = "verdict string, ts timestamp"
    spark.streams.addListener(drops)
    try:
        for hours in (10, 20, 0):  # the last is far behind the watermark by then
            spark.createDataFrame([("EXFIL", START + timedelta(hours=hours))], schema).coalesce(1).write.mode("append").parquet(src)
            q = trip_counts(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").queryName("trips").outputMode("append")
            q = q.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
            q.awaitTermination(60)
        end = time.time() + 20
        while time.time() < end and not any(name.endswith("/late") and n for name, _, n in drops.samples):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(drops)
    rows = drops.counters(spark)
    most = {r["name"]: r["value"] for r in rows.groupBy("name").agg(F.max("value").alias("value")).collect()}
    assert most["trips/late"] == 1 and most["trips/read"] == 1
    assert metrics.counter_increments(rows).count() == rows.count() and drops.counters(spark).isEmpty()
