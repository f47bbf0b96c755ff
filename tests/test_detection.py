import base64
import dataclasses
import gzip

import pytest
from pyspark.sql import functions as F

from trailguard.config import server_tags, tool_tags
from trailguard.functions.text import grams
from trailguard.operators import bind, detect, enrich, overlap, rollups, scenarios, taint
from trailguard.operators.legs import Legs, leg_states
from trailguard.plans.agent_log import SETTINGS
from trailguard.schemas import EVIDENCE
from trailguard.sources import writers
from trailguard.tables import cut

from .corpus import CORPUS, SOFT
from .scenarios import COLUMNS, SCENARIOS, SECRET, rows

DEFAULTS = dataclasses.replace(SETTINGS, leg_ttl_s=1800)


@pytest.fixture(scope="module")
def log(spark):
    raw = enrich.first_event(spark.createDataFrame(rows(), COLUMNS))
    tagged = enrich.resolve_tags(raw, tool_tags(spark, DEFAULTS), server_tags(spark, DEFAULTS))
    return cut(detect.prepare(tagged, DEFAULTS))


@pytest.fixture(scope="module")
def decisions(log):
    return cut(detect.decide(log, DEFAULTS))


def test_every_scenario_gives_its_verdicts(decisions):
    got = {}
    for r in decisions.where("verdict is not null").orderBy("session_id", "n").collect():
        got.setdefault(r["session_id"], []).append(r["verdict"])
    assert {k: got.get(k, []) for k in SCENARIOS} == {k: v[4] for k, v in SCENARIOS.items()}


def test_match_forms_and_actions(decisions):
    rows_ = {(r["session_id"], r["n"]): r for r in decisions.where("verdict is not null").collect()}
    form = {s: r["match_form"] for (s, _), r in rows_.items()}
    assert form["base64"] == "base64" and form["nested_pair"] == "base64_hex" and form["gzip"] == "gzip_base64" and form["split_in_args"] == "literal"
    assert form["three_layers"].startswith("decoded_base64_base64")
    action = {s: r["action"] for (s, _), r in rows_.items()}
    assert action["literal"] == "prevented" and action["bound_text"] == "allowed_monitor" and action["write_payload"] == "contained_by_kill"
    assert rows_["write_payload", 2]["where_found"] == "egress payload"


def test_confusion_matrix(spark, decisions):
    labels = spark.createDataFrame([(k, c, p, g) for k, (c, p, g, _, _) in SCENARIOS.items()], "scenario_id string, category string, variant string, known_gap boolean")
    scored = scenarios.classify(scenarios.trips(labels, decisions))
    m = scenarios.confusion(scored).first()
    assert (m["tp"], m["fn"], m["known_gap"], m["bonus"], m["fp_exfil"], m["fp_soft"]) == (16, 0, 2, 0, 0, 3)
    assert m["detection_rate"] == 1.0 and m["fp_rate_exfil"] == 0.0 and m["fp_rate_any"] == pytest.approx(3 / 12)
    assert scenarios.duplicate_ids(labels).isEmpty()
    assert "| detection rate | 100.0% |" in scenarios.report(scored)


def test_labelled_corpus(spark):
    """What the published report pins: 21 of 21 found, 4 of 30 soft trips, no benign EXFIL, 4 known gaps, by plane."""
    assert len(CORPUS) == 55 and len(SOFT) == 4
    raw = spark.createDataFrame(rows({k: v[3] for k, v in CORPUS.items()}), COLUMNS)
    calls = enrich.prepare_syscalls(raw.where("kind = 'syscall'"), list(DEFAULTS.sensitive_paths), 1024)
    known, audit = enrich.split_attributed(calls.withColumn("session_id", F.when(F.col("session_id") != "no_session", F.col("session_id"))))
    log = enrich.first_event(raw.where("kind <> 'syscall'").unionByName(known))
    log = cut(detect.prepare(enrich.resolve_tags(log, tool_tags(spark, DEFAULTS), server_tags(spark, DEFAULTS)), DEFAULTS))
    labels = spark.createDataFrame([(k, c, p, g) for k, (c, p, g, _) in CORPUS.items()], "scenario_id string, category string, variant string, known_gap boolean")
    scored = cut(scenarios.classify(scenarios.trips(labels, detect.decide(log, DEFAULTS))))
    m = scenarios.confusion(scored).first()
    assert [m[c] for c in ("tp", "fn", "known_gap", "bonus", "tn", "fp_soft", "fp_exfil")] == [21, 0, 4, 0, 26, 4, 0]
    planes = {r["variant"]: [r[c] for c in ("tp", "fn", "known_gap", "bonus", "tn", "fp_soft", "fp_exfil")] for r in scenarios.by_plane(scored).collect()}
    assert planes == {"ebpf_variant_b": [4, 0, 1, 0, 2, 0, 0], "proxy_variant_a": [16, 0, 3, 0, 22, 4, 0], "sensor_variant_b": [1, 0, 0, 0, 2, 0, 0]}
    assert {r["scenario_id"] for r in scored.where("outcome = 'fp_soft'").collect()} == SOFT and audit.count() == 1


def test_evidence_is_redacted_and_has_its_schema(spark, log, decisions, tmp_path):
    found = taint.forms(detect.session_taints(log, DEFAULTS))
    e = cut(detect.evidence(decisions, log, found))
    want = spark.createDataFrame([], EVIDENCE).schema
    assert [f.name for f in e.schema] == [f.name for f in want]
    got = {r["session_id"]: r for r in e.collect()}
    for name in ("literal", "base64", "hex", "reversed", "write_payload"):
        r = got[name]
        text = r["sink_call"]["args"] or r["sink_call"]["payload_excerpt"]
        assert SECRET not in str(r) and "sk-...a4b5" in text
    line = got["literal"]["timeline"]
    assert [t["timeline_seq"] for t in line] == [1, 2, 3] and line[0]["label"].startswith("sensitive_source_touched") and line[2]["label"].startswith("external_sink_invoked")
    assert got["write_payload"]["timeline"][-1]["kind"] == "syscall"
    writers.append_evidence(e, str(tmp_path / "evidence"))
    assert spark.read.json(str(tmp_path / "evidence")).count() == len(got) + 1  # one session trips twice
    with pytest.raises(ValueError):
        writers.append_evidence(e.withColumn("value", F.lit(1)), str(tmp_path / "x"))


def test_both_overlap_plans_are_equal_and_bind_equals_brute_force(spark):
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(120)]
    sinks = spark.createDataFrame([(i % 3, 100 + i, t) for i, t in enumerate(texts)], "session_id int, n long, text string")
    values = ["".join(r.choice("ab") for _ in range(k)) for k in (5, 11, 12, 13, 14, 16)]
    forms = spark.createDataFrame([(s, 90 + 20 * k, k, f"h{k}", "p", 0, "literal", v) for s in range(3) for k, v in enumerate(values)], "session_id int, taint_n long, taint_ord int, hash string, preview string, form_ord int, form string, form_value string")
    a, b = (sorted(overlap.raw_hits(sinks, forms, plan).select("session_id", "n", "tainted_hash").collect()) for plan in ("contains", "anchor"))
    assert a == b and a
    ex = [(s, 1, 1, None, "".join(r.choice("ab") for _ in range(40))) for s in range(3)]
    excerpts = spark.createDataFrame(ex, "session_id int, epoch long, n long, until long, excerpt string")
    got = sorted(tuple(x) for x in bind.content_bound(sinks.withColumn("epoch", F.lit(1)), excerpts, 8).collect())
    want = sorted((i % 3, 100 + i) for i, t in enumerate(texts) if any(t[k : k + 8] in ex[i % 3][4] for k in range(len(t) - 7)))
    assert got == want and got
    assert sinks.select(grams("text", 8).alias("g")).where(F.size("g") > 0).count() > 0


@pytest.mark.parametrize(("ttl", "calls", "piece"), [(1800, 32, 1 << 16), (1800, 32, 40), (300, 7, 9), (60, 32, 33), (0, 5, 6), (0, 0, 5), (200, 0, 5)])
def test_states_of_pieces_are_those_of_the_whole_session(spark, ttl, calls, piece):
    import random

    r, rows_, want = random.Random(ttl + calls), [], set()
    for session, n in (("a", 700), ("b", 1), ("c", 40), ("d", 333), (None, 90)):
        fold, us = Legs(ttl * 1_000_000, calls), 0
        rate = r.choice([0.02, 0.3, 0.9])
        for i in range(1, n + 1):
            us += r.choice([0, 0, 1_000_000, 20_000_000, 90_000_000])
            lights = [r.random() < rate for _ in range(3)]
            again = lights[2] and r.random() < 0.1
            fold.step(i, us, lights, again)
            rows_.append((session, i, us, *lights, again))
            want.add((session, i, *fold.lit))
    r.shuffle(rows_)
    df = spark.createDataFrame(rows_, "session_id string, n long, us long, lights_source boolean, lights_untrusted boolean, lights_sink boolean, relight_sink boolean").withColumn("ts", F.timestamp_micros("us"))
    got = leg_states(df, ttl, calls, piece)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)


def test_a_long_session_is_many_tasks(spark):
    n = 200_000
    df = spark.range(1, n + 1).select(F.lit("s").alias("session_id"), F.col("id").alias("n"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), (F.col("id") % 3 == 0).alias("lights_source"), (F.col("id") % 50 < 2).alias("lights_untrusted"), (F.col("id") % 11 == 0).alias("lights_sink"), (F.col("id") % 1100 == 0).alias("relight_sink"))
    got = leg_states(df, piece=20_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one task
    try:
        assert got.select(F.spark_partition_id().alias("task")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    fold, want = Legs(1800 * 1_000_000, 32), []
    for i in range(1, n + 1):
        fold.step(i, i * 7_000_000, (i % 3 == 0, i % 50 < 2, i % 11 == 0), i % 1100 == 0)
        want.append((i, *fold.lit))
    assert [tuple(x) for x in got.select("n", "source_lit", "untrusted_lit", "sink_lit").orderBy("n").collect()] == want


def test_texts_that_share_a_run_keep_a_gram_of_it():
    import random

    from trailguard.functions.winnow import kept

    r, rows_, all_ = random.Random(9), 0, 0
    for _ in range(300):
        least = r.choice([1, 2, 5, 12, 16, 24])
        run = bytes(r.choice(b"ab\xff") for _ in range(least))
        a, b = (bytes(r.choice(b"ab") for _ in range(r.randrange(60))) + run + bytes(r.choice(b"ab") for _ in range(r.randrange(60))) for _ in range(2))
        assert set(kept(a, least)[1].tolist()) & set(kept(b, least)[1].tolist())
    text = r.randbytes(20_000)
    rows_, all_ = len(kept(text, 16)[0]), len(text) - 15
    assert rows_ < 0.25 * all_ and not len(kept(b"short", 16)[0])


def test_sketches_of_days_merge_to_those_of_a_month(spark, tmp_path):
    day = 86_400_000_000_000
    e = spark.range(30_000).select((F.col("id") % 5000).cast("string").alias("session_id"), (F.col("id") % 28 * day + F.col("id") * 1_000_000).alias("trip_ts_ns"), F.when(F.col("id") % 3 == 0, "EXFIL").otherwise("SUSPICIOUS").alias("verdict"), F.struct(F.lit(None).cast("string").alias("dest_ip"), F.lit("send").alias("tool_name")).alias("sink_call"), F.struct(F.struct((F.col("id") % 2 == 0).alias("lit"), (F.col("id") % 28 * day).alias("lit_at_ns")).alias("sensitive_source_touched")).alias("legs"))
    path = str(tmp_path / "days")
    rollups.roll_day(e.where("trip_ts_ns < 10 * 86400000000000L"), path)
    rollups.roll_day(e.where("trip_ts_ns >= 10 * 86400000000000L"), path)
    rollups.roll_day(e.where("trip_ts_ns < 86400000000000L"), path)  # again: nothing counts twice
    stored = spark.read.parquet(path).drop("day")
    merged = rollups.read_trips(rollups.merge_trips(rollups.merge_trips(stored, "week"), "month", ("verdict",)))
    direct = rollups.read_trips(rollups.merge_trips(rollups.sketch_trips(e, "31 days"), "month", ("verdict",)))
    total = lambda df: {r["verdict"]: r for r in df.groupBy("verdict").agg(F.sum("trips").alias("trips"), F.max("sessions").alias("sessions"), F.max("time_to_trip").alias("time")).collect()}
    a, b = total(merged), total(direct)
    assert {k: v["trips"] for k, v in a.items()} == {k: v["trips"] for k, v in b.items()} == {"EXFIL": 10_000, "SUSPICIOUS": 20_000}
    assert abs(a["EXFIL"]["sessions"] - 5000) < 250 and abs(a["EXFIL"]["time"] - 15_000_000) < 600_000


def test_annotations(log, decisions):
    out = {(r["session_id"], r["n"]): r for r in detect.annotate(log, decisions).collect()}
    assert out["literal", 3]["decision"] == "blocked" and out["literal", 3]["block_reason"] == "trifecta EXFIL: send_message"
    assert out["literal", 1]["decision"] == "forwarded"


def test_redaction_reaches_into_gzip_members(spark):
    member = lambda t: base64.b64encode(gzip.compress(t.encode())).decode()
    secret, other = "acct_1234567890", member("nothing to hide")
    held = member(f"a {secret} b")
    texts = [("s", 1, f"x={held}"), ("s", 2, f"x={held}&y={other}&z={secret}"), ("t", 2, f"x={held}"), ("s", 3, None)]
    rows = spark.createDataFrame(texts, "session_id string, n long, text string")
    known = taint.forms(spark.createDataFrame([("s", 2, 1, secret, "h", "acc...7890")], "session_id string, n long, taint_ord int, value string, hash string, preview string"))
    out = {(r["session_id"], r["n"]): r["text"] for r in detect.redact_rows(rows, known, "text").collect()}
    assert out == {("s", 1): f"x={held}", ("s", 2): f"x=acc...7890&y={other}&z=acc...7890", ("t", 2): f"x={held}", ("s", 3): None}
