"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import base64
import gzip
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import server_tags, tool_tags
from ..functions import render
from ..functions.text import encoded_forms, mask, secrets, sha256
from ..operators import detect, enrich, metrics, overlap, rollups, taint
from ..operators.bind import content_bound
from ..operators.legs import excerpts, leg_states
from ..sources import readers, writers
from ..tables import cut
from .agent_log import AGENT_LOG_SQL, SETTINGS, agent_log, events
from .oracle import MASK, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, *names: str):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, *names)
        return f

    return register


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.resolve_tags(agent_log(spark, sf_dir), tool_tags(spark, SETTINGS), server_tags(spark, SETTINGS))


def _sources(log: DataFrame) -> DataFrame:
    rows = log.where("kind = 'result' and is_source")
    return rows.select("session_id", "n", F.concat_ws("/", "server_id", "tool_name").alias("source"), "text")


def _sinks(log: DataFrame) -> DataFrame:
    return log.where("kind = 'request' and is_sink and text is not null").select("session_id", "n", "text")


def _taint(log: DataFrame) -> DataFrame:
    return taint.taints(_sources(log), SETTINGS.patterns, reassemble=False)


def _lit(log: DataFrame) -> DataFrame:
    return log.withColumns({"lights_source": F.col("is_source") & (F.col("kind") == "result"), "lights_untrusted": ~F.col("is_source") & (F.col("kind") == "result"), "lights_sink": (F.col("is_sink") & (F.col("kind") == "request")) | (F.col("kind") == "syscall")})


def _states(log: DataFrame) -> DataFrame:
    return leg_states(_lit(log), SETTINGS.leg_ttl_s, SETTINGS.decay_after_calls)


@query(AGENT_LOG_SQL.replace("l.value, l.secret,", "CASE WHEN l.secret IS NULL THEN 0 ELSE 1 END AS has_secret,"))
def agent_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agent_log(spark, sf_dir).withColumn("has_secret", F.col("secret").isNotNull().cast("int")).drop("secret", "value")


@query("SELECT session_id, n, CASE tool_name WHEN 'read_ticket' THEN 'sensitive_source' WHEN 'send_message' THEN 'external_sink' WHEN 'fetch_page' THEN '' END AS tags, tool_name IS NOT DISTINCT FROM 'read_ticket' AS is_source, tool_name IS NOT DISTINCT FROM 'send_message' AS is_sink FROM agent_log", "agent_log")
def tag_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir).select("session_id", "n", F.array_join("tags", ",").alias("tags"), "is_source", "is_sink")


@query(f"SELECT session_id, n, pattern, pos, sha256(value) AS hash, {MASK.format('value')} AS preview FROM found", "found")
def secret_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sources(_tagged(spark, sf_dir)).select("session_id", "n", F.explode(secrets("text", SETTINGS.patterns)).alias("s"))
    return rows.select("session_id", "n", F.col("s.pattern").alias("pattern"), F.col("s.pos").cast("long").alias("pos"), sha256("s.value").alias("hash"), mask("s.value").alias("preview"))


_DOC_TOKEN = r'token = "([0-9a-f]{40})"'


@query(f"SELECT doc_id, pos, sha256(value) AS hash, {MASK.format('value')} AS preview FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_DOC_TOKEN}', 1)) AS value, unnest(range(len(regexp_extract_all(text, '{_DOC_TOKEN}', 1)))) AS pos FROM documents)")
def secret_extraction_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.explode(secrets("text", (("doc_token", _DOC_TOKEN, 1),))).alias("s"))
    return rows.select("doc_id", F.col("s.pos").cast("long").alias("pos"), sha256("s.value").alias("hash"), mask("s.value").alias("preview"))


@query("SELECT session_id, taint_n, form, sha256(form_value) AS form_hash, length(form_value) AS form_length FROM forms", "forms")
def encoded_forms_of_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _taint(_tagged(spark, sf_dir)).select("session_id", F.col("n").alias("taint_n"), F.explode(encoded_forms("value")).alias("f"))
    return rows.select("session_id", "taint_n", F.col("f.form").alias("form"), sha256("f.form_value").alias("form_hash"), F.length("f.form_value").cast("long").alias("form_length"))


@query("SELECT session_id, n, tainted_hash, preview, match_form FROM hits", "hits")
def overlap_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cut(_tagged(spark, sf_dir))
    found = taint.forms(_taint(log))
    return overlap.raw_hits(_sinks(log), found, "contains").select("session_id", "n", "tainted_hash", "preview", "match_form")


@query("SELECT session_id, n, tainted_hash, preview, match_form FROM hits", "hits")
def overlap_first_hit_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cut(_tagged(spark, sf_dir))
    found = taint.forms(_taint(log))
    return overlap.raw_hits(_sinks(log), found, "anchor").select("session_id", "n", "tainted_hash", "preview", "match_form")


@query("""
, args AS (SELECT session_id, n, '{"a":"' || left(text, 11) || '","b":"' || substring(text, 12) || '"}' AS args FROM agent_log WHERE tool_name = 'send_message' AND text IS NOT NULL),
joined AS (SELECT session_id, n, args, json_extract_string(args, '$.a') || json_extract_string(args, '$.b') AS text FROM args)
SELECT s.session_id, s.n, f.hash AS tainted_hash, f.preview, f.form AS match_form FROM joined s JOIN forms f ON f.session_id = s.session_id AND f.taint_n < s.n AND contains(s.text, f.form_value)
QUALIFY row_number() OVER (PARTITION BY s.session_id, s.n ORDER BY f.taint_n, f.form_ord) = 1
""", "forms")  # fmt: skip
def overlap_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cut(_tagged(spark, sf_dir))
    split = F.format_string('{"a":"%s","b":"%s"}', F.substring("text", 1, 11), F.substr(F.col("text"), F.lit(12)))
    sinks = _sinks(log).withColumn("text", split)
    return overlap.reassembled_hits(sinks, taint.forms(_taint(log))).select("session_id", "n", "tainted_hash", "preview", "match_form")


@query("""
, packed AS (SELECT session_id, n, text, base64(cast(text AS blob)) AS once, event_id % 2 AS twice FROM agent_log WHERE tool_name = 'send_message' AND text IS NOT NULL),
layers AS (
  SELECT session_id, n, 0 AS path, 'decoded_base64' AS match_form, text AS t FROM packed WHERE twice = 0
  UNION ALL SELECT session_id, n, 1, 'decoded_base64_base64', decode(from_base64(text)) FROM packed WHERE twice = 0 AND regexp_full_match(text, '([A-Za-z0-9+/]{4})+(==)?') AND base64(try(from_base64(text))) = text AND length(text) = 44
  UNION ALL SELECT session_id, n, 2, 'decoded_hex', once FROM packed WHERE twice = 1
  UNION ALL SELECT session_id, n, 3, 'decoded_hex_base64', text FROM packed WHERE twice = 1)
SELECT s.session_id, s.n, f.hash AS tainted_hash, f.preview, s.match_form FROM layers s JOIN forms f ON f.session_id = s.session_id AND f.taint_n < s.n AND f.form_ord < 5 AND contains(s.t, f.form_value)
QUALIFY row_number() OVER (PARTITION BY s.session_id, s.n ORDER BY s.path, f.taint_n) = 1
""", "forms")  # fmt: skip
def overlap_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cut(_tagged(spark, sf_dir))
    once = F.translate(F.base64(F.col("text").cast("binary")), "\r\n", "")
    rows = log.where("kind = 'request' and is_sink and text is not null")
    packed = F.when(F.col("event_id") % 2 == 0, once).otherwise(F.lower(F.hex(once)))
    sinks = rows.select("session_id", "n", packed.alias("text"), F.lit(False).alias("payload"))
    return overlap.decoded_hits(sinks, taint.forms(_taint(log))).select("session_id", "n", "tainted_hash", "preview", "match_form")


_VIEWS = "SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view'"
_HALF = "'sk-live-' || substring(md5(cast(cast(session_id AS string) || ':' || cast({0} AS string) AS binary)), 1, 24)"


@query(f"""
WITH v AS ({_VIEWS}), s AS (SELECT session_id, n, {_HALF.format('(n + 1) // 2')} AS secret FROM v),
c AS (SELECT session_id, n, CASE WHEN n % 2 = 1 THEN 'Part ' || left(secret, 16) ELSE substring(secret, 17) || ' end' END AS chunk FROM s),
b AS (SELECT session_id, n, string_agg(chunk, '') OVER (PARTITION BY session_id ORDER BY n ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS buffer FROM c),
f AS (SELECT session_id, n, unnest(regexp_extract_all(buffer, '\\b(sk[-_](?:live|test)[-_][A-Za-z0-9]{{10,}})\\b', 1)) AS value FROM b)
SELECT session_id, min(n) AS n, sha256(value) AS hash, {MASK.format('value')} AS preview FROM f GROUP BY session_id, value
""")  # fmt: skip
def fragment_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets split over two results of a source each, found in the rolling buffer."""
    v = spark.sql(_VIEWS.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
    rows = v.withColumn("secret", F.expr(_HALF.format("((n + 1) div 2)")))
    chunk = F.when(F.col("n") % 2 == 1, F.concat(F.lit("Part "), F.substring("secret", 1, 16))).otherwise(F.concat(F.substr("secret", F.lit(17)), F.lit(" end")))
    results = rows.select("session_id", "n", F.lit("tickets/read_ticket").alias("source"), F.concat(chunk, F.lit("\n")).alias("text"))
    return taint.taints(results, SETTINGS.patterns).select("session_id", "n", "hash", "preview")


@query("SELECT session_id, n FROM all_bound", "all_bound")
def content_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cut(_tagged(spark, sf_dir))
    states = _states(log)
    sinks = _sinks(log).join(states.select("session_id", "n", F.col("untrusted_lit").alias("epoch")), ["session_id", "n"])
    return content_bound(sinks, excerpts(_lit(log).where("lights_untrusted"), states))


@query("SELECT * FROM states", "states")
def leg_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(_tagged(spark, sf_dir))


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as detection takes it: results are content blocks, as tools give them, each a sentence, so that the rolling
    buffer runs no secret into the next text."""
    log = _tagged(spark, sf_dir)
    block = F.struct(F.lit("text").alias("type"), F.concat("text", F.lit(".")).alias("text"))
    none = lambda t: F.lit(None).cast(t)
    frames = {"plane": F.when(F.col("kind") == "syscall", "syscall").otherwise("tool"), "seq": F.col("n"), "result": F.to_json(F.struct(F.array(block).alias("content"))), "tool_args": F.col("text")}
    calls = {"syscall": F.when(F.col("kind") == "syscall", "connect"), "dest_port": none("int"), "pid": none("int")} | {c: none("string") for c in ("dest_ip", "comm", "path", "file_contents", "payload_excerpt")}
    return cut(detect.prepare(log.withColumns(frames | calls), SETTINGS))


def _taint_of(log: DataFrame) -> DataFrame:
    return detect.session_taints(log, SETTINGS)


def _decisions(log: DataFrame) -> DataFrame:
    return detect.decide(log, SETTINGS).where("kind = 'request'")


@query("SELECT session_id, n, coalesce(verdict, 'none') AS verdict, match_form FROM verdicts", "verdicts")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(_prepared(spark, sf_dir)).select("session_id", "n", F.coalesce("verdict", F.lit("none")).alias("verdict"), "match_form")


@query("SELECT session_id, n, verdict, action, CAST(confidence AS DOUBLE) AS confidence, 'trifecta ' || verdict || ': send_message' AS reason FROM trips", "trips")
def recommended_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(_prepared(spark, sf_dir)).where("verdict is not null").select("session_id", "n", "verdict", "action", "confidence", "reason")


@query("SELECT e.session_id, e.n, CASE WHEN t.action = 'prevented' THEN 'blocked' ELSE 'forwarded' END AS decision, CASE WHEN t.action = 'prevented' THEN 'trifecta ' || t.verdict || ': send_message' END AS block_reason FROM agent_log e LEFT JOIN trips t USING (session_id, n)", "trips")
def annotated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _prepared(spark, sf_dir)
    return detect.annotate(log, _decisions(log)).select("session_id", "n", "decision", "block_reason")


@query("""SELECT t.session_id, t.n AS trip_n, row_number() OVER (PARTITION BY t.session_id, t.n ORDER BY e.n) AS timeline_seq, e.n AS ref,
CASE WHEN e.n = t.source_lit THEN 'sensitive_source_touched: tool ' || e.tool_name || ' returned sensitive data' WHEN e.n = t.untrusted_lit THEN 'untrusted_content_present: untrusted content from tool result (tool=' || e.tool_name || ')'
  WHEN e.n = t.sink_lit THEN 'external_sink_invoked: external sink tool ' || e.tool_name || ' invoked' WHEN e.kind = 'result' THEN e.tool_name || ' result returned' ELSE e.tool_name || ' called' END AS label
FROM trips t JOIN agent_log e ON e.session_id = t.session_id AND e.n <= t.n AND e.kind <> 'syscall'""", "trips")  # fmt: skip
def evidence_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _prepared(spark, sf_dir)
    trips = cut(_decisions(log).where("verdict is not null"))
    rows = detect.timeline(trips, log).select("session_id", F.col("n").alias("trip_n"), F.explode("timeline").alias("t"))
    return rows.select("session_id", "trip_n", F.col("t.timeline_seq").cast("long").alias("timeline_seq"), F.col("t.ref").cast("long").alias("ref"), F.col("t.label").alias("label"))


_REPLACED = "s.text"
for _form in ("l.secret", "base64(cast(l.secret AS blob))", "lower(hex(l.secret))", "reverse(l.secret)"):
    _REPLACED = f"replace({_REPLACED}, {_form}, {MASK.format('l.secret')})"


@query(f"SELECT s.session_id, s.n, CASE WHEN l.secret IS NULL THEN s.text ELSE {_REPLACED} END AS text FROM agent_log s LEFT JOIN (SELECT a.session_id, a.n, b.secret FROM latest a JOIN base b ON b.session_id = a.session_id AND b.n = a.secret_n) l ON l.session_id = s.session_id AND l.n = s.n WHERE s.tool_name = 'send_message'", "agent_log")
def redacted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = cut(_tagged(spark, sf_dir))
    rows = log.where("is_sink and kind = 'request'").select("session_id", "n", "text")
    return detect.redact_rows(rows, taint.forms(_taint(log)), "text")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _prepared(spark, sf_dir)
    return detect.evidence(cut(_decisions(log)), log, taint.forms(_taint_of(log)))


@query("SELECT session_id, trip_ts_ns, verdict, CAST(confidence AS DOUBLE) AS confidence, source_lit AS source_seq, untrusted_lit AS untrusted_seq, tainted_hash, preview, match_form FROM trips", "trips")
def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    return e.select(F.col("session_id"), "trip_ts_ns", "verdict", "confidence", F.col("legs.sensitive_source_touched.trigger_seq").alias("source_seq"), F.col("legs.untrusted_content_present.trigger_seq").alias("untrusted_seq"), "value_overlap.tainted_hash", "value_overlap.preview", "value_overlap.match_form")


@query("SELECT 2004 AS class_uid, 200401 AS type_uid, CASE verdict WHEN 'EXFIL' THEN 5 ELSE 3 END AS severity_id, CASE verdict WHEN 'EXFIL' THEN 'Critical' ELSE 'Medium' END AS severity, trip_ts_ns // 1000000 AS time, cast(session_id AS string) || '-' || cast(trip_ts_ns AS string) AS uid FROM trips", "trips")
def ocsf_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _evidence(spark, sf_dir).select(F.from_json(render.ocsf_finding(), "class_uid int, type_uid int, severity_id int, severity string, time long, finding_info struct<uid:string>").alias("f"))
    return f.select("f.class_uid", "f.type_uid", "f.severity_id", "f.severity", "f.time", F.col("f.finding_info.uid").alias("uid"))


@query("SELECT '[' || verdict || '] session ' || cast(session_id AS string) || ': send_message (' || action || ')' AS summary, CASE verdict WHEN 'EXFIL' THEN 'critical' ELSE 'warning' END AS severity, cast(session_id AS string) || '-' || cast(trip_ts_ns AS string) AS dedup_key, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS tripped_at FROM trips", "trips")
def alert_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir).withColumn("session_id", F.col("session_id").cast("string"))
    rows = e.select(F.from_json(render.pager_alert("key"), "dedup_key string, payload struct<summary:string,severity:string>").alias("p"), F.from_json(render.generic_alert(), "tripped_at string").alias("g"))
    return rows.select("p.payload.summary", "p.payload.severity", "p.dedup_key", "g.tripped_at")


@query("SELECT verdict, 'proxy_variant_a' AS variant, action, count(*) AS detections FROM trips GROUP BY ALL", "trips")
def detections_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.detections_total(_evidence(spark, sf_dir))


@query("SELECT kind, CASE WHEN kind = 'chat' THEN 'skipped' WHEN verdict = 'EXFIL' THEN 'ok' ELSE 'error' END AS result, count(*) AS deliveries FROM trips, (VALUES ('pager'), ('chat')) k(kind) GROUP BY ALL", "trips")
def deliveries_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = writers.outbox(_evidence(spark, sf_dir), [("pager", "https://pager.invalid", render.pager_alert("key")), ("chat", "", render.chat_alert())])
    return metrics.deliveries_total(writers.deliver(box, lambda kind, target, payload: 202 if "[EXFIL]" in payload else 500))


@query("""SELECT e.session_id, min(e.ts) AS created, max(e.ts) AS last_activity, count(*) AS events, CASE WHEN any_value(t.trips) > 0 THEN 'tripped' ELSE 'active' END AS status, CAST(coalesce(any_value(t.confidence), 0) AS DOUBLE) AS confidence, CAST(coalesce(any_value(x.taints), 0) AS BIGINT) AS taints, CAST(coalesce(any_value(t.trips), 0) AS BIGINT) AS trips
FROM agent_log e LEFT JOIN (SELECT session_id, count(*) AS trips, max_by(confidence, n) AS confidence FROM trips GROUP BY 1) t USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS taints FROM taint GROUP BY 1) x USING (session_id) GROUP BY e.session_id""", "trips")  # fmt: skip
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _prepared(spark, sf_dir)
    return metrics.session_summary(log, _decisions(log), _taint_of(log))


_RUNS = "runs AS (SELECT session_id, ts, n, sum(new) OVER (PARTITION BY session_id ORDER BY n) AS run FROM (SELECT session_id, ts, n, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY session_id ORDER BY n) > 86400000000 OR n = 1 THEN 1 ELSE 0 END AS new FROM agent_log)), idle AS (SELECT session_id, run, min(ts) AS first_event, max(ts) AS last_event, count(*) AS events, max(ts) + INTERVAL 1 DAY AS expires FROM runs GROUP BY session_id, run)"


@query(f", {_RUNS} SELECT session_id, CAST(run AS BIGINT) AS run, first_event, last_event, events, expires FROM idle", "agent_log")
def idle_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.idle_sessions(agent_log(spark, sf_dir), 86400)


@query(f", {_RUNS}, m AS (SELECT tm, sum(d) AS d FROM (SELECT first_event AS tm, 1 AS d FROM idle UNION ALL SELECT expires, -1 FROM idle) GROUP BY tm), o AS (SELECT tm, sum(d) OVER (ORDER BY tm) AS open FROM m) SELECT CAST(max(open) AS BIGINT) AS peak, (SELECT min(tm) FROM o WHERE open = (SELECT max(open) FROM o)) AS peak_at, count(*) FILTER (WHERE open > 32) AS over_limit FROM o", "agent_log")
def peak_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.peak_sessions(metrics.idle_sessions(agent_log(spark, sf_dir), 86400), "first_event", "expires", 32)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .oracle import CTE

    return spark.sql(CTE["calls"].replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))


@query("SELECT w.event_id, w.node, w.pid, c.dest_ip, c.event_id AS connect_id FROM (SELECT * FROM calls WHERE syscall = 'write') w ASOF JOIN (SELECT * FROM calls WHERE syscall = 'connect') c ON w.node = c.node AND w.pid = c.pid AND w.ts >= c.ts WHERE epoch_us(w.ts) - epoch_us(c.ts) <= 21600000000", "calls")
def write_connect_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The port of a connect holds its event here, so that a write shows which one it took. Six hours instead of five
    seconds suit this log."""
    calls = _calls(spark, sf_dir).withColumn("dest_port", F.when(F.col("syscall") == "connect", F.col("event_id")))
    rows = enrich.correlate_writes(calls, 6 * 3600, ("node", "pid")).where("syscall = 'write'")
    return rows.select("event_id", "node", "pid", "dest_ip", F.col("dest_port").alias("connect_id"))


_REGISTRY = "SELECT 'node' || cast(user_id % 3 AS string) AS node, cast(user_id % 20 AS integer) AS pid, ts AS start_ts, CASE event_id % 5 WHEN 0 THEN ts + INTERVAL '240' HOUR WHEN 1 THEN ts + INTERVAL '1' HOUR WHEN 2 THEN ts + INTERVAL '30' HOUR WHEN 3 THEN ts + INTERVAL '12' HOUR END AS end_ts, 's' || cast(event_id AS string) AS session_id, 'srv' || cast(event_id % 4 AS string) AS server_id FROM events WHERE event_type = 'signup'"


_OWNED = f"SELECT c.event_id, max_by(r.session_id, r.start_ts) AS session_id, max_by(r.server_id, r.start_ts) AS server_id FROM calls c LEFT JOIN ({_REGISTRY}) r ON c.node = r.node AND c.pid = r.pid AND c.ts >= r.start_ts AND (r.end_ts IS NULL OR c.ts < r.end_ts) GROUP BY c.event_id"


@query(f" {_OWNED}", "calls")
def pid_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.sql(_REGISTRY.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
    return enrich.attribute_processes(_calls(spark, sf_dir), registry).select("event_id", "session_id", "server_id")


@query(f" SELECT 'unattributed_syscall' AS kind, count(*) AS records FROM ({_OWNED}) WHERE session_id IS NULL", "calls")
def unattributed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = spark.sql(_REGISTRY.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
    _, audit = enrich.split_attributed(enrich.attribute_processes(_calls(spark, sf_dir), registry))
    return audit.groupBy("kind").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT event_id, dest_ip FROM calls WHERE dest_ip NOT IN ('10.96.0.1', '10.96.0.10')", "calls")
def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..config import allowlist

    return enrich.drop_allowlisted(_calls(spark, sf_dir), allowlist(spark, SETTINGS)).select("event_id", "dest_ip")


_PATHS = "CASE event_id % 6 WHEN 0 THEN '/etc/shadow' WHEN 1 THEN '/secretsX/a' WHEN 2 THEN '/var/run/secrets/token' WHEN 3 THEN '/home/x' WHEN 4 THEN '/etc/passwd' END"


@query(f"SELECT event_id, path FROM (SELECT event_id, {_PATHS} AS path FROM events) WHERE starts_with(path, '/etc/shadow') OR starts_with(path, '/var/run/secrets') OR starts_with(path, '/secrets')")
def sensitive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.expr(_PATHS).alias("path"))
    return rows.where(enrich.sensitive_path("path", list(SETTINGS.sensitive_paths)))


_REGISTRATIONS = "SELECT user_id AS session_id, cast(event_id AS integer) AS server_pos, 'srv' || cast(event_id % 5 AS string) AS server_id, 0 AS tool_pos, 'tool' || cast(event_id % 3 AS string) AS tool_name FROM events WHERE event_type = 'signup'"


@query(f"WITH r AS ({_REGISTRATIONS}) SELECT session_id, tool_name, server_id, first_value(server_id) OVER w AS owner, row_number() OVER w > 1 AS shadowed FROM r WINDOW w AS (PARTITION BY session_id, tool_name ORDER BY server_pos, tool_pos)")
def tool_shadowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_REGISTRATIONS.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
    return enrich.route_tools(rows).select("session_id", "tool_name", "server_id", "owner", "shadowed")


@query("SELECT session_id, trip_ts_ns, verdict FROM trips ORDER BY trip_ts_ns DESC, n DESC LIMIT 500", "trips")
def evidence_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = _decisions(_prepared(spark, sf_dir)).where("verdict is not null")
    rows = trips.select("session_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("trip_ts_ns"), "verdict", F.col("n").alias("id"))
    return metrics.retain(rows, 500).drop("id")


@query("SELECT session_id, trip_ts_ns, verdict FROM trips QUALIFY row_number() OVER (ORDER BY trip_ts_ns DESC, session_id DESC) = 1", "trips")
def latest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.latest(_evidence(spark, sf_dir)).select("session_id", "trip_ts_ns", "verdict")


_Q = "max(d) FILTER (WHERE k = cast(floor((n - 1) * {0}) AS bigint)) AS {1}"


@query("SELECT label, max(n) AS samples, avg(d) AS mean, " + ", ".join(_Q.format(s, c) for s, c in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"), (0.999, "p999"))) + " FROM (SELECT event_type AS label, cast(round(value * 1000) AS bigint) AS d, row_number() OVER (PARTITION BY event_type ORDER BY round(value * 1000)) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY label")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = events(spark, sf_dir).select(F.col("event_type").alias("label"), F.round(F.col("value") * 1000).cast("long").alias("duration_ns"))
    return metrics.latency_quantiles(samples)


_SNAPSHOT = "SELECT 'node' || cast(user_id % 3 AS string) AS node, cast(user_id % 20 AS integer) AS pid, event_id % 5000 AS start_time_ns FROM events WHERE event_type = '{0}'"


@query(f"WITH a AS ({_SNAPSHOT.format('view')}), b AS ({_SNAPSHOT.format('click')}) SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def process_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind: spark.sql(_SNAPSHOT.format(kind).replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
    return enrich.process_diff(part("view"), part("click"))


_COUNTERS = "SELECT event_type AS name, ts, cast(floor(value) AS bigint) AS value, event_id FROM events"


@query(f"SELECT name, CAST(sum(increment) AS BIGINT) AS total FROM (SELECT name, greatest(0, value - coalesce(max(value) OVER (PARTITION BY name ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS increment FROM ({_COUNTERS})) GROUP BY name")
def counter_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_COUNTERS.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
    return metrics.counter_increments(rows).groupBy("name").agg(F.sum("increment").alias("total"))


_FRAMES = """SELECT user_id AS session_id, ts AS ts_wall, event_id AS ingest_pos, CASE event_type
WHEN 'purchase' THEN '{"jsonrpc":"2.0","id":' || cast(event_id AS string) || ',"method":"tools/call","params":{"name":"send_message","arguments":{"to":"x"}}}'
WHEN 'view' THEN '{"jsonrpc":"2.0","id":' || cast(event_id AS string) || ',"result":{"ok":true}}'
ELSE '{"jsonrpc":"2.0","method":"notifications/' || event_type || '"}' END AS line FROM events"""


@query(f"WITH f AS ({_FRAMES}) SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts_wall, ingest_pos) AS seq, CASE WHEN json_extract_string(line, '$.method') IS NULL THEN 'response' WHEN json_extract_string(line, '$.id') IS NULL THEN 'notification' ELSE 'request' END AS frame_class, json_extract_string(line, '$.params.name') AS tool_name, json_extract_string(line, '$.id') AS rpc_id FROM f")
def frame_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(_FRAMES.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
    return readers.project_frames(rows).select("session_id", "seq", "frame_class", "tool_name", "rpc_id")


@query("WITH q AS (SELECT user_id AS s, event_id, nullif(event_id % 5, 4) AS rpc, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id AS s, nullif(event_id % 5, 4) AS rpc, ts FROM events WHERE event_type = 'view') SELECT q.event_id, min(r.ts) AS ts_response, min(r.ts) IS NULL AND any_value(q.rpc) IS NOT NULL AS timed_out FROM q LEFT JOIN r ON q.s = r.s AND q.rpc = r.rpc AND r.ts >= q.ts AND r.ts <= q.ts + INTERVAL 12 HOUR GROUP BY q.event_id")
def request_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), F.nullif(F.col("event_id") % 5, F.lit(4)).alias("rpc_id"), "event_id", "ts", "event_type", F.lit(None).cast("string").alias("result"))
    pairs = enrich.pair_responses(e.where("event_type = 'purchase'").drop("result"), e.where("event_type = 'view'"), 12 * 3600)
    return pairs.select("event_id", "ts_response", "timed_out")


@query("SELECT window_start, verdict, destination, count(*) AS trips, count(DISTINCT session_id) AS sessions FROM (SELECT date_trunc('day', ts) AS window_start, verdict, 'send_message' AS destination, session_id FROM trips) GROUP BY ROLLUP (window_start, verdict, destination)", "trips")
def trip_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trips_by(_evidence(spark, sf_dir), "1 day")


@query("SELECT date_trunc('month', ts) AS window_start, verdict, count(*) AS trips, TRUE AS sessions_close, TRUE AS time_close FROM trips GROUP BY ALL", "trips")
def trip_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days' stored sketches merged to months: trips are exact; distinct sessions and the median time to trip are held
    against exact ones, with the sketches' error bounds."""
    e = cut(_evidence(spark, sf_dir))
    months = rollups.read_trips(rollups.merge_trips(cut(rollups.sketch_trips(e)), "month", ("verdict",)))
    when = F.date_trunc("month", render.ns_to_timestamp("trip_ts_ns"))
    waited = F.floor((F.col("trip_ts_ns") - F.col("legs.sensitive_source_touched.lit_at_ns")) / 1000)
    rows = e.select(when.alias("window_start"), "verdict", "session_id", F.when(F.col("legs.sensitive_source_touched.lit"), waited).alias("waited"))
    exact = rows.groupBy("window_start", "verdict").agg(F.count_distinct("session_id").alias("exact"), F.count_if(F.col("waited").isNotNull()).alias("n"), F.percentile("waited", F.array(F.lit(0.46), F.lit(0.54))).alias("around"))
    close = F.abs(F.col("sessions") - F.col("exact")) <= F.lit(0.05) * F.col("exact") + 1
    time = (F.col("n") == 0) | F.col("time_to_trip").between(F.floor(F.col("around")[0]) - 1, F.ceil(F.col("around")[1]) + 1)
    return months.join(exact, ["window_start", "verdict"]).select("window_start", "verdict", "trips", close.alias("sessions_close"), time.alias("time_close"))


@query()
def gzip_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks whose body is gzipped and in base64."""
    log = cut(_tagged(spark, sf_dir))

    @F.pandas_udf("string")
    def squeeze(text: pd.Series) -> pd.Series:
        return text.map(lambda t: "data=" + base64.b64encode(gzip.compress(t.encode(), 9)).decode())

    sinks = _sinks(log).withColumn("text", squeeze("text"))
    return overlap.gzip_hits(sinks, taint.forms(_taint(log))).select("session_id", "n", "tainted_hash", "preview", "match_form")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which outbound calls leaked a secret that the same session had read before?"""
    hits = overlap_first_hit(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("n")
    return hits.withColumn("leak", F.row_number().over(w))


from . import attribution, planes  # noqa: E402, F401  their queries are registered here too
