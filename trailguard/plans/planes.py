"""Registered queries of all three planes: tool calls, system calls of attributed processes, and calls that sensors see. The
log is that of agent_log with its errors as system calls: writes with a payload, in the system-call or the sensor plane, and
opened files whose contents are secrets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import server_tags, tool_tags
from ..operators import detect, enrich, scenarios
from ..tables import cut
from .agent_log import BASE_SQL, LATEST_SQL, LOG_SQL, SETTINGS, events
from .oracle import FORMS, MASK
from .queries import query

_OPENED = "event_type = 'error' AND event_id % 3 = 2"
_BASE = BASE_SQL.replace("CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN", f"CASE WHEN event_type = 'view' AND event_id % 5 = 0 OR {_OPENED} THEN")
_BODY = LOG_SQL[LOG_SQL.index("CASE l.event_id % 7") : LOG_SQL.index("  END AS text")].strip()
#: The log's rows with a body for writes and contents for opened files, and the plane of each.
_PLANES = (
    LOG_SQL.replace("  END AS text", f"    WHEN 'error' THEN CASE WHEN l.event_id % 3 = 2 THEN 'key ' || l.secret ELSE {_BODY} END\n  END AS text")
    .replace("l.value, l.secret,", "l.secret, CASE WHEN l.event_type <> 'error' THEN 'tool' WHEN l.event_id % 3 = 0 THEN 'syscall' ELSE 'sensor' END AS plane, CASE WHEN l.event_type = 'error' THEN CASE l.event_id % 3 WHEN 2 THEN 'openat' ELSE 'write' END END AS syscall,")
)
_LOG = f"WITH base AS ({_BASE}), latest AS ({LATEST_SQL}) {_PLANES}"
_ALL_FORMS = " UNION ALL ".join(f"SELECT session_id, n AS taint_n, hash, preview, {i} AS form_ord, '{k}' AS form, {v.format('value')} AS form_value FROM taint" for i, (k, v) in enumerate(FORMS.items()))


def _leg(x: str, lights: str, again: str = "FALSE") -> tuple[str, str]:
    holds = f"(p.{x} > 0 AND e.n - p.{x} < 32 AND epoch_us(e.ts) - p.{x}_us < 259200000000 AND NOT coalesce({again}, FALSE))"
    pick = lambda old, new: f"CASE WHEN {holds} THEN p.{old} WHEN {lights} THEN {new} ELSE 0 END"
    return pick(x, "e.n"), pick(f"{x}_us", "epoch_us(e.ts)")


_LEGS = [*_leg("a", "e.tool_name IS NOT DISTINCT FROM 'read_ticket' OR e.syscall IS NOT DISTINCT FROM 'openat'"), *_leg("b", "e.tool_name IS NOT DISTINCT FROM 'fetch_page'"), *_leg("c", "e.can_trip", "e.can_trip AND e.plane = 'sensor'")]
_SQL = f"""WITH RECURSIVE base AS ({_BASE}), latest AS ({LATEST_SQL}), rows AS ({_PLANES}),
log AS (SELECT *, tool_name IS NOT DISTINCT FROM 'send_message' OR syscall IS NOT DISTINCT FROM 'write' AS can_trip FROM rows),
taint AS (SELECT session_id, min(n) AS n, secret AS value, sha256(secret) AS hash, {MASK.format('secret')} AS preview FROM log WHERE secret IS NOT NULL GROUP BY session_id, secret),
forms AS ({_ALL_FORMS}),
hits AS (SELECT s.session_id, s.n, f.hash, f.preview, f.form AS match_form FROM log s JOIN forms f ON f.session_id = s.session_id AND f.taint_n < s.n AND contains(s.text, f.form_value) WHERE s.can_trip QUALIFY row_number() OVER (PARTITION BY s.session_id, s.n ORDER BY f.taint_n, f.form_ord) = 1),
legs AS (SELECT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS a_us, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS b_us, CAST(0 AS BIGINT) AS c, CAST(0 AS BIGINT) AS c_us FROM (SELECT DISTINCT session_id FROM log)
  UNION ALL SELECT e.session_id, e.n, {', '.join(_LEGS)} FROM legs p JOIN log e ON e.session_id = p.session_id AND e.n = p.n + 1),
excerpts AS (SELECT e.session_id, e.n, e.text, s.b AS epoch, lead(e.n, 8) OVER (PARTITION BY e.session_id, s.b ORDER BY e.n) AS until FROM log e JOIN legs s USING (session_id, n) WHERE e.tool_name = 'fetch_page'),
bound AS (SELECT DISTINCT k.session_id, k.n FROM log k JOIN legs s USING (session_id, n) JOIN excerpts e ON e.session_id = k.session_id AND e.epoch = s.b AND e.n < k.n AND (e.until IS NULL OR k.n < e.until) WHERE k.can_trip AND s.b > 0 AND len(list_filter(range(1, length(k.text) - 14), lambda i: contains(e.text, substring(k.text, i, 16)))) > 0),
decided AS (SELECT k.*, s.a, s.b, s.c, h.hash, h.preview, h.match_form, CASE WHEN h.hash IS NOT NULL THEN 'EXFIL' WHEN s.a > 0 AND s.b > 0 AND s.c > 0 AND b.n IS NOT NULL THEN 'SUSPICIOUS' END AS verdict
  FROM log k JOIN legs s USING (session_id, n) LEFT JOIN hits h USING (session_id, n) LEFT JOIN bound b USING (session_id, n) WHERE k.can_trip)
"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as detection takes it: results as content blocks, writes with captured bytes, opened files with contents."""
    rows = spark.sql(_LOG.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))
    rows = enrich.resolve_tags(rows, tool_tags(spark, SETTINGS), server_tags(spark, SETTINGS))
    block = F.struct(F.lit("text").alias("type"), F.concat("text", F.lit(".")).alias("text"))
    call, opened = F.col("kind") == "syscall", F.col("syscall") == "openat"
    net = call & ~opened
    own = {"seq": F.when(~call, F.col("n")), "result": F.to_json(F.struct(F.array(block).alias("content"))), "tool_args": F.col("text"), "payload_excerpt": F.when(net, F.encode("text", "UTF-8")), "file_contents": F.when(opened, F.col("text"))}
    own |= {"path": F.when(opened, F.lit("/secrets/key")), "dest_ip": F.when(net, "203.0.113.7"), "dest_port": F.when(net, 443), "pid": F.when(call, (F.col("event_id") % 100).cast("int")), "comm": F.when(call, "curl")}
    return cut(detect.prepare(rows.withColumns(own), SETTINGS))


_TO = "' to 203.0.113.7:443 by pid ' || cast(event_id % 100 AS string)"


@query(f"""{_SQL} SELECT session_id, n, plane, coalesce(verdict, 'none') AS verdict, match_form, CASE WHEN match_form IS NOT NULL THEN CASE plane WHEN 'tool' THEN 'sink args' ELSE 'egress payload' END END AS where_found, a AS source_lit, b AS untrusted_lit, c AS sink_lit,
CASE WHEN verdict IS NULL THEN NULL WHEN plane = 'tool' THEN CASE verdict WHEN 'EXFIL' THEN 'prevented' ELSE 'allowed_monitor' END WHEN verdict = 'EXFIL' THEN 'contained_by_kill' ELSE 'detected_only' END AS action,
CASE WHEN verdict IS NOT NULL THEN CASE plane WHEN 'sensor' THEN 'sensor ' ELSE 'trifecta ' END || verdict || ': ' || CASE plane WHEN 'tool' THEN tool_name ELSE syscall || {_TO} END END AS reason FROM decided""")
def plane_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect.decide(_prepared(spark, sf_dir), SETTINGS)
    return d.select("session_id", "n", "plane", F.coalesce("verdict", F.lit("none")).alias("verdict"), "match_form", "where_found", "source_lit", "untrusted_lit", "sink_lit", "action", "reason")


@query(f"""{_SQL} SELECT d.session_id, epoch_us(d.ts) * 1000 AS trip_ts_ns, 'ebpf_variant_b' AS variant, d.verdict, coalesce(d.preview, d.text) AS payload, d.syscall, d.a > 0 AS source_lit, d.preview, (SELECT count(*) FROM log e WHERE e.session_id = d.session_id AND e.n <= d.n AND e.kind <> 'syscall') + 1 AS steps,
'external_sink_invoked: write' || ' to 203.0.113.7:443 by curl (pid ' || cast(d.event_id % 100 AS string) || ')' AS last_step FROM decided d WHERE d.verdict IS NOT NULL AND d.plane <> 'tool'""")
def plane_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import taint

    log = _prepared(spark, sf_dir)
    decisions = cut(detect.decide(log, SETTINGS).where("verdict is not null and plane <> 'tool'"))
    e = detect.evidence(decisions, log, taint.forms(detect.session_taints(log, SETTINGS)))
    last = F.element_at("timeline", -1)
    return e.select("session_id", "trip_ts_ns", "variant", "verdict", F.col("sink_call.payload_excerpt").alias("payload"), F.col("sink_call.syscall").alias("syscall"), F.col("legs.sensitive_source_touched.lit").alias("source_lit"), "value_overlap.preview", F.size("timeline").cast("long").alias("steps"), last["label"].alias("last_step"))


_LABELLED = f"""{_SQL}, labelled AS (SELECT plane, event_id % 7 <= 3 AS bad, text IS NULL AS gap, coalesce(verdict = 'EXFIL', FALSE) AS exfil, verdict IS NOT NULL AS tripped FROM decided),
o AS (SELECT plane, CASE WHEN bad AND gap THEN CASE WHEN exfil THEN 'bonus' ELSE 'known_gap' END WHEN bad THEN CASE WHEN exfil THEN 'tp' ELSE 'fn' END WHEN exfil THEN 'fp_exfil' WHEN tripped THEN 'fp_soft' ELSE 'tn' END AS o FROM labelled)"""
_OUTCOMES = ", ".join(f"count(*) FILTER (WHERE o = '{o}') AS {o}" for o in scenarios.OUTCOMES)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each call that could trip is a scenario: malicious if its body is a form of a secret; a gap if there was none yet."""
    log = _prepared(spark, sf_dir)
    name = F.concat_ws(":", "session_id", "n")
    labels = log.where("can_trip").select(name.alias("scenario_id"), F.when(F.col("event_id") % 7 <= 3, "malicious").otherwise("benign").alias("category"), F.col("plane").alias("variant"), F.col("text").isNull().alias("known_gap"))
    return scenarios.classify(scenarios.trips(labels, detect.decide(log, SETTINGS).withColumn("session_id", name)))


@query(f"{_LABELLED} SELECT plane AS variant, {_OUTCOMES} FROM o GROUP BY plane")
def outcomes_by_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.by_plane(_classified(spark, sf_dir))


@query(f"""{_LABELLED}, c AS (SELECT count(*) AS scenarios, {_OUTCOMES} FROM o)
SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS detection_rate, CASE WHEN tn + fp_soft + fp_exfil > 0 THEN (fp_soft + fp_exfil) / (tn + fp_soft + fp_exfil) ELSE 0 END AS fp_rate_any, CASE WHEN tn + fp_soft + fp_exfil > 0 THEN fp_exfil / (tn + fp_soft + fp_exfil) ELSE 0 END AS fp_rate_exfil FROM c""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.confusion(_classified(spark, sf_dir))
