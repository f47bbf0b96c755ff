"""Registered queries of routing, attribution, containers, addresses and quality reports, over rows derived from `events`
and `conversations` by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..functions.text import redact_header, result_text
from ..operators import enrich, metrics, scenarios
from .agent_log import SETTINGS, events
from .queries import _PATHS, _REGISTRATIONS, query


def _rows(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))


@query("SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id AS ingest_seq, CASE event_type WHEN 'error' THEN 'syscall' ELSE 'tool' END AS plane, CASE WHEN event_type <> 'error' THEN event_type END AS tool_name, CASE event_type WHEN 'error' THEN 'connect' END AS syscall FROM events")
def fused_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("user_id").alias("session_id"), "ts", F.col("event_id").alias("ingest_seq"), "event_type")
    tools = rows.where("event_type <> 'error'").withColumn("plane", F.lit("tool")).withColumnRenamed("event_type", "tool_name")
    calls = rows.where("event_type = 'error'").withColumns({"plane": F.lit("syscall"), "syscall": F.lit("connect")}).drop("event_type")
    return enrich.fuse(tools, calls).drop("ts")


_SYSCALLS = f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'sendto' WHEN 1 THEN 'connect' WHEN 2 THEN 'openat' ELSE 'write' END AS syscall, CASE WHEN event_id % 8 = 0 THEN 53 ELSE 443 END AS dest_port, {_PATHS} AS path, repeat(cast(event_id AS string), 100) AS payload_excerpt FROM events"


@query(f"SELECT event_id, CASE WHEN syscall = 'sendto' AND dest_port = 53 THEN 'dns' ELSE syscall END AS syscall, left(payload_excerpt, 512) AS payload_excerpt FROM ({_SYSCALLS}) WHERE syscall <> 'openat' OR starts_with(path, '/etc/shadow') OR starts_with(path, '/var/run/secrets') OR starts_with(path, '/secrets')")
def prepared_syscalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.prepare_syscalls(_rows(spark, sf_dir, _SYSCALLS), list(SETTINGS.sensitive_paths)).select("event_id", "syscall", "payload_excerpt")


_NODES = "'node' || cast(user_id % 3 AS string) AS node, cast(user_id % 100 AS integer) AS pid"
_NET = f"SELECT event_id, {_NODES}, user_id % 97 AS cgroup_id, CASE event_id % 5 WHEN 0 THEN '::FFFF:10.0.0.1' WHEN 1 THEN 'fe80::1' WHEN 2 THEN NULL ELSE '10.0.0.' || cast(event_id % 9 AS string) END AS dest_ip FROM events WHERE event_type <> 'signup'"
_PIDS, _CGROUPS = f"SELECT {_NODES} FROM events WHERE event_type = 'signup'", "SELECT user_id % 97 AS cgroup_id FROM events WHERE event_type = 'signup' AND value > 50"


@query(f"SELECT event_id FROM ({_NET}) WHERE ((node, pid) IN (SELECT (node, pid) FROM ({_PIDS})) OR cgroup_id IN ({_CGROUPS})) AND (dest_ip IS NULL OR NOT contains(dest_ip, ':') OR starts_with(lower(dest_ip), '::ffff:'))")
def watched_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.watched(_rows(spark, sf_dir, _NET), _rows(spark, sf_dir, _PIDS), _rows(spark, sf_dir, _CGROUPS)).select("event_id")


@query(f"SELECT (SELECT count(DISTINCT (node, pid)) FROM ({_PIDS})) AS pids, (SELECT count(DISTINCT cgroup_id) FROM ({_CGROUPS})) AS cgroups")
def watched_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.watched_counts(_rows(spark, sf_dir, _PIDS), _rows(spark, sf_dir, _CGROUPS))


_CALLS = "SELECT event_id, user_id AS session_id, CASE event_type WHEN 'signup' THEN 'initialize' WHEN 'error' THEN 'odd/method' ELSE 'tools/call' END AS jsonrpc_method, 'tool' || cast(event_id % 4 AS string) AS tool_name, cast(NULL AS string) AS server_id FROM events"
_FIRST = f"SELECT session_id, tool_name, server_id FROM ({_REGISTRATIONS}) QUALIFY row_number() OVER (PARTITION BY session_id, tool_name ORDER BY server_pos, tool_pos) = 1"


@query(f"SELECT c.event_id, r.server_id FROM ({_CALLS}) c LEFT JOIN ({_FIRST}) r USING (session_id, tool_name)")
def tool_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.own_servers(_rows(spark, sf_dir, _CALLS), _rows(spark, sf_dir, _REGISTRATIONS)).select("event_id", "server_id")


@query(f"SELECT event_id, -32602 AS error FROM ({_CALLS}) c WHERE jsonrpc_method = 'tools/call' AND NOT EXISTS (SELECT 1 FROM ({_REGISTRATIONS}) r WHERE r.session_id = c.session_id AND r.tool_name = c.tool_name) UNION ALL SELECT event_id, -32601 FROM ({_CALLS}) WHERE jsonrpc_method = 'odd/method'")
def unknown_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.unknown_calls(_rows(spark, sf_dir, _CALLS), _rows(spark, sf_dir, _REGISTRATIONS), ["initialize", "tools/call"]).select("event_id", "error")


@query(f"SELECT 'tool_shadowing' AS kind, session_id, tool_name AS detail, 'tool ' || tool_name || ' of ' || server_id || ' is already owned by ' || owner AS reason FROM (SELECT *, row_number() OVER w AS r, first_value(server_id) OVER w AS owner FROM ({_REGISTRATIONS}) WINDOW w AS (PARTITION BY session_id, tool_name ORDER BY server_pos, tool_pos)) WHERE r > 1")
def shadowing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.shadow_audit(_rows(spark, sf_dir, _REGISTRATIONS)).drop("ts_wall")


_TRANSPORT = "SELECT event_id, 't' || cast(user_id % 60 AS string) AS transport_session_id, 's' || cast(user_id AS string) AS session_id FROM events"
_BINDINGS = "SELECT 't' || cast(user_id % 50 AS string) AS transport_session_id, 'b' || cast(event_id AS string) AS session_id, event_id AS ts FROM events WHERE event_type = 'signup'"


@query(f"SELECT e.event_id, coalesce(b.bound, e.session_id) AS session_id FROM ({_TRANSPORT}) e LEFT JOIN (SELECT transport_session_id, max_by(session_id, ts) AS bound FROM ({_BINDINGS}) GROUP BY 1) b USING (transport_session_id)")
def transport_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.bind_transport(_rows(spark, sf_dir, _TRANSPORT), _rows(spark, sf_dir, _BINDINGS)).select("event_id", "session_id")


_PODS = "SELECT 'pod' || cast(user_id % 50 AS string) AS pod_uid, event_id AS snapshot_ts, 'ns' || cast(event_id % 3 AS string) AS namespace, 'name' || cast(user_id % 50 AS string) AS pod_name, 'node' || cast(event_id % 3 AS string) AS node_name, event_id % 300 AS first_cgroup, event_id FROM events WHERE event_type = 'signup'"
_POD_CGROUPS = f"SELECT pod_uid, snapshot_ts, unnest([first_cgroup, first_cgroup + 300]) AS cgroup_id FROM ({_PODS}) QUALIFY row_number() OVER (PARTITION BY pod_uid ORDER BY snapshot_ts DESC) = 1"


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir, _PODS).withColumn("cgroup_ids", F.array("first_cgroup", F.col("first_cgroup") + 300))


@query(_POD_CGROUPS)
def pod_cgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.pod_cgroups(_snapshots(spark, sf_dir)).select("cgroup_id", "pod.pod_uid", "snapshot_ts")


_IN_PODS = f"SELECT event_id, {_NODES}, event_id % 600 AS cgroup_id, CASE WHEN event_id % 5 = 0 THEN 's' || cast(user_id AS string) ELSE '' END AS session_id FROM events"


@query(f"SELECT c.event_id, coalesce(nullif(c.session_id, ''), 'k8s:' || coalesce(g.pod_uid, p.pod_uid)) AS session_id FROM ({_IN_PODS}) c LEFT JOIN (SELECT cgroup_id, max_by(pod_uid, snapshot_ts) AS pod_uid FROM ({_POD_CGROUPS}) GROUP BY 1) g USING (cgroup_id) LEFT JOIN (SELECT DISTINCT node, pid, 'own' || cast(pid AS string) AS pod_uid FROM ({_PIDS})) p USING (node, pid)")
def pod_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pids = _rows(spark, sf_dir, _PIDS).distinct()
    pod = F.struct(F.lit("ns").alias("namespace"), F.lit("name").alias("pod_name"), F.concat(F.lit("own"), F.col("pid").cast("string")).alias("pod_uid"), F.col("node").alias("node_name"))
    return enrich.attribute_pods(_rows(spark, sf_dir, _IN_PODS), enrich.pod_cgroups(_snapshots(spark, sf_dir)), pids.select("node", "pid", pod.alias("pod"))).select("event_id", "session_id")


@query(f"SELECT pod_uid, namespace FROM ({_PODS}) WHERE event_id % 2 = 0 AND node_name = 'node1'")
def watched_pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _snapshots(spark, sf_dir).withColumn("labels", F.create_map(F.lit("watch"), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")))
    return enrich.watched_pods(labelled, "watch", node="node1").select("pod_uid", "namespace")


_CONTAINERS = f"SELECT pod_uid, sha256('init' || cast(event_id AS string)) AS container_id, event_id % 2 = 0 AS kept FROM ({_PODS}) UNION ALL SELECT pod_uid, sha256('main' || cast(event_id AS string)), TRUE FROM ({_PODS})"


def _with_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda kind, scheme, running: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(scheme), F.sha2(F.concat(F.lit(kind), F.col("event_id").cast("string")), 256)).alias("id"), running.alias("running"))
    return _snapshots(spark, sf_dir).withColumn("containers", F.array(own("init", "docker://", F.col("event_id") % 2 == 0), own("main", "containerd://", F.lit(False))))


@query(f"SELECT pod_uid, container_id FROM ({_CONTAINERS}) WHERE kept")
def pod_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.pod_containers(_with_containers(spark, sf_dir)).select("pod_uid", "container_id")


@query(f"SELECT e.event_id, c.pod_uid FROM events e JOIN ({_CONTAINERS}) c ON c.container_id = sha256((CASE e.event_id % 2 WHEN 0 THEN 'init' ELSE 'main' END) || cast(e.event_id AS string)) WHERE c.kept")
def pod_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 2 == 0, "init").otherwise("main")
    text = F.concat(F.lit("0::/kubepods/pod7/cri-containerd-"), F.sha2(F.concat(kind, F.col("event_id").cast("string")), 256), F.lit(".scope"))
    return enrich.processes_of_pods(events(spark, sf_dir).select("event_id", text.alias("cgroup_text")), _with_containers(spark, sf_dir)).select("event_id", "pod_uid")


@query("SELECT event_id, sha256(cast(event_id AS string)) AS container_id, CASE event_id % 4 WHEN 0 THEN '/a/crio-' WHEN 1 THEN '/docker/' WHEN 2 THEN '/cri-containerd:' ELSE '/b/' END || sha256(cast(event_id AS string)) || '.scope' AS cgroup_path FROM events")
def container_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    path = F.concat(F.when(k == 0, "/a/crio-").when(k == 1, "/docker/").when(k == 2, "/cri-containerd:").otherwise("/b/"), F.sha2(F.col("event_id").cast("string"), 256), F.lit(".scope"))
    rows = events(spark, sf_dir).select("event_id", F.concat(F.lit("1:name=systemd:/x\n0::"), path, F.lit("\n")).alias("text"))
    return rows.select("event_id", render.container_id("text").alias("container_id"), render.cgroup_v2_path("text").alias("cgroup_path"))


_ADDRESS = "CASE event_id % 3 WHEN 0 THEN ' ::FFFF:10.0.0.' || cast(event_id % 250 AS string) || ' ' WHEN 1 THEN 'FE80::' || cast(event_id % 99 AS string) || '%eth0' ELSE '10.1.0.' || cast(event_id % 250 AS string) END"


@query(f"SELECT event_id, concat_ws('.', u & 255, (u >> 8) & 255, (u >> 16) & 255, (u >> 24) & 255) AS quad, regexp_replace(lower(regexp_replace(trim(a), '%.*$', '')), '^::ffff:', '') AS ip FROM (SELECT event_id, event_id * 2654435761 % 4294967296 AS u, {_ADDRESS} AS a FROM events)")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, f"SELECT event_id, event_id * 2654435761 % 4294967296 AS u, {_ADDRESS} AS a FROM events")
    return rows.select("event_id", render.dotted_quad("u").alias("quad"), render.normal_ip("a").alias("ip"))


@query("SELECT event_id, CASE WHEN length(h) = 0 THEN '' WHEN length(h) <= 8 THEN '[REDACTED]' ELSE left(h, 4) || '…[REDACTED]' END AS header FROM (SELECT event_id, left(md5(cast(event_id AS string)), cast(event_id % 33 AS integer)) AS h FROM events)")
def redacted_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.substr(F.md5(F.col("event_id").cast("string")), F.lit(1), (F.col("event_id") % 33).cast("int"))
    return events(spark, sf_dir).select("event_id", redact_header(h).alias("header"))


_OPENS = "SELECT event_id, 'node' || cast(user_id % 3 AS string) AS node, user_id AS pid, '/etc/shadow' AS path, event_id AS ts, 'old' AS file_contents FROM events"
_CAPTURED = "SELECT 'node' || cast(user_id % 3 AS string) AS node, user_id AS pid, '/etc/shadow' AS path, event_id AS ts, repeat('content ' || cast(event_id AS string), 9) AS contents FROM events WHERE event_type = 'view'"


@query(f"SELECT o.event_id, coalesce(left(c.contents, 40), o.file_contents) AS file_contents FROM ({_OPENS}) o LEFT JOIN ({_CAPTURED}) c USING (node, pid, path, ts)")
def opened_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.file_contents(_rows(spark, sf_dir, _OPENS), _rows(spark, sf_dir, _CAPTURED), 40).select("event_id", "file_contents")


@query("SELECT conv_id, turn, sha256(coalesce(text, '') || chr(10)) AS text_hash FROM conversations")
def result_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"))
    raw = F.to_json(F.struct(F.array(block).alias("content")))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.withColumn("raw", raw).select("conv_id", "turn", F.sha2(result_text("raw"), 256).alias("text_hash"))


@query("SELECT cast(conv_id AS string) AS scenario_id, count(*) AS count FROM conversations GROUP BY 1 HAVING count(*) > 1")
def duplicate_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return scenarios.duplicate_ids(rows.select(F.col("conv_id").cast("string").alias("scenario_id")))
