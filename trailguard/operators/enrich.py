"""Tags, attribution and correlation of events with dimensions and with each other."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.render import bare_container_id, container_id, normal_ip, pod_session

RPC_TIMEOUT_S, CONNECT_TTL_S = 30, 5


def resolve_tags(events: DataFrame, tools: DataFrame, servers: DataFrame) -> DataFrame:
    """tags: the tool's own, even if empty, else the server's; is_source, is_sink. The dimensions are configuration."""
    rows = events.drop("tags").join(tools.withColumnRenamed("tags", "_tool"), "tool_name", "left").join(servers.withColumnRenamed("tags", "_server"), "server_id", "left")
    rows = rows.withColumn("tags", F.coalesce("_tool", "_server")).drop("_tool", "_server")
    has = lambda t: F.coalesce(F.array_contains("tags", t), F.lit(False))
    return rows.withColumns({"is_source": has("sensitive_source"), "is_sink": has("external_sink")})


def drop_allowlisted(syscalls: DataFrame, allowlist: DataFrame) -> DataFrame:
    """System calls to addresses that aren't allowed, raw or normalised; files and others without an address stay."""
    ips = allowlist.select(F.explode(F.array(F.col("ip"), normal_ip("ip"))).alias("_ip")).distinct()
    rows = syscalls.withColumn("_norm", normal_ip("dest_ip"))
    return rows.join(ips, F.col("dest_ip") == F.col("_ip"), "left_anti").join(ips, F.col("_norm") == F.col("_ip"), "left_anti").drop("_norm")


def sensitive_path(path: str, prefixes: list[str]) -> Column:
    """Whether the path begins with one of the prefixes, as text; never without prefixes."""
    hit = F.lit(False)
    for p in prefixes:
        if p:
            hit = hit | F.coalesce(F.startswith(F.col(path), F.lit(p)), F.lit(False))
    return hit


def prepare_syscalls(syscalls: DataFrame, prefixes: list[str], capture: int = 512) -> DataFrame:
    """dns for sendto port 53, payload cut to the capture size, open calls of other than sensitive paths dropped."""
    n = max(64, min(1024, capture))
    rows = syscalls.withColumn("syscall", F.when((F.col("syscall") == "sendto") & (F.col("dest_port") == 53), "dns").otherwise(F.col("syscall")))
    rows = rows.withColumn("payload_excerpt", F.substring("payload_excerpt", 1, n))
    return rows.where((F.col("syscall") != "openat") | sensitive_path("path", prefixes))


def watched(syscalls: DataFrame, pids: DataFrame, cgroups: DataFrame) -> DataFrame:
    """System calls of watched processes (node, pid) or cgroups (cgroup_id), IPv4 only."""
    p = pids.select("node", "pid").distinct().withColumn("_pid", F.lit(True))
    c = cgroups.select("cgroup_id").distinct().withColumn("_cgroup", F.lit(True))
    rows = syscalls.join(p, ["node", "pid"], "left").join(c, "cgroup_id", "left").where("_pid or _cgroup").drop("_pid", "_cgroup")
    return rows.where(F.col("dest_ip").isNull() | (F.instr("dest_ip", ":") == 0) | F.lower("dest_ip").startswith("::ffff:"))


def correlate_writes(syscalls: DataFrame, ttl_s: float = CONNECT_TTL_S, keys: tuple[str, ...] = ("node", "pid", "start_ts")) -> DataFrame:
    """Backward as-of: a write takes the destination of its process's latest connect or sendto within ttl_s (inclusive);
    writes without one are dropped. One sort by process and time. start_ts tells apart processes that reuse a pid."""
    order = Window.partitionBy(*keys).orderBy("ts", F.when(F.col("syscall") == "write", 1).otherwise(0), "ingest_seq")
    dest = F.when(F.col("syscall").isin("connect", "sendto", "dns"), F.struct("ts", "dest_ip", "dest_port"))
    rows = syscalls.withColumn("_c", F.last(dest, ignorenulls=True).over(order))
    fresh = F.coalesce(F.unix_micros("ts") - F.unix_micros("_c.ts") <= int(ttl_s * 1_000_000), F.lit(False))
    write = F.col("syscall") == "write"
    rows = rows.where(~write | fresh)
    return rows.withColumns({c: F.when(write, F.col(f"_c.{c}")).otherwise(F.col(c)) for c in ("dest_ip", "dest_port")}).drop("_c")


def attribute_processes(syscalls: DataFrame, registry: DataFrame, slice_s: int = 86_400) -> DataFrame:
    """session_id and server_id of the process that had the pid at the time: of intervals (start_ts, end_ts; the end is
    outside, null: still open) that hold it, the one that started last. A null node, pid or time matches nothing.

    Not a range join: starts and calls of a process are sorted by time and swept, with the open intervals in a heap. Time is
    cut into slices and an interval stands in each that it covers, so a process of many calls is many tasks' work."""
    known = syscalls.where("node is not null and pid is not null and ts is not null")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    slice_us = slice_s * 1_000_000
    of = lambda t: F.floor(t / slice_us).cast("long")
    calls = known.select("node", "pid", of(us("ts")).alias("_slice"), us("ts").alias("_at"), F.lit(1).alias("_kind"), F.struct(*[F.col(f"`{c}`") for c in syscalls.columns]).alias("_call"))
    last = calls.agg(F.max("_at")).scalar()  # no interval is open for longer than there are calls
    r = registry.where("node is not null and pid is not null and start_ts is not null and (end_ts is null or end_ts > start_ts)")
    r = r.select("node", "pid", us("start_ts").alias("_from"), us("end_ts").alias("_to"), F.col("session_id").cast("string").alias("_session"), F.col("server_id").cast("string").alias("_server")).withColumn("_last", last).where("_from <= _last")
    until = F.least(F.col("_last"), F.coalesce(F.col("_to") - 1, F.col("_last")))
    r = r.withColumn("_slice", F.explode(F.sequence(of(F.col("_from")), of(until))))
    starts = r.select("node", "pid", "_slice", F.col("_from").alias("_at"), F.lit(0).alias("_kind"), "_from", "_to", "_session", "_server")
    both = starts.unionByName(calls, allowMissingColumns=True).repartition("node", "pid", "_slice").sortWithinPartitions("node", "pid", "_slice", "_at", "_kind")
    kept = [F.col(f"_call.`{c}`") for c in syscalls.columns if c not in ("session_id", "server_id")]
    schema = T.StructType([T.StructField("_call", syscalls.schema), *T.StructType.fromDDL("_session string, _server string").fields])
    found = both.select("node", "pid", "_slice", "_at", "_from", "_to", "_session", "_server", "_call", "_kind").mapInArrow(_owners, schema)
    unknown = syscalls.where("node is null or pid is null or ts is null").select(F.struct(*[F.col(f"`{c}`") for c in syscalls.columns]).alias("_call"), F.lit(None).cast("string").alias("_session"), F.lit(None).cast("string").alias("_server"))
    own = F.col("_call.session_id") if "session_id" in syscalls.columns else F.lit(None).cast("string")
    return found.unionByName(unknown).select(*kept, F.coalesce(F.nullif(own, F.lit("")), F.col("_session")).alias("session_id"), F.col("_server").alias("server_id"))


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps starts and calls sorted by process, slice and time; a heap holds the open intervals, last start first."""
    process, heap = None, []
    for b in batches:
        sessions, servers = [], []
        for node, pid, part, at, start, end, session, server, kind in zip(*(b.column(c).to_pylist() for c in ("node", "pid", "_slice", "_at", "_from", "_to", "_session", "_server", "_kind")), strict=True):
            if (node, pid, part) != process:
                process, heap = (node, pid, part), []
            if kind == 0:  # of equal starts the later end, then the larger session, goes first
                heapq.heappush(heap, (-start, -(1 << 63) if end is None else -end, _Last(session or ""), session, server or ""))
                continue
            while heap and -heap[0][1] <= at:
                heapq.heappop(heap)
            sessions.append(heap[0][3] if heap else None)
            servers.append(heap[0][4] or None if heap else None)
        calls = b.column("_call").filter(pc.equal(b.column("_kind"), 1))
        yield pa.RecordBatch.from_arrays([calls, pa.array(sessions, pa.string()), pa.array(servers, pa.string())], ["_call", "_session", "_server"])


class _Last(str):
    """A text whose order is turned round, for a heap that gives the least first."""

    __slots__ = ()

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


def attribute_pods(syscalls: DataFrame, cgroups: DataFrame, pids: DataFrame) -> DataFrame:
    """pod_context and session_id by cgroup (the mapping's latest), else by process. cgroups: cgroup_id, pod,
    snapshot_ts; pids: node, pid, pod."""
    c = cgroups.groupBy("cgroup_id").agg(F.max_by("pod", "snapshot_ts").alias("_by_cgroup"))
    p = pids.select("node", "pid", F.col("pod").alias("_by_pid"))
    rows = syscalls.join(c, "cgroup_id", "left").join(p, ["node", "pid"], "left").withColumn("pod_context", F.coalesce("_by_cgroup", "_by_pid"))
    return rows.withColumn("session_id", F.coalesce(F.nullif("session_id", F.lit("")), pod_session("pod_context.pod_uid"))).drop("_by_cgroup", "_by_pid")


def pod_cgroups(snapshots: DataFrame) -> DataFrame:
    """Cgroups of each pod by its latest snapshot: later sets replace earlier ones."""
    last = snapshots.groupBy("pod_uid").agg(F.max_by(F.struct("snapshot_ts", "namespace", "pod_name", "node_name", "cgroup_ids"), "snapshot_ts").alias("s"))
    pod = F.struct(F.col("s.namespace").alias("namespace"), F.col("s.pod_name").alias("pod_name"), "pod_uid", F.col("s.node_name").alias("node_name"))
    return last.select(F.explode("s.cgroup_ids").alias("cgroup_id"), pod.alias("pod"), F.col("s.snapshot_ts").alias("snapshot_ts"))


def watched_pods(snapshots: DataFrame, label: str, node: str | None = None, namespace: str | None = None) -> DataFrame:
    rows = snapshots.where(F.element_at("labels", label) == "true")
    if node:
        rows = rows.where(F.col("node_name") == node)
    return rows.where(F.col("namespace") == namespace) if namespace else rows


def pod_containers(snapshots: DataFrame) -> DataFrame:
    """Container ids of pods: init containers only while they run, others always."""
    kept = F.filter("containers", lambda c: (c["kind"] != "init") | c["running"])
    return snapshots.select("namespace", "pod_name", "pod_uid", "node_name", F.explode(F.transform(kept, lambda c: bare_container_id(c["id"]))).alias("container_id")).where("container_id <> ''")


def processes_of_pods(processes: DataFrame, pods: DataFrame) -> DataFrame:
    """Processes joined to the pod whose container their cgroup names."""
    return processes.withColumn("container_id", container_id("cgroup_text")).join(pod_containers(pods), "container_id")


def process_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Processes (node, pid, start_time_ns) that were added or removed between snapshots."""
    keys = ["node", "pid", "start_time_ns"]
    change = lambda a, b, name: a.select(keys).distinct().join(b.select(keys), keys, "left_anti").withColumn("change", F.lit(name))
    return change(after, before, "added").union(change(before, after, "removed"))


def split_attributed(syscalls: DataFrame, reason: str = "no session attribution for monitored PID") -> tuple[DataFrame, DataFrame]:
    """System calls with a session, and audit records of the others, which detection leaves out."""
    none = F.coalesce(F.col("session_id"), F.lit("")) == ""
    audit = syscalls.where(none).select(F.lit("unattributed_syscall").alias("kind"), F.lit(reason).alias("reason"), F.col("ts").alias("ts_wall"), F.lit(None).cast("string").alias("session_id"), F.concat_ws(" ", "syscall", "dest_ip", F.concat(F.lit("pid="), F.col("pid"))).alias("detail"))
    return syscalls.where(~none), audit


def pair_responses(requests: DataFrame, responses: DataFrame, timeout_s: int = RPC_TIMEOUT_S) -> DataFrame:
    """Requests (session_id, rpc_id, ts, tool_name) with the first response within the timeout; ts_response is null and
    timed_out true without one. A request without an id (or session) is a notification: nothing answers it, nor does it
    time out; a response without one, such as of a parse error, answers nothing."""
    keys = ["session_id", "rpc_id"]
    there, none = " and ".join(f"{k} is not null" for k in keys), " or ".join(f"{k} is null" for k in keys)
    # union and a window instead of a join: clients use the same few ids again and again
    r = responses.where(there).select(*keys, F.col("ts").alias("_at"), F.lit(1).alias("_kind"), F.struct(F.col("ts").alias("ts_response"), F.col("result").alias("result")).alias("_r"))
    q = requests.where(there).select(*keys, F.col("ts").alias("_at"), F.lit(0).alias("_kind"), F.struct(*requests.columns).alias("_q"))
    # backwards in time the last response seen is the next one; of equal times the least
    order = Window.partitionBy(*keys).orderBy(F.desc("_at"), F.desc("_kind"), F.desc("_r"))
    rows = r.unionByName(q, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_kind = 0")
    near = F.coalesce(F.col("_r.ts_response") <= F.col("_at") + F.make_interval(secs=F.lit(timeout_s)), F.lit(False))
    paired = rows.select("_q.*", F.when(near, F.col("_r.ts_response")).alias("ts_response"), F.when(near, F.col("_r.result")).alias("result"), (~near).alias("timed_out"))
    kinds = dict(responses.dtypes)
    return paired.unionByName(requests.where(none).withColumns({"ts_response": F.lit(None).cast(kinds["ts"]), "result": F.lit(None).cast(kinds["result"]), "timed_out": F.lit(False)}))


def pair_responses_stream(requests: DataFrame, responses: DataFrame, timeout_s: int = RPC_TIMEOUT_S, lateness: str = "10 minutes") -> DataFrame:
    """The same of two streams, by an interval join with a watermark on either side: a request comes out when no response
    within its timeout can come any more, timeouts are the join's null side. Requests without an id don't come out; requests
    alike in all columns come out once."""
    q = requests.where("session_id is not null and rpc_id is not null").withWatermark("ts", lateness)
    r = responses.where("session_id is not null and rpc_id is not null").select(F.col("session_id").alias("_s"), F.col("rpc_id").alias("_i"), F.col("ts").alias("_ts"), F.col("result").alias("_result")).withWatermark("_ts", lateness)
    within = (F.col("_ts") >= F.col("ts")) & (F.col("_ts") <= F.col("ts") + F.expr(f"interval {timeout_s} seconds"))
    both = q.join(r, (F.col("session_id") == F.col("_s")) & (F.col("rpc_id") == F.col("_i")) & within, "leftOuter")
    answer = F.when(F.col("_ts").isNotNull(), F.struct(F.col("_ts").cast("timestamp").alias("ts_response"), F.col("_result").alias("result")))
    one = both.select(*requests.columns, answer.alias("_r")).groupBy(*requests.columns).agg(F.min("_r").alias("_r"))
    return one.select(*requests.columns, "_r.ts_response", "_r.result", F.col("_r").isNull().alias("timed_out"))


def route_tools(registrations: DataFrame) -> DataFrame:
    """Registrations with owner (the first server of a session that named the tool) and shadowed (a later one)."""
    w = Window.partitionBy("session_id", "tool_name").orderBy("server_pos", "tool_pos")
    rows = registrations.withColumn("rank", F.row_number().over(w)).withColumn("owner", F.first("server_id").over(w))
    return rows.withColumn("shadowed", F.col("rank") > 1)


def shadow_audit(registrations: DataFrame) -> DataFrame:
    rows = route_tools(registrations).where("shadowed")
    return rows.select(F.lit("tool_shadowing").alias("kind"), F.concat(F.lit("tool "), F.col("tool_name"), F.lit(" of "), F.col("server_id"), F.lit(" is already owned by "), F.col("owner")).alias("reason"), F.lit(None).cast("timestamp").alias("ts_wall"), "session_id", F.col("tool_name").alias("detail"))


def own_servers(events: DataFrame, registrations: DataFrame) -> DataFrame:
    """Events with the server that owns their tool."""
    routes = route_tools(registrations).where("not shadowed").select("session_id", "tool_name", F.col("owner").alias("_owner"))
    return events.join(routes, ["session_id", "tool_name"], "left").withColumn("server_id", F.coalesce("server_id", "_owner")).drop("_owner")


def unknown_calls(requests: DataFrame, registrations: DataFrame, methods: list[str]) -> DataFrame:
    """Requests that name no known tool (-32602) or method (-32601)."""
    routes = registrations.select("session_id", "tool_name").distinct()
    tools = requests.where("jsonrpc_method = 'tools/call'").join(routes, ["session_id", "tool_name"], "left_anti").withColumn("error", F.lit(-32602))
    return tools.unionByName(requests.where(~F.col("jsonrpc_method").isin(methods)).withColumn("error", F.lit(-32601)))


def bind_transport(events: DataFrame, bindings: DataFrame) -> DataFrame:
    """Internal session of a transport session: its latest binding (transport_session_id, session_id, ts)."""
    last = bindings.groupBy("transport_session_id").agg(F.max_by("session_id", "ts").alias("_bound"))
    return events.join(last, "transport_session_id", "left").withColumn("session_id", F.coalesce("_bound", "session_id")).drop("_bound")


def file_contents(opens: DataFrame, contents: DataFrame, most: int = 65536) -> DataFrame:
    """Open calls with the content captured for them (node, pid, path, ts), cut to `most` bytes."""
    c = contents.select("node", "pid", "path", "ts", F.col("contents").alias("_c"))
    cut = F.substring(F.encode("_c", "UTF-8"), 1, most)
    return opens.join(c, ["node", "pid", "path", "ts"], "left").withColumn("file_contents", F.coalesce(cut.cast("string"), F.col("file_contents"))).drop("_c")


def first_event(log: DataFrame) -> DataFrame:
    """Per-session sequence n over both planes in ingest order: tool events and system calls in one log."""
    return log.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "ingest_seq")).cast("long"))


def fuse(tools: DataFrame, syscalls: DataFrame) -> DataFrame:
    """One session log of both planes, numbered."""
    return first_event(tools.unionByName(syscalls, allowMissingColumns=True))
