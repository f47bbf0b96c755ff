"""Severities, labels, identifiers and payloads of findings and alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, col


def severity_id(verdict: ColumnOrName) -> Column:
    return F.when(col(verdict) == "EXFIL", 5).otherwise(3)


def severity(verdict: ColumnOrName) -> Column:
    return F.when(col(verdict) == "EXFIL", "Critical").otherwise("Medium")


def pager_severity(verdict: ColumnOrName) -> Column:
    return F.when(col(verdict) == "EXFIL", "critical").otherwise("warning")


def pod_session(uid: ColumnOrName) -> Column:
    return F.concat(F.lit("k8s:"), col(uid))


def ns_to_ms(ns: ColumnOrName) -> Column:
    """Divided as integers: a double holds nanoseconds since 1970 only to the nearest 256, which can cost a millisecond."""
    return F.call_function("div", col(ns), F.lit(1_000_000))


def ns_to_timestamp(ns: ColumnOrName) -> Column:
    return F.timestamp_micros(F.floor(col(ns) / 1000).cast("long"))


def percent(share: ColumnOrName) -> Column:
    return F.format_string("%.1f%%", col(share) * 100)


def container_id(cgroup_text: ColumnOrName) -> Column:
    """Container id from a process's cgroup file, by runtime: cri-o, docker, containerd, else any 64 hex digits."""
    c = col(cgroup_text)
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"crio-([0-9a-f]{64})", r"docker[-/]([0-9a-f]{64})", r"cri-containerd[-:]([0-9a-f]{64})", r"(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])")]
    return F.coalesce(*found)


def bare_container_id(c: ColumnOrName) -> Column:
    return F.regexp_replace(col(c), "^.*?://", "")


def cgroup_v2_path(cgroup_text: ColumnOrName) -> Column:
    return F.nullif(F.regexp_extract(col(cgroup_text), r"(?m)^0::(.*)$", 1), F.lit(""))


def dotted_quad(u32: ColumnOrName) -> Column:
    """A little-endian 32-bit address as text."""
    c = col(u32).cast("long")
    return F.concat_ws(".", *[F.shiftright(c, 8 * i).bitwiseAND(255).cast("string") for i in range(4)])


def normal_ip(ip: ColumnOrName) -> Column:
    """Trimmed, without zone, IPv4 in IPv6 as IPv4, lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(col(ip)), "%.*$", "")), r"^::ffff:(?=\d+\.)", "")


def syscall_detail(syscall="syscall", ip="dest_ip", port="dest_port", pid="pid", comm="comm", path="path") -> Column:
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(""))
    to = F.concat(text(ip), F.lit(":"), text(port), F.lit(" by pid "), text(pid), F.lit(" ("), text(comm), F.lit(")"))
    return (
        F.when(col(syscall) == "write", F.concat(F.lit("write() egress correlated to "), to))
        .when(col(syscall) == "openat", F.concat(F.lit("openat sensitive path "), text(path), F.lit(" by pid "), text(pid), F.lit(" ("), text(comm), F.lit(")")))
        .when(col(syscall) == "dns", F.concat(F.lit("dns sendto "), to))
        .otherwise(F.concat(text(syscall), F.lit(" to "), to))
    )


def event_summary() -> Column:
    """One line for a log row."""
    size = F.octet_length(F.coalesce("tool_args", "result", F.lit("")))
    return F.concat_ws(" ", F.col("direction"), F.coalesce("jsonrpc_method", F.lit("response")), F.col("tool_name"), F.concat(F.lit("session="), F.col("session_id")), F.concat(F.lit("seq="), F.col("seq")), F.concat(size.cast("string"), F.lit("B")), F.when(F.col("decision") == "blocked", F.concat(F.lit("BLOCKED "), F.coalesce("block_reason", F.lit("")))))


def finding_uid(session="session_id", ts="trip_ts_ns") -> Column:
    return F.concat_ws("-", col(session), col(ts).cast("string"))


def alert_summary() -> Column:
    target = F.coalesce("sink_call.tool_name", F.concat_ws(" ", "sink_call.syscall", "sink_call.dest_ip"))
    return F.concat(F.lit("["), F.col("verdict"), F.lit("] session "), F.col("session_id"), F.lit(": "), F.coalesce(target, F.lit("unknown")), F.lit(" ("), F.col("action"), F.lit(")"))


def ocsf_finding(product: str = "trailguard") -> Column:
    """OCSF 1.3 Detection Finding (class 2004) as JSON; null members are left out."""
    uid = finding_uid()
    lit = F.lit
    return F.to_json(
        F.struct(
            lit(2004).alias("class_uid"), lit("Detection Finding").alias("class_name"), lit(2).alias("category_uid"), lit(200401).alias("type_uid"), lit(1).alias("activity_id"),
            ns_to_ms("trip_ts_ns").alias("time"), severity_id("verdict").alias("severity_id"), severity("verdict").alias("severity"), alert_summary().alias("message"),
            F.struct(lit("1.3.0").alias("version"), F.struct(lit(product).alias("name")).alias("product")).alias("metadata"),
            F.struct(uid.alias("uid"), F.concat(lit("Trifecta "), F.col("verdict")).alias("title"), F.array("verdict").alias("types")).alias("finding_info"),
            F.struct("session_id", "variant", "action", "confidence", "legs", "value_overlap", "sink_call").alias("unmapped"),
        )
    )


def chat_alert() -> Column:
    return F.to_json(F.struct(alert_summary().alias("text")))


def generic_alert() -> Column:
    when = F.date_format(F.to_utc_timestamp(ns_to_timestamp("trip_ts_ns"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.to_json(F.struct("session_id", "verdict", "action", "variant", "confidence", alert_summary().alias("summary"), when.alias("tripped_at"), "value_overlap", "sink_call"))


def pager_alert(routing_key: str, product: str = "trailguard") -> Column:
    payload = F.struct(alert_summary().alias("summary"), F.lit(product).alias("source"), pager_severity("verdict").alias("severity"))
    return F.to_json(F.struct(F.lit(routing_key).alias("routing_key"), F.lit("trigger").alias("event_action"), finding_uid().alias("dedup_key"), payload.alias("payload")))
