"""Counts, session summaries, retention, latency and data-quality reports."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import redact_header


def _known(c: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c)


def detections_total(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy(_known("verdict"), _known("variant"), _known("action")).agg(F.count(F.lit(1)).alias("detections"))


def observed(df: DataFrame, name: str, *by: str, values: dict[str, list[str]]) -> tuple[DataFrame, Observation]:
    """df, counting as it is written the rows of each combination of known values of the columns `by` (others: `other`):
    detections by verdict, variant and action, or deliveries by kind and status, at no job of their own. The second is read
    after the write, by export_counters; on a stream give df.observe(name, *counts(...)) and let a Drops listener read it."""
    seen = Observation(name)
    return df.observe(seen, *counts(*by, values=values)), seen


def counts(*by: str, values: dict[str, list[str]]) -> list[Column]:
    """A count of rows for each combination of the columns' known values, named `a|b|c`, and one of all others."""
    out, known = [], F.lit(False)
    for combination in product(*(values[c] for c in by)):
        here = F.coalesce(reduce(lambda a, b: a & b, [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")) == v for c, v in zip(by, combination, strict=True)]), F.lit(False))
        known = known | here
        out.append(F.count_if(here).alias("|".join(combination)))
    return [*out, F.count_if(~known).alias("other")]


DETECTIONS = {"verdict": ["EXFIL", "SUSPICIOUS"], "variant": ["proxy_variant_a", "ebpf_variant_b"], "action": ["prevented", "allowed_monitor", "contained_by_kill", "detected_only"]}
DELIVERIES = {"kind": ["chat", "hook", "pager", "siem", "taint"], "status": ["ok", "error", "skipped"]}


def export_counters(spark: SparkSession, seen: Observation, job: str, path: str) -> None:
    """Append what a job observed to the table of counters: name (job/observation/metric), ts, value. Each job is a run of
    its own, so its value is its increment."""
    rows = [(f"{job}/{seen._name}/{k}", v) for k, v in seen.get.items()]
    spark.createDataFrame(rows, "name string, value long").select("name", F.current_timestamp().alias("ts"), "value").write.mode("append").parquet(path)


def deliveries_total(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("kind", F.col("status").alias("result")).agg(F.count(F.lit(1)).alias("deliveries"))


def counter_increments(counters: DataFrame) -> DataFrame:
    """name, ts, increment of counters that only grow; what is lower than the highest before it counts nothing. Highest by
    day first, then within days, so that no task sorts all of a counter's rows."""
    day = F.to_date("ts")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    days = counters.groupBy("name", day.alias("_day")).agg(F.max("value").alias("_most"))
    days = days.withColumn("_before", F.max("_most").over(before("name").orderBy("_day"))).drop("_most")
    rows = counters.withColumn("_day", day).join(days, ["name", "_day"])
    highest = F.greatest(F.max("value").over(before("name", "_day").orderBy("ts")), F.col("_before"), F.lit(0))
    return rows.withColumn("increment", F.greatest(F.lit(0), F.col("value") - highest)).drop("_day", "_before")


def session_summary(log: DataFrame, decisions: DataFrame, taint: DataFrame) -> DataFrame:
    """created, last_activity, events, status (tripped once is tripped), last confidence, secrets of each session."""
    own = log.groupBy("session_id").agg(F.min("ts").alias("created"), F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("events"))
    trips = decisions.where("verdict is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("trips"), F.max_by("confidence", "n").alias("confidence"))
    secrets = taint.groupBy("session_id").agg(F.count(F.lit(1)).alias("taints"))
    rows = own.join(trips, "session_id", "left").join(secrets, "session_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("session_id", "created", "last_activity", "events", F.when(F.col("trips") > 0, "tripped").otherwise("active").alias("status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), zero("taints"), zero("trips"))


def idle_sessions(log: DataFrame, idle_s: int) -> DataFrame:
    """Runs of a session's events without a pause over idle_s: first, last, events, and when each counts as expired."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("session_id").orderBy("ts", "n")
    rows = log.withColumn("_us", us).withColumn("_new", F.coalesce((F.col("_us") - F.lag("_us").over(w) > idle_s * 1_000_000).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("_new").over(w))
    return rows.groupBy("session_id", "run").agg(F.min("ts").alias("first_event"), F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("events")).withColumn("expires", F.col("last_event") + F.make_interval(secs=F.lit(idle_s)))


def concurrent_sessions(sessions: DataFrame, start: str, end: str) -> DataFrame:
    """at, open: how many sessions are open from each time on at which that changes, by day and then within days, so that
    no single task sorts all changes: a day's start value is a running sum over days."""
    moves = sessions.select(F.col(start).alias("at"), F.lit(1).alias("d")).union(sessions.select(F.col(end).alias("at"), F.lit(-1).alias("d")))
    moves = moves.groupBy("at").agg(F.sum("d").alias("d")).withColumn("day", F.to_date("at"))
    days = moves.groupBy("day").agg(F.sum("d").alias("net"))
    base = days.withColumn("base", F.coalesce(F.sum("net").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("net")
    w = Window.partitionBy("day").orderBy("at")
    return moves.join(base, "day").select("at", (F.col("base") + F.sum("d").over(w)).alias("open"))


def peak_sessions(sessions: DataFrame, start: str, end: str, limit: int) -> DataFrame:
    """peak, first time of the peak, and how many changes left more than `limit` open."""
    return concurrent_sessions(sessions, start, end).agg(F.max("open").alias("peak"), F.min_by("at", F.struct(-F.col("open"), F.col("at"))).alias("peak_at"), F.count_if(F.col("open") > limit).alias("over_limit"))


def trips_by(evidence: DataFrame, window: str = "1 hour") -> DataFrame:
    """Trips and sessions by time window, verdict and destination, with subtotals."""
    when = F.timestamp_micros(F.floor(F.col("trip_ts_ns") / 1000).cast("long"))
    to = F.coalesce("sink_call.dest_ip", "sink_call.tool_name")
    rows = evidence.select(F.window(when, window)["start"].alias("window_start"), "verdict", to.alias("destination"), "session_id")
    return rows.rollup("window_start", "verdict", "destination").agg(F.count(F.lit(1)).alias("trips"), F.count_distinct("session_id").alias("sessions"))


def retain(evidence: DataFrame, most: int, tenant: str | None = None) -> DataFrame:
    """The latest `most` records (all for 0), of each tenant if named. Without a tenant a cut-off day is found from counts
    by day, so only the rows of one day are ranked together."""
    if most <= 0:
        return evidence
    latest = [F.col("trip_ts_ns").desc(), F.col("id").desc()]
    if tenant:
        return evidence.withColumn("_r", F.row_number().over(Window.partitionBy(tenant).orderBy(*latest))).where(F.col("_r") <= most).drop("_r")
    day = F.floor(F.col("trip_ts_ns") / 86_400_000_000_000)
    days = evidence.groupBy(day.alias("_day")).count()
    w = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("_after", F.coalesce(F.sum("count").over(w), F.lit(0))).where(F.col("_after") < most).drop("count")
    rows = evidence.withColumn("_day", day).join(F.broadcast(days) if most < 1_000_000 else days, "_day")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("_day").orderBy(*latest))).where(F.col("_after") + F.col("_r") <= most).drop("_r", "_day", "_after")


def latency_quantiles(samples: DataFrame, shares=(0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    """label, samples, mean and exact order statistics: of n sorted durations the one at floor((n - 1) * share).

    Durations are counted by value first, and positions are running counts over values, so equal durations are one row."""
    counts = samples.groupBy("label", "duration_ns").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("label").orderBy("duration_ns")
    rows = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy("label")))
    picks = []
    for share in shares:
        at = F.floor((F.col("n") - 1) * F.lit(share))
        here = (at < F.col("upto")) & (at >= F.col("upto") - F.col("c"))
        picks.append(F.max(F.when(here, F.col("duration_ns"))).alias(f"p{f'{share * 100:g}'.replace('.', '')}"))
    mean = (F.sum(F.col("duration_ns") * F.col("c")) / F.sum("c")).alias("mean")
    return rows.groupBy("label").agg(F.sum("c").alias("samples"), mean, *picks)


def approx_latency(samples: DataFrame, shares=(0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    """The same, approximately, in one pass without a sort."""
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("samples"), F.percentile_approx("duration_ns", list(shares), 10_000).alias("approx"))


def watched_counts(pids: DataFrame, cgroups: DataFrame) -> DataFrame:
    return pids.agg(F.count_distinct("node", "pid").alias("pids")).crossJoin(cgroups.agg(F.count_distinct("cgroup_id").alias("cgroups")))  # one row each


def check_requests(requests: DataFrame, versions: list[str], origins: list[str]) -> DataFrame:
    """Conformance of logged requests: ok and the first reason against each; credentials masked."""
    c = F.col
    call, first = c("mcp_method") == "tools/call", c("mcp_method") == "initialize"
    body = lambda p: F.get_json_object("body", p)
    notification = body("$.id").isNull()
    why = (
        F.when(~first & ~F.coalesce(c("protocol_version").isin(versions), F.lit(False)), "protocol version")
        .when(~(F.coalesce(F.contains("accept", F.lit("application/json")) & F.contains("accept", F.lit("text/event-stream")), F.lit(False))), "accept")
        .when((F.coalesce("origin", F.lit("")) != "") & ~c("origin").isin(origins), "origin")
        .when(c("mcp_method").isNotNull() & (body("$.method") != c("mcp_method")), "method header and body differ")
        .when(call & c("mcp_name").isNotNull() & (body("$.params.name") != c("mcp_name")), "tool header and body differ")
        .when(~first & ~notification & (F.coalesce("mcp_session_id", F.lit("")) == ""), "no session id")
    )
    return requests.select("ts", "mcp_session_id", "mcp_method", "mcp_name", redact_header("authorization").alias("authorization"), redact_header("cookie").alias("cookie"), why.isNull().alias("ok"), why.alias("reason"))
