"""Verdicts over a fused session log, and the evidence of trips.

The log (see `prepare`) has one row per event: session_id, n, ts, plane (tool, syscall, sensor), kind (result, request,
syscall), text (what is searched: result text, arguments, payload), source (who gave a result), is_source, is_sink, seq,
label, detail, and the call's columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import redact, redact_inflated, result_text
from ..tables import cut
from .bind import content_bound
from .legs import excerpts, leg_states
from .overlap import overlaps
from .taint import forms, taints

CALL = ("tool_name", "server_id", "seq", "syscall", "dest_ip", "dest_port", "pid", "comm", "path")


def prepare(log: DataFrame, settings: Settings) -> DataFrame:
    """Adds what an event lights, whether it can trip, its text, and its labels to a fused log (tags resolved; n set)."""
    from ..functions.render import syscall_detail

    plane, kind, call = F.col("plane"), F.col("kind"), F.col("syscall")
    result, request, syscall = kind == "result", kind == "request", kind == "syscall"
    sensor_open = (plane == "sensor") & (call == "openat")
    text = F.when(result, result_text(F.when(result, F.col("result")))).when(request, F.col("tool_args")).when(sensor_open, F.col("file_contents")).otherwise(F.decode("payload_excerpt", "ISO-8859-1"))
    source = F.when(sensor_open, F.concat(F.lit("sensor:"), F.coalesce(F.nullif("path", F.lit("")), F.lit("(unknown)")))).otherwise(F.concat_ws("/", "server_id", "tool_name"))
    untrusted = result & ~F.col("is_source") & F.lit(settings.untrusted_tool_results)
    egress = syscall & ~sensor_open
    detail = (
        F.when(result & F.col("is_source"), F.concat(F.lit("tool "), F.col("tool_name"), F.lit(" returned sensitive data")))
        .when(result, F.concat(F.lit("untrusted content from tool result (tool="), F.col("tool_name"), F.lit(")")))
        .when(request, F.concat(F.lit("external sink tool "), F.col("tool_name"), F.lit(" invoked")))
        .otherwise(syscall_detail())
    )
    label = F.when(result, F.concat("tool_name", F.lit(" result returned"))).when(request, F.concat("tool_name", F.lit(" called")))
    return log.withColumns(
        {
            "text": text, "source": source, "detail": detail, "label": label,
            "lights_source": (result & F.col("is_source")) | sensor_open,
            "lights_untrusted": untrusted,
            "lights_sink": (request & F.col("is_sink")) | egress,
            "relight_sink": (plane == "sensor") & egress,
            # what is compared: requests of sinks, and payloads other than of opened files
            "can_trip": (request & F.col("is_sink")) | egress,
            "payload": syscall,
        }
    )


def verdict(overlap: Column, lit: Column, bound: Column) -> Column:
    """EXFIL for an overlap, whatever the legs; SUSPICIOUS for three lit legs and bound content; else null."""
    return F.when(overlap, "EXFIL").when(lit & bound, "SUSPICIOUS")


def confidence(v: str = "verdict") -> Column:
    return F.when(F.col(v) == "EXFIL", 0.95).when(F.col(v) == "SUSPICIOUS", 0.60)


def recommended_action(v: str, syscall: Column, mode: str) -> Column:
    exfil = F.col(v) == "EXFIL"
    tool = F.when(exfil & F.lit(mode == "block"), "prevented").otherwise("allowed_monitor")
    return F.when(F.col(v).isNotNull(), F.when(syscall, F.when(exfil, "contained_by_kill").otherwise("detected_only")).otherwise(tool))


def reason(v: str = "verdict") -> Column:
    to = F.concat_ws("", "syscall", F.lit(" to "), "dest_ip", F.lit(":"), F.col("dest_port").cast("string"), F.lit(" by pid "), F.col("pid").cast("string"))
    open_ = F.concat_ws("", F.lit("openat "), "path", F.lit(" by pid "), F.col("pid").cast("string"))
    what = F.when(F.col("kind") == "request", F.col("tool_name")).when(F.col("syscall") == "openat", open_).otherwise(to)
    return F.when(F.col(v).isNotNull(), F.concat(F.when(F.col("plane") == "sensor", "sensor ").otherwise("trifecta "), F.col(v), F.lit(": "), what))


def session_taints(log: DataFrame, settings: Settings, feed: DataFrame | None = None) -> DataFrame:
    rows = log.where("lights_source and text is not null").select("session_id", "n", "source", "text", "plane")
    # only tool results are reassembled over the buffer
    tools = taints(rows.where("plane <> 'sensor'"), settings.patterns, settings.fragment_max_chunks, settings.fragment_max_bytes, more=feed)
    files = taints(rows.where("plane = 'sensor'"), settings.patterns, reassemble=False)
    both = tools.unionByName(files)
    return both.groupBy("session_id", "hash").agg(F.min(F.struct("n", "taint_ord", "source", "value", "preview")).alias("f")).select(
        "session_id", "hash", "f.n", "f.source", "f.value", "f.preview", F.row_number().over(Window.partitionBy("session_id").orderBy("f.n", "f.taint_ord")).alias("taint_ord")
    )


def decide(log: DataFrame, settings: Settings, feed: DataFrame | None = None) -> DataFrame:
    """A row per event that could trip: states of the legs, first overlap, whether content is bound, verdict, confidence,
    recommended action, reason. log: from `prepare`.

    What feeds several joins, the legs' states, the secrets' forms and the texts to compare, is computed once and cut off
    from its lineage; each is far smaller than the log."""
    keys = ["session_id", "n"]
    states = cut(leg_states(log, settings.leg_ttl_s, settings.decay_after_calls))
    sinks = cut(log.where("can_trip").select(*keys, F.col("text"), "payload", "syscall"))
    compared = sinks.where("coalesce(syscall, '') <> 'openat' and text is not null and text <> ''")
    found = cut(forms(session_taints(log, settings, feed)))
    hits = overlaps(compared.select(*keys, "text", "payload"), found)
    lit = states.where("source_lit > 0 and untrusted_lit > 0 and sink_lit > 0").select(*keys, F.col("untrusted_lit").alias("epoch"))
    bound = content_bound(sinks.join(lit, keys), excerpts(log.where("lights_untrusted"), states), settings.content_bind_min_len)
    rows = log.where("can_trip").select(*keys, "ts", "plane", "kind", *[c for c in CALL if c in log.columns])
    rows = rows.join(states, keys).join(hits, keys, "left").join(bound.withColumn("bound", F.lit(True)), keys, "left")
    all_lit = (F.col("source_lit") > 0) & (F.col("untrusted_lit") > 0) & (F.col("sink_lit") > 0)
    rows = rows.withColumn("bound", F.coalesce("bound", F.lit(False))).withColumn("verdict", verdict(F.col("tainted_hash").isNotNull(), all_lit, F.col("bound")))
    return rows.withColumns({"confidence": confidence(), "action": recommended_action("verdict", F.col("kind") == "syscall", settings.mode), "reason": reason()})


def annotate(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """decision (forwarded, blocked) and block_reason of every log row."""
    blocked = decisions.where("action in ('prevented')").select("session_id", "n", F.lit("blocked").alias("decision"), F.col("reason").alias("block_reason"))
    return log.drop("decision", "block_reason").join(blocked, ["session_id", "n"], "left").withColumn("decision", F.coalesce("decision", F.lit("forwarded")))


def redact_rows(rows: DataFrame, forms_: DataFrame, column: str) -> DataFrame:
    """column with every form of the secrets that its session had registered by then replaced by its preview, and so are
    gzip members that hold one. Only texts that may have a member leave the JVM."""
    f = forms_.select("session_id", "taint_n", F.struct("taint_ord", "form_ord", "form_value", "preview").alias("f"))
    # a session's forms are gathered once, and each row takes those known by then
    lists = f.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("f.*", "taint_n"))).alias("_forms"))
    own = ("taint_ord", "form_ord", "form_value", "preview")
    known = F.transform(F.filter("_forms", lambda x: x["taint_n"] <= F.col("n")), lambda x: F.struct(*[x[c].alias(c) for c in own]))
    out = rows.join(lists, "session_id", "left").withColumn("_forms", known).withColumn(column, F.when(F.col("_forms").isNull(), F.col(column)).otherwise(redact(column, "_forms")))
    member = F.contains(F.col(column), F.lit("H4sI"))
    literals = F.filter("_forms", lambda x: (x["form_ord"] == 0) & (x["form_value"] != ""))
    return out.withColumn(column, F.coalesce(redact_inflated(F.when(member, F.col(column)), F.when(member, literals)), column)).drop("_forms")


def timeline(trips: DataFrame, log: DataFrame) -> DataFrame:
    """session_id, n, timeline: the session's numbered events up to each trip. trips: session_id, n and the three *_lit;
    only logs of sessions that tripped are joined, and nothing is kept in state."""
    events = log.where("kind <> 'syscall'").select("session_id", F.col("n").alias("e_n"), "seq", "label", "detail", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    t = trips.select("session_id", "n", "source_lit", "untrusted_lit", "sink_lit", "kind")
    rows = t.join(events, "session_id").where("e_n <= n")
    leg = F.lit(None).cast("string")
    sink = (F.col("e_n") == F.col("sink_lit")) & (F.col("kind") != "syscall")
    for hit, name in ((sink, "external_sink_invoked"), (F.col("e_n") == F.col("untrusted_lit"), "untrusted_content_present"), (F.col("e_n") == F.col("source_lit"), "sensitive_source_touched")):
        leg = F.when(hit, F.concat(F.lit(f"{name}: "), F.col("detail"))).otherwise(leg)
    label = F.coalesce(leg, F.col("label"), F.concat(F.lit("event #"), F.col("seq")))
    item = F.struct("e_n", (F.col("us") * 1000).alias("ts_mono_ns"), F.lit("intercepted").alias("kind"), label.alias("label"), F.col("seq").alias("ref"))
    lists = rows.groupBy("session_id", "n").agg(F.array_sort(F.collect_list(item)).alias("items"))
    numbered = F.transform("items", lambda x, i: F.struct((i + 1).cast("int").alias("timeline_seq"), x["ts_mono_ns"].alias("ts_mono_ns"), x["kind"].alias("kind"), x["label"].alias("label"), x["ref"].alias("ref")))
    return lists.select("session_id", "n", numbered.alias("timeline"))


def evidence(decisions: DataFrame, log: DataFrame, forms_: DataFrame) -> DataFrame:
    """Redacted evidence records of all trips, with the fused timeline."""
    keys, legs = ["session_id", "n"], ("source", "untrusted", "sink")
    trips = decisions.where("verdict is not null")
    tripped = log.join(trips.select("session_id").distinct(), "session_id", "left_semi")
    # the call's text and the events that lit the legs, by one join with the log
    wanted = trips.select(*keys, F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).cast("long").alias("e_n")) for role, c in (("own", "n"), *((leg, f"{leg}_lit") for leg in legs))])).alias("x")).select(*keys, "x.*")
    lit = F.struct(F.lit(True).alias("lit"), F.when(F.col("kind") != "syscall", F.col("seq")).otherwise(F.lit(0)).alias("trigger_seq"), "detail", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("lit_at_ns"))
    events = tripped.select("session_id", F.col("n").alias("e_n"), lit.alias("lit"), "text")
    met = wanted.join(events, ["session_id", "e_n"]).groupBy(*keys).agg(F.max(F.when(F.col("role") == "own", F.col("text"))).alias("text"), *[F.max(F.when(F.col("role") == leg, F.col("lit"))).alias(f"_{leg}") for leg in legs])
    text = redact_rows(met, forms_, "text").withColumnRenamed("text", "_text")
    rows = trips.join(text, keys, "left").join(timeline(trips, tripped), keys, "left")
    dark = F.struct(F.lit(False).alias("lit"), F.lit(0).cast("long").alias("trigger_seq"), F.lit("").alias("detail"), F.lit(0).cast("long").alias("lit_at_ns"))
    of = lambda leg, name: F.coalesce(F.col(f"_{leg}"), dark).alias(name)
    syscall = F.col("kind") == "syscall"
    own = lambda c, kind, cond: (F.when(cond, F.col(c)) if c in rows.columns else F.lit(None)).cast(kind).alias(c)
    call = F.struct(own("tool_name", "string", ~syscall), own("server_id", "string", ~syscall), F.when(~syscall, F.col("_text")).alias("args"), own("seq", "long", ~syscall), own("syscall", "string", syscall), own("dest_ip", "string", syscall), own("dest_port", "int", syscall), own("pid", "int", syscall), own("comm", "string", syscall), own("path", "string", syscall), F.when(syscall, F.col("_text")).alias("payload_excerpt"))
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    last = F.struct((F.size(F.coalesce("timeline", F.array())) + 1).cast("int").alias("timeline_seq"), ns.alias("ts_mono_ns"), F.lit("syscall").alias("kind"), F.concat(F.lit("external_sink_invoked: "), F.concat_ws("", "syscall", F.lit(" to "), "dest_ip", F.lit(":"), F.col("dest_port").cast("string"), F.lit(" by "), "comm", F.lit(" (pid "), F.col("pid").cast("string"), F.lit(")"))).alias("label"), F.lit(None).cast("long").alias("ref")) if "dest_ip" in rows.columns else None
    line = F.col("timeline") if last is None else F.when(syscall, F.concat(F.coalesce("timeline", F.slice(F.array(last), 1, 0)), F.array(last))).otherwise(F.col("timeline"))
    hit = F.when(F.col("tainted_hash").isNotNull(), F.struct("tainted_hash", "preview", "where_found", "match_form"))
    pod = F.col("pod_context") if "pod_context" in rows.columns else F.lit(None)
    return rows.select("session_id", ns.alias("trip_ts_ns"), "verdict", "action", F.when(syscall, "ebpf_variant_b").otherwise("proxy_variant_a").alias("variant"), "confidence", F.struct(of("source", "sensitive_source_touched"), of("untrusted", "untrusted_content_present"), of("sink", "external_sink_invoked")).alias("legs"), call.alias("sink_call"), hit.alias("value_overlap"), line.alias("timeline"), pod.alias("pod_context"))
