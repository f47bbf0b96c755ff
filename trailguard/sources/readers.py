"""Scans of event logs, frames, system calls and taint feeds. Rejected rows go to a quarantine frame with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..functions.render import pod_session
from ..functions.text import encoded_forms, mask, sha256

FRAME_BYTES, FEED_BYTES = 1 << 20, 64 << 10


def _lines(spark: SparkSession, path: str, streaming: bool) -> DataFrame:
    lines = (spark.readStream if streaming else spark.read).text(path)
    return lines.select(F.regexp_replace("value", "\r$", "").alias("line")).where(F.trim("line") != "")


def _malformed(line: str) -> Column:
    """Why a line isn't a JSON object; null if it is one."""
    v = F.try_parse_json(line)
    return F.when(v.isNull(), "not JSON").when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not a JSON object")


def _rejected(lines: DataFrame) -> DataFrame:
    return lines.where("reason is not null").select(F.substring("line", 1, 256).alias("head"), "reason")


def split_log(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, audit records and rejects (head, reason) of log lines (line). Rejected are lines that are no JSON object, or
    in which a field has a value of another type than the schema's, or that have no field of an event or audit record."""
    schema = f"{schemas.EVENT_OR_AUDIT}, _corrupt string"
    rows = lines.withColumn("e", F.from_json("line", schema, {"columnNameOfCorruptRecord": "_corrupt", "maxStringLen": str(2**31 - 1)}))
    names = [f.name for f in T.StructType.fromDDL(schemas.EVENT_OR_AUDIT).fields]
    none = F.coalesce(*[F.when(F.col(f"e.{c}").isNotNull(), 1) for c in names]).isNull()
    reason = F.coalesce(_malformed("line"), F.when(F.col("e._corrupt").isNotNull(), "a field has another type"), F.when(none, "no field of an event"))
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select(*[F.col(f"e.{c}") for c in names])
    return good.where("kind is null").drop("kind", "reason", "syscall"), good.where("kind is not null").select("kind", "reason", "ts_wall", "syscall"), _rejected(rows)


def event_log(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, audit records and rejected lines of a JSON-lines log. tool_args and result stay JSON text. The log is written
    after redaction: it serves forensics and metrics, not detection."""
    return split_log(_lines(spark, path, streaming))


def split_frames(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (line, any others) that hold a frame, and rejects: oversized lines, and what is no JSON object."""
    rows = lines.withColumn("reason", F.when(F.octet_length("line") > FRAME_BYTES, "frame exceeds 1 MiB").otherwise(_malformed("line")))
    return rows.where("reason is null").drop("reason"), _rejected(rows)


def frames(spark: SparkSession, path: str, streaming: bool = False) -> tuple[DataFrame, DataFrame]:
    """Lines that hold a frame, without a closing CR, and rejects; blank lines are skipped."""
    return split_frames(_lines(spark, path, streaming))


def quarantine(rejects: DataFrame, path: str) -> None:
    """Append rejects to a table beside what was read. Heads of lines may hold secrets: its readers are those of raw input."""
    rejects.write.mode("append").parquet(path)


def frame_class(method: Column, rpc_id: Column) -> Column:
    """request: method and id; notification: method alone; response: no method."""
    return F.when(method.isNull() | (method == ""), "response").when(rpc_id.isNull(), "notification").otherwise("request")


def project_frames(lines: DataFrame) -> DataFrame:
    """Events from frame lines with session_id, direction, server_id, ts_wall and ingest_pos beside them: class, method,
    tool name, arguments, result, and a sequence per session."""
    at = lambda p: F.get_json_object("line", p)
    rows = lines.select("*", at("$.method").alias("jsonrpc_method"), at("$.id").alias("rpc_id"), at("$.result").alias("result"))
    call = F.col("jsonrpc_method") == "tools/call"
    rows = rows.withColumns({"frame_class": frame_class(F.col("jsonrpc_method"), F.col("rpc_id")), "tool_name": F.when(call, at("$.params.name")), "tool_args": F.when(call, at("$.params.arguments"))})
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("session_id").orderBy("ts_wall", "ingest_pos")).cast("long"))


def syscalls(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.SYSCALL).format(fmt).load(path)


def taint_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Registrations of secrets by other sensors, and those that don't qualify."""
    return split_feed(spark.read.text(path))


def split_feed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = lines.where(F.trim("value") != "").select("value", F.from_json("value", schemas.FEED).alias("m"))
    empty = lambda c: F.coalesce(F.col(f"m.{c}"), F.lit("")) == ""
    reason = (
        F.when(F.col("m").isNull() | F.col("m.op").isNull(), "not a message")
        .when(F.col("m.op") != "register_taint", "unknown op")
        .when(F.trim(F.coalesce("m.pod_uid", F.lit(""))) == "", "no pod uid")
        .when(empty("value"), "no value")
        .when(empty("hash"), "no hash")
        .when(F.octet_length("m.value") > FEED_BYTES, "value exceeds 64 KiB")
    )
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").select("m.*"), rows.where("reason is not null").select("reason", F.octet_length("value").alias("bytes"))


def feed_taint(feed: DataFrame) -> DataFrame:
    """Taint rows of a feed for the sessions of their pods: missing variants, hash and preview are made up for."""
    given = F.filter("variants", lambda v: v["value"] != "")
    forms = F.when(F.size(given) > 0, F.transform(given, lambda v, i: F.struct(i.cast("int").alias("form_ord"), v["form"].alias("form"), v["value"].alias("form_value")))).otherwise(encoded_forms("value"))
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), other)
    return feed.select(pod_session(F.trim("pod_uid")).alias("session_id"), "source", "seq", "value", blank("hash", sha256("value")).alias("hash"), blank("preview", mask("value")).alias("preview"), forms.alias("forms"))
