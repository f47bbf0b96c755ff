"""Sinks: evidence, its latest record, audit, findings, an outbox of deliveries, and their streaming twins. No sink takes
a column that may hold a secret."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import render
from ..functions.text import encoded_forms
from ..operators.metrics import retain

Sink = Callable[[DataFrame, int], None]


def _checked(df: DataFrame) -> DataFrame:
    if bad := schemas.NEVER_WRITTEN & set(df.columns):
        raise ValueError(f"columns that are never written: {', '.join(sorted(bad))}")
    return df


def append_evidence(evidence: DataFrame, path: str, fmt: str = "json") -> None:
    """Partitioned by the day of the trip, so retention and time ranges read few files."""
    day = F.to_date(render.ns_to_timestamp("trip_ts_ns"))
    _checked(evidence).withColumn("trip_date", day).write.mode("append").partitionBy("trip_date").format(fmt).save(path)


def compact_evidence(spark: SparkSession, path: str, most: int, fmt: str = "json", tenant: str | None = None) -> str:
    """The store of append_evidence with its latest `most` records, of each tenant if named (all for 0), in a new folder
    beside path; returns it. Nothing of the old one is touched, so a job that fails leaves it whole, and who reads it goes
    on; the caller points readers and appends to the new one and removes the old."""
    rows = spark.read.schema(f"{schemas.EVIDENCE}, trip_date date").format(fmt).load(path)
    kept = retain(rows.withColumn("id", F.col("session_id")), most, tenant).drop("id")
    return replace(kept, path, fmt, "trip_date")


def drop_old_days(spark: SparkSession, path: str, most: int, fmt: str = "json") -> list[str]:
    """Delete the days of the store of append_evidence before the one that holds its `most`-th latest record (0: none);
    returns them. No day that stays is rewritten, so records that are appended meanwhile are not lost, and one that comes
    late for a deleted day is older than all that retention keeps. Exactly `most` are had by metrics.retain when reading."""
    if most <= 0:
        return []
    counts = spark.read.schema(f"{schemas.EVIDENCE}, trip_date date").format(fmt).load(path).groupBy("trip_date").count().where("trip_date is not null")
    old, held = [], 0
    for r in counts.orderBy(F.desc("trip_date")).collect():  # a row a day
        if held >= most:
            old.append(str(r["trip_date"]))
        held += r["count"]
    context = spark.sparkContext
    for day in old:
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/trip_date={day}")
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
    return old


def evidence_sink(path: str, fmt: str = "json") -> Sink:
    """For foreachBatch: a batch that is run again overwrites what it wrote."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        _checked(batch).write.mode("overwrite").format(fmt).save(f"{path.rstrip('/')}/batch={batch_id}")

    return sink


def latest(evidence: DataFrame) -> DataFrame:
    """The record with the latest trip."""
    row = F.struct(*[F.col(f"`{c}`") for c in evidence.columns])
    return evidence.agg(F.max_by(row, F.struct("trip_ts_ns", "session_id")).alias("r")).where("r is not null").select("r.*")


def min_verdict(verdict: str, least: str) -> Column:
    return (F.col(verdict) == "EXFIL") if least.strip().upper() == "EXFIL" else F.col(verdict).isin("EXFIL", "SUSPICIOUS")


def outbox(evidence: DataFrame, targets: Iterable[tuple[str, str, Column]], least: str = "SUSPICIOUS") -> DataFrame:
    """Rows to deliver, (kind, target, payload column) for each target and each record of at least that verdict."""
    rows = [F.struct(F.lit(kind).alias("kind"), F.lit(target).alias("target"), payload.alias("payload")) for kind, target, payload in targets]
    wanted = evidence.where(min_verdict("verdict", least))
    return wanted.select(render.finding_uid().alias("id"), F.explode(F.array(*rows)).alias("r")).select("id", "r.*", F.lit("pending").alias("status"))


def deliver(pending: DataFrame, send: Callable[[str, str, str], int]) -> DataFrame:
    """status of each delivery: ok for a 2xx answer of send(kind, target, payload), error for another or an exception,
    skipped without a target. send is called on the executors and must take a repeated id."""

    def rows(batches):
        for pdf in batches:
            status = []
            for kind, target, payload in zip(pdf["kind"], pdf["target"], pdf["payload"], strict=True):
                try:
                    status.append("skipped" if not target else "ok" if 200 <= send(kind, target, payload) < 300 else "error")
                except Exception:  # noqa: BLE001  whatever a sender raises is an outcome to record
                    status.append("error")
            yield pdf[["id", "kind", "target"]].assign(status=status)

    return pending.mapInPandas(rows, "id string, kind string, target string, status string")


def findings_sink(path: str, least: str = "SUSPICIOUS") -> Sink:
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.where(min_verdict("verdict", least)).select(render.ocsf_finding().alias("value")).write.mode("overwrite").text(f"{path.rstrip('/')}/batch={batch_id}")

    return sink


def fan_out(sinks: Iterable[Sink]) -> Sink:
    """One sink of many: the batch is computed once."""
    sinks = list(sinks)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for s in sinks:
                s(batch, batch_id)
        finally:
            batch.unpersist()

    return sink


def append_audit(audit: DataFrame, path: str) -> None:
    _checked(audit).write.mode("append").json(path)


def forward_taint(taint: DataFrame, send: Callable[[str, str], int]) -> DataFrame:
    """session_id, hash, status (as of deliver) of secrets (taint.taints) told to the sensor of their session's pod:
    send(pod uid, message) gets a message that readers.split_feed takes. Only sessions of pods have a sensor. Values leave
    in messages alone; what is returned, and may be written, has their hashes."""
    variants = F.transform(encoded_forms("value"), lambda f: F.struct(f["form"].alias("form"), f["form_value"].alias("value")))
    pod = F.substring("session_id", len("k8s:") + 1, 1 << 30)
    message = F.struct(F.lit("register_taint").alias("op"), pod.alias("pod_uid"), "source", F.col("n").alias("seq"), "hash", "preview", "value", variants.alias("variants"))
    told = taint.where(F.col("session_id").startswith("k8s:")).select(F.to_json(F.struct("session_id", "hash")).alias("id"), F.lit("taint").alias("kind"), pod.alias("target"), F.to_json(message).alias("payload"))
    done = deliver(told, lambda kind, target, payload: send(target, payload))
    return done.select(F.from_json("id", "session_id string, hash string").alias("k"), "status").select("k.*", "status")


def taint_sink(send: Callable[[str, str], int], path: str) -> Sink:
    """For foreachBatch over a stream of secrets: forwards them and keeps each batch's outcome."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        forward_taint(batch, send).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return sink


def replace(df: DataFrame, path: str, fmt: str = "parquet", *by: str) -> str:
    """df in a new folder beside path; returns it. The caller points readers to it when it is whole."""
    to = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).format(fmt).save(to)
    return to
