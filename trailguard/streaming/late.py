"""Late rows: told from rows in time where events come in, kept in a side table, and decided again with their sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.detect import decide


def ingest_sink(path: str, lateness_s: float) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over raw events: rows in time go to path/log, late ones to path/late, by micro-batch. The
    watermark is Spark's own rule: the latest time of all batches before, less the lateness. It is kept in path/clock, a row
    a batch, so a batch that is run again splits as it did. A detecting stream reads path/log with no less lateness and
    loses nothing of it."""
    base = path.rstrip("/")

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            before = None
            if batch_id:
                clock = spark.read.schema("batch long, us long").parquet(f"{base}/clock")
                before = clock.where(F.col("batch") < batch_id).agg(F.max("us")).first()[0]
            us = F.unix_micros(F.col("ts").cast("timestamp"))
            late = F.coalesce(us <= F.lit(before - int(lateness_s * 1_000_000)), F.lit(False)) if before is not None else F.lit(False)
            batch.where(~late).write.mode("overwrite").parquet(f"{base}/log/batch={batch_id}")
            batch.where(late).write.mode("overwrite").parquet(f"{base}/late/batch={batch_id}")
            batch.agg(F.lit(batch_id).cast("long").alias("batch"), F.max(us).alias("us")).write.mode("overwrite").parquet(f"{base}/clock/run={batch_id}")
        finally:
            batch.unpersist()

    return sink


def late_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/late").drop("batch")


def redecide(log: DataFrame, late: DataFrame, decisions: DataFrame, settings: Settings, number: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Decisions after late rows came in. Only sessions that late rows touch are numbered and decided again, from all of
    their rows; decisions of other sessions are taken over. number: from raw rows to a prepared log (tags, n, prepare).
    Equal to deciding the whole log with its late rows."""
    touched = late.select("session_id").distinct()
    rows = log.join(touched, "session_id", "left_semi").unionByName(late)
    again = decide(number(rows), settings).select(*decisions.columns)
    return decisions.join(touched, "session_id", "left_anti").unionByName(again)
