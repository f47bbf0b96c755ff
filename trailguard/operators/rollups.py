"""Forensic rollups as increments: mergeable sketches of each window are stored once and re-aggregated upward, so a month
costs its days' rows, not its evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of a distinct-count sketch's registers (relative error 1.04 / sqrt(2^12), some 1.6 %), and KLL's k (rank error 0.7 %).
DISTINCT_BITS, QUANTILE_K = 12, 400
GROUPS = ("verdict", "destination")


def _when() -> Column:
    return F.timestamp_micros(F.floor(F.col("trip_ts_ns") / 1000).cast("long"))


def sketch_trips(evidence: DataFrame, window: str = "1 day") -> DataFrame:
    """A row per window, verdict and destination: trips, sessions (a sketch of distinct ones), times_to_trip (a sketch of
    microseconds from the session's first reading of a secret to its trip)."""
    to = F.coalesce("sink_call.dest_ip", "sink_call.tool_name")
    waited = F.when(F.col("legs.sensitive_source_touched.lit"), F.floor((F.col("trip_ts_ns") - F.col("legs.sensitive_source_touched.lit_at_ns")) / 1000).cast("long"))
    rows = evidence.select(F.window(_when(), window)["start"].alias("window_start"), "verdict", to.alias("destination"), F.col("session_id").cast("string").alias("session_id"), waited.alias("waited"))
    return rows.groupBy("window_start", *GROUPS).agg(F.count(F.lit(1)).alias("trips"), F.hll_sketch_agg("session_id", DISTINCT_BITS).alias("sessions"), F.kll_sketch_agg_bigint("waited", QUANTILE_K).alias("times_to_trip"))


def merge_trips(stored: DataFrame, unit: str = "month", by: tuple[str, ...] = GROUPS) -> DataFrame:
    """Stored rows of one or more runs re-aggregated to a larger unit and fewer groups; it may be merged again."""
    rows = stored.withColumn("window_start", F.date_trunc(unit, "window_start"))
    return rows.groupBy("window_start", *by).agg(F.sum("trips").alias("trips"), F.hll_union_agg("sessions").alias("sessions"), F.kll_merge_agg_bigint("times_to_trip").alias("times_to_trip"))


def read_trips(stored: DataFrame, share: float = 0.5) -> DataFrame:
    """The sketches as numbers: distinct sessions, and the time to trip that a share of the trips had at most."""
    some = F.kll_sketch_get_n_bigint("times_to_trip") > 0
    quantile = F.when(some, F.kll_sketch_get_quantile_bigint("times_to_trip", F.lit(share)))
    return stored.withColumns({"sessions": F.hll_sketch_estimate("sessions"), "time_to_trip": quantile}).drop("times_to_trip")


def roll_day(evidence: DataFrame, path: str, window: str = "1 day") -> None:
    """Write the windows that this evidence touches over what they held before: the evidence has all of their records."""
    rows = sketch_trips(evidence, window).withColumn("day", F.to_date("window_start"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
