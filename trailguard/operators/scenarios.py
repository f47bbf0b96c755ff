"""Scoring of detections over labelled scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("tp", "fn", "known_gap", "bonus", "tn", "fp_soft", "fp_exfil")


def trips(scenarios: DataFrame, decisions: DataFrame) -> DataFrame:
    """Flags and the ordered verdicts of each scenario (session_id = scenario_id)."""
    hit = decisions.where("verdict is not null").groupBy(F.col("session_id").alias("scenario_id")).agg(F.bool_or(F.col("verdict") == "EXFIL").alias("exfil"), F.lit(True).alias("tripped"), F.array_sort(F.collect_list(F.struct("n", "verdict"))).alias("v"))
    rows = scenarios.join(hit, "scenario_id", "left")
    return rows.withColumns({"exfil": F.coalesce("exfil", F.lit(False)), "tripped": F.coalesce("tripped", F.lit(False)), "verdicts": F.coalesce(F.col("v.verdict"), F.array().cast("array<string>"))}).drop("v")


def outcome():
    bad = F.col("category") == "malicious"
    return F.when(bad & F.col("known_gap"), F.when(F.col("exfil"), "bonus").otherwise("known_gap")).when(bad, F.when(F.col("exfil"), "tp").otherwise("fn")).when(F.col("exfil"), "fp_exfil").when(F.col("tripped"), "fp_soft").otherwise("tn")


def classify(scored: DataFrame) -> DataFrame:
    return scored.withColumn("outcome", outcome())


def _counts() -> list:
    return [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]


def confusion(classified: DataFrame) -> DataFrame:
    """Counts of outcomes and rates: known gaps are not in the detection rate; a rate over nothing is 0."""
    c = F.col
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    benign = c("tn") + c("fp_soft") + c("fp_exfil")
    return classified.agg(F.count(F.lit(1)).alias("scenarios"), *_counts()).withColumns({"detection_rate": share(c("tp"), c("tp") + c("fn")), "fp_rate_any": share(c("fp_soft") + c("fp_exfil"), benign), "fp_rate_exfil": share(c("fp_exfil"), benign)})


def by_plane(classified: DataFrame) -> DataFrame:
    return classified.groupBy("variant").agg(*_counts()).orderBy("variant")


def duplicate_ids(scenarios: DataFrame) -> DataFrame:
    return scenarios.groupBy("scenario_id").count().where("count > 1")


def report(classified: DataFrame) -> str:
    """Markdown of the (one row and few rows of) results."""
    total, planes = confusion(classified).first(), by_plane(classified).collect()
    pct = lambda x: f"{100 * x:.1f}%"
    lines = ["# Detection report", "", f"Scenarios: {total['scenarios']}", "", "| measure | value |", "|---|---|"]
    lines += [f"| detection rate | {pct(total['detection_rate'])} |", f"| false positives, any trip | {pct(total['fp_rate_any'])} |", f"| false positives, EXFIL | {pct(total['fp_rate_exfil'])} |"]
    lines += ["", "| plane | " + " | ".join(OUTCOMES) + " |", "|---" * (len(OUTCOMES) + 1) + "|"]
    lines += [f"| {p['variant']} | " + " | ".join(str(p[o]) for o in OUTCOMES) + " |" for p in planes]
    return "\n".join(lines) + "\n"
