"""Secrets that sessions have read: extraction, reassembly over a rolling buffer, and their union."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PATTERNS
from ..functions.text import as_bytes, encoded_forms, from_bytes, mask, secrets, sha256


def buffers(results: DataFrame, most_chunks: int = 16, most_bytes: int = 65536) -> DataFrame:
    """session_id, n, buffer: the session's latest results (session_id, n, text), at most `most_chunks` and `most_bytes`.
    A result's closing newlines go; one that is too long keeps its end; empty ones don't count."""
    chunk = as_bytes(F.regexp_replace("text", r"\n+$", ""))
    rows = results.select("session_id", "n", F.when(F.length(chunk) > most_bytes, F.right(chunk, F.lit(most_bytes))).otherwise(chunk).alias("chunk")).where(F.length("chunk") > 0)
    w = Window.partitionBy("session_id").orderBy("n").rowsBetween(-(most_chunks - 1), 0)
    rows = rows.withColumn("chunks", F.collect_list("chunk").over(w))
    # the longest run of latest chunks that fits: oldest ones go first, and never come back
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("full"))
    add = lambda a, c: F.when(a["full"] | (F.length(a["text"]) + F.length(c) > most_bytes), F.struct(a["text"].alias("text"), F.lit(True).alias("full"))).otherwise(F.struct(F.concat(c, a["text"]).alias("text"), F.lit(False).alias("full")))
    return rows.select("session_id", "n", from_bytes(F.aggregate(F.reverse("chunks"), start, add)["text"]).alias("buffer"))


def _found(rows: DataFrame, text: str, origin: int, patterns) -> DataFrame:
    return rows.select("session_id", "n", "source", F.lit(origin).alias("origin"), F.explode(secrets(text, patterns)).alias("s")).select("session_id", "n", "source", "origin", "s.*")


def taints(results: DataFrame, patterns=PATTERNS, most_chunks: int = 16, most_bytes: int = 65536, reassemble: bool = True, more: DataFrame | None = None) -> DataFrame:
    """Secrets of sessions, each once (by hash, at its first place), in the order of registration: session_id, n, source,
    value, hash, preview, taint_ord.

    results: session_id, n, source, text of sensitive results and files. more: secrets from elsewhere (session_id, n,
    source, value)."""
    rows = _found(results, "text", 0, patterns)
    if reassemble:
        joined = buffers(results, most_chunks, most_bytes).join(results.select("session_id", "n", "source"), ["session_id", "n"])
        rows = rows.union(_found(joined, "buffer", 1, patterns))
    if more is not None:
        rows = rows.union(more.select("session_id", "n", "source", F.lit(2), F.lit(0), F.lit(0), "value"))
    rows = rows.withColumn("hash", sha256("value"))
    # first place of each secret by a partial aggregate, then the order within the session
    first = rows.groupBy("session_id", "hash").agg(F.min(F.struct("n", "origin", "pattern", "pos", "source", "value")).alias("f")).select("session_id", "hash", "f.*")
    w = Window.partitionBy("session_id").orderBy("n", "origin", "pattern", "pos")
    return first.select("session_id", "n", "source", "value", "hash", mask("value").alias("preview"), F.row_number().over(w).alias("taint_ord"))


def forms(taint: DataFrame) -> DataFrame:
    """A row per secret and encoded form."""
    return taint.select("session_id", F.col("n").alias("taint_n"), "taint_ord", "hash", "preview", F.explode(encoded_forms("value")).alias("f")).select("session_id", "taint_n", "taint_ord", "hash", "preview", "f.*")
