"""Content binding: sinks that repeat a run of bytes of untrusted text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.winnow import common, gram_size, winnowed


def content_bound(sinks: DataFrame, excerpts: DataFrame, least: int = 16) -> DataFrame:
    """session_id, n of sinks (session_id, n, epoch, text) that share `least` bytes in a row with an excerpt valid then.

    Both sides are winnowed and joined on (session, epoch, gram); the bytes beside a gram tell whether the run that both
    share is long enough. Sinks of sessions and epochs without excerpts are dropped before."""
    beside = least - gram_size(least)
    e = excerpts.select("session_id", "epoch", F.col("n").alias("e_n"), "until", F.encode("excerpt", "ISO-8859-1").alias("data"))
    s = sinks.where(F.col("epoch") > 0).join(excerpts.select("session_id", "epoch").distinct(), ["session_id", "epoch"], "left_semi")
    s = s.select("session_id", "epoch", "n", F.encode("text", "UTF-8").alias("data"))
    e = winnowed(e, ["session_id", "epoch", "e_n", "until"], "data", least, beside).withColumnsRenamed({"before": "e_before", "after": "e_after"})
    s = winnowed(s, ["session_id", "epoch", "n"], "data", least, beside)
    valid = (F.col("e_n") < F.col("n")) & (F.col("until").isNull() | (F.col("n") <= F.col("until")))
    pairs = s.join(e, ["session_id", "epoch", "g"]).where(valid)
    if beside:
        shared = common(F.col("before"), F.col("e_before"), beside, ends=True) + common(F.col("after"), F.col("e_after"), beside, ends=False)
        pairs = pairs.where(shared >= beside)
    return pairs.select("session_id", "n").distinct()
