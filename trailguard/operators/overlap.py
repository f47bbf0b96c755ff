"""Secrets in later outbound calls of the same session: whole, reassembled from JSON, and behind layers of encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DEPTH, LEAST_BYTES, MOST_BYTES, SINGLE, as_bytes, decode_layers, inflated, json_leaves, plausible
from ..functions.winnow import winnowed
from ..tables import cut

#: Characters by which forms and sinks are joined; extracted secrets have more.
ANCHOR = 12
ORDER = ("stage", "pos", "path", "taint_ord", "form_ord")


def _matches(sinks: DataFrame, forms: DataFrame, plan: str) -> DataFrame:
    """Sinks (session_id, n, pos, path, text) with every form that they contain, of secrets registered before."""
    earlier = F.col("taint_n") < F.col("n")
    if plan == "contains":  # few forms per session: the session's forms are tried one by one
        return sinks.join(forms, "session_id").where(earlier & F.contains("text", "form_value"))
    # an equi-join on the gram that a form's first characters keep when winnowed: a text that holds the form keeps it too
    keys, own = ["session_id", "n", "pos", "path"], ["session_id", "taint_n", "taint_ord", "form_ord"]
    long, short = F.length("form_value") >= ANCHOR, F.length("form_value") < ANCHOR
    anchored = winnowed(forms.where(long).withColumn("data", F.encode(F.substring("form_value", 1, ANCHOR), "UTF-8").substr(1, ANCHOR)), own, "data", ANCHOR)
    sessions = forms.select("session_id").distinct()
    runs = winnowed(sinks.join(sessions, "session_id", "left_semi").withColumn("data", F.encode("text", "UTF-8")), keys, "data", ANCHOR)
    # texts are joined to the few pairs that are left, not carried along with every gram
    pairs = runs.join(anchored, ["session_id", "g"]).where(earlier).drop("g", "taint_n").distinct()
    known = forms.where(long)
    found = pairs.join(known, ["session_id", "taint_ord", "form_ord"]).join(sinks, keys).where(F.contains("text", "form_value"))
    other = sinks.join(forms.where(short), "session_id").where(earlier & F.contains("text", "form_value"))
    return found.select(other.columns).unionByName(other)


def _first(matches: DataFrame) -> DataFrame:
    best = F.min(F.struct(*ORDER, "hash", "preview", "match_form")).alias("b")
    return matches.groupBy("session_id", "n").agg(best).select("session_id", "n", "b.stage", F.col("b.hash").alias("tainted_hash"), "b.preview", "b.match_form", "b.taint_ord")


def raw_hits(sinks: DataFrame, forms: DataFrame, plan: str = "anchor") -> DataFrame:
    """First form found in each sink's text (session_id, n, text): secrets in the order of registration, then forms."""
    rows = sinks.select("session_id", "n", "text", F.lit(0).alias("pos"), F.lit("").alias("path"))
    return _first(_matches(rows, forms, plan).withColumns({"stage": F.lit(1), "match_form": F.col("form")}))


def reassembled(sinks: DataFrame) -> DataFrame:
    """All string leaves of a JSON text, end to end, where that is other than the text itself."""
    joined = F.array_join(json_leaves("text"), "")
    return sinks.withColumn("_joined", joined).where((F.col("_joined") != "") & (F.col("_joined") != F.col("text"))).select("session_id", "n", F.col("_joined").alias("text"))


def with_reassembled(rows: DataFrame, text: str, name: str) -> DataFrame:
    """The same as a column; null for payloads, and where it is the text itself or empty."""
    rows = rows.withColumn("_joined", F.array_join(json_leaves(text), ""))
    other = (F.col("_joined") != "") & (F.col("_joined") != F.col(text)) & ~F.col("payload")
    return rows.withColumn(name, F.when(other, F.col("_joined"))).drop("_joined")


def reassembled_hits(sinks: DataFrame, forms: DataFrame, plan: str = "anchor") -> DataFrame:
    rows = reassembled(sinks).withColumns({"pos": F.lit(0), "path": F.lit("")})
    return _first(_matches(rows, forms, plan).withColumns({"stage": F.lit(2), "match_form": F.col("form")}))


def _candidates(leaves: str, text: str) -> Column:
    whole = F.array(text)
    return F.when(F.col("payload"), F.concat(whole, F.col(leaves))).when(F.size(leaves) > 0, F.col(leaves)).otherwise(whole)


def candidates(sinks: DataFrame) -> DataFrame:
    """What decoding is tried on: string leaves; for a payload the whole before them; the whole if there are none."""
    rows = sinks.withColumn("_leaves", json_leaves("text"))
    return rows.select("session_id", "n", F.posexplode(_candidates("_leaves", "text")).alias("pos", "c")).where(F.octet_length("c").between(LEAST_BYTES, MOST_BYTES)).withColumn("c", as_bytes("c"))


def layers(cands: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Every text that up to `depth` strict base64 or hex layers of a candidate hold: path is their steps' initials, in
    whose order they are tried."""
    level = cands.select("session_id", "n", "pos", F.lit("").alias("path"), F.lit("decoded").alias("match_form"), "c")
    out = None
    for _ in range(depth):
        step = level.withColumn("d", F.explode(decode_layers("c")))
        level = step.select("session_id", "n", "pos", F.concat("path", F.substring("d.step", 1, 1)).alias("path"), F.concat_ws("_", "match_form", "d.step").alias("match_form"), F.col("d.decoded").alias("c"))
        out = level if out is None else out.unionByName(level)
        level = level.where(plausible("c"))
    return out


def with_layers(rows: DataFrame, text: str, name: str, depth: int = DEPTH) -> DataFrame:
    """candidates and layers as one column: an array of (pos, path, match_form, c), for rows that can't be exploded."""
    rows = rows.withColumn("_leaves", json_leaves(text))
    at = F.transform(_candidates("_leaves", text), lambda c, i: F.struct(i.alias("pos"), F.lit("").alias("path"), F.lit("decoded").alias("match_form"), as_bytes(c).alias("c")))
    rows = rows.withColumn("_level", F.when(F.col(text).isNotNull(), F.filter(at, lambda x: F.length(x["c"]).between(LEAST_BYTES, MOST_BYTES)))).withColumn(name, F.slice("_level", 1, 0))

    def deeper(x: Column) -> Column:
        return F.transform(decode_layers(x["c"]), lambda d: F.struct(x["pos"].alias("pos"), F.concat(x["path"], F.substring(d["step"], 1, 1)).alias("path"), F.concat_ws("_", x["match_form"], d["step"]).alias("match_form"), d["decoded"].alias("c")))

    for _ in range(depth):
        rows = rows.withColumn("_step", F.flatten(F.transform("_level", deeper)))
        rows = rows.withColumns({name: F.concat(name, "_step"), "_level": F.filter("_step", lambda x: plausible(x["c"]))})
    return rows.drop("_leaves", "_level", "_step")


def decoded_hits(sinks: DataFrame, forms: DataFrame, plan: str = "anchor") -> DataFrame:
    """First secret behind layers of encoding; only plain and single-layer forms are looked for there."""
    rows = layers(candidates(sinks)).withColumnRenamed("c", "text")
    single = forms.where(F.col("form").isin(*SINGLE)).withColumn("form_value", as_bytes("form_value"))
    return _first(_matches(rows, single, plan).withColumn("stage", F.lit(3)))


def gzip_hits(sinks: DataFrame, forms: DataFrame, plan: str = "anchor") -> DataFrame:
    """Secrets in gzip members in base64."""
    rows = sinks.select("session_id", "n", F.posexplode(inflated("text")).alias("pos", "text")).withColumn("path", F.lit(""))
    plain = forms.where("form = 'literal'").withColumns({"form_value": as_bytes("form_value"), "form_ord": F.lit(9), "form": F.lit("gzip_base64")})
    return _first(_matches(rows, plain, plan).withColumns({"stage": F.lit(1), "match_form": F.col("form")}))


def overlaps(sinks: DataFrame, forms: DataFrame, decode: bool = True, plan: str = "anchor") -> DataFrame:
    """The first hit of each sink (session_id, n, text, payload: whether it is a captured payload): raw text, then joined
    leaves (arguments only), then decoded. Each stage takes what the ones before missed."""
    keys = ["session_id", "n"]
    hits = _earliest(raw_hits(sinks, forms, plan).unionByName(gzip_hits(sinks, forms)))
    if decode:
        # each stage's hits and what it leaves are used twice: cut off, so that no stage runs again for the next
        hits = cut(hits)
        left = sinks.join(hits, keys, "left_anti")
        joined = cut(reassembled_hits(left.where("not payload"), forms, plan))
        hits = hits.unionByName(joined).unionByName(cut(decoded_hits(left.join(joined, keys, "left_anti"), forms)))
    found = F.when(F.col("payload"), "egress payload").otherwise("sink args")
    return hits.join(sinks.select(*keys, "payload"), keys).withColumn("where_found", found).drop("payload")


def _earliest(hits: DataFrame) -> DataFrame:
    """Of a raw and a gzip hit the one of the secret registered first."""
    row = F.struct("taint_ord", F.when(F.col("match_form") == "gzip_base64", 1).otherwise(0).alias("late"), "stage", "tainted_hash", "preview", "match_form")
    return hits.groupBy("session_id", "n").agg(F.min(row).alias("b")).select("session_id", "n", "b.stage", "b.tainted_hash", "b.preview", "b.match_form", "b.taint_ord")
