"""The detection pipeline as a stream: raw events of both planes to decisions, with per-session state.

Every stage of the batch runs: what needs no state (texts, JSON leaves, decoded layers, gzip members, secrets of single
results) is made by the batch's own column functions before the stateful step; that step orders and numbers a session's
events (`Ordered`), folds its legs (`Legs`), reassembles sensitive results over a rolling buffer, and keeps secrets, an index
of their forms by first characters, and excerpts of untrusted text. State is bounded by the limits of the settings except for
secrets, which stay as long as the session does; all of it goes after the idle timeout."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import time
from collections.abc import Callable
from urllib.parse import quote_plus

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..config import Settings
from ..functions.text import FORMS, SINGLE, inflated, secrets
from ..operators.detect import prepare
from ..operators.enrich import resolve_tags
from ..operators.legs import Legs
from ..operators.overlap import ANCHOR, with_layers, with_reassembled
from .ordered import Ordered, packed, use_rocksdb

#: What a stream of events must have: the columns of detect.prepare() and these.
INPUT = ("session_id", "ts", "ingest_seq", "plane", "kind", "syscall", "text", "source", "payload", "lights_source", "lights_untrusted", "lights_sink", "relight_sink", "can_trip")
DECISION = "session_id string, n bigint, ingest_seq bigint, us bigint, verdict string, match_form string, where_found string, tainted_hash string, preview string, source_lit bigint, untrusted_lit bigint, sink_lit bigint"
SECRET = "session_id string, n bigint, source string, value string, hash string, preview string"
COUNTERS = "name string, at double, value long"
EXCERPTS, EXCERPT_BYTES = 8, 4096
_SPACE = " \t\n\x0b\f\r"


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


# what the batch makes by built-in functions, for the secrets of reassembled buffers


def _b64(v: str) -> str:
    return base64.b64encode(v.encode()).decode()


def _hex(v: str) -> str:
    return v.encode().hex()


def _url(v: str) -> str:
    return quote_plus(v, safe="*-._").replace("~", "%7E")


#: By the names, and in the order, of functions.text.FORMS.
_FORMS = {
    "literal": str, "base64": _b64, "hex": _hex, "url_encoded": _url, "reversed": lambda v: v[::-1],
    "base64_hex": lambda v: _b64(_hex(v)), "hex_base64": lambda v: _hex(_b64(v)), "base64_url": lambda v: _b64(_url(v)), "base64_reversed": lambda v: _b64(v[::-1]),
}
_ORD = {name: i for i, name in enumerate(FORMS)} | {"gzip_base64": 9}


def _mask(v: str) -> str:
    return "****" if len(v) <= 4 else f"{v[:2]}...{v[-2:]}" if len(v) <= 10 else f"{v[:3]}...{v[-4:]}"


def _byte_chars(text: str) -> str:
    """One character per byte, as functions.text.as_bytes makes."""
    return text.encode(errors="replace").decode("latin-1")


def _shares(excerpt: str, text: str, least: int) -> bool:
    short, long = sorted((excerpt, text), key=len)
    return any(short[i : i + least] in long for i in range(len(short) - least + 1))


class Secrets(Ordered):
    """Registers a session's secrets, each once: those of single results and files, then those of the rolling buffer. As it
    stands it makes the stream of newly registered secrets, which a forwarder sends to other sensors."""

    columns = _names(SECRET)

    def __init__(self, settings: Settings) -> None:
        self.settings, self.idle_ms = settings, int(settings.idle_timeout_s * 1000)

    def open(self, handle):
        self.known = handle.getMapState("known", "hash string", "ord long")
        self.chunks = handle.getListState("chunks", "chunk string")
        self.patterns = [(re.compile(p, re.ASCII), group) for _, p, group in self.settings.patterns]
        return [self.known, self.chunks]

    def begin(self):
        self.buffer = None

    def reassembled(self, text: str) -> str:
        """The rolling buffer after one more result."""
        if self.buffer is None:
            self.buffer = [c for (c,) in self.chunks.get()] if self.chunks.exists() else []
        most = self.settings.fragment_max_bytes
        chunk = _byte_chars(text.rstrip("\n"))[-most:]
        if not chunk:
            return ""
        self.buffer = [*self.buffer, chunk][-self.settings.fragment_max_chunks :]
        while sum(map(len, self.buffer)) > most:
            self.buffer.pop(0)
        return "".join(self.buffer).encode("latin-1").decode(errors="replace")

    def register(self, n: int, e: dict) -> list[tuple[int, str, str, str]]:
        """Order, value, hash and preview of the secrets that this event adds."""
        if not e.get("lights_source") or e.get("text") is None:
            return []
        values = [f["value"] for f in e.get("found") or ()]
        if e["plane"] != "sensor":
            buffer = self.reassembled(e["text"])
            values += [m[group] for p, group in self.patterns for m in p.finditer(buffer)]
        new = []
        for i, value in enumerate(dict.fromkeys(values)):
            digest = hashlib.sha256(value.encode()).hexdigest()
            if not self.known.containsKey((digest,)):
                at = n * 1_000_000 + i
                self.known.updateValue((digest,), (at,))
                new.append((at, value, digest, _mask(value)))
        return new

    def step(self, key, n, us, event, text):
        return [(key[0], n, event.get("source"), value, digest, preview) for _, value, digest, preview in self.register(n, event)]

    def end(self):
        if self.buffer is not None:
            self.chunks.put([(c,) for c in self.buffer])


class Detector(Secrets):
    """A decision for each event that could trip."""

    columns = _names(DECISION)

    def open(self, handle):
        self.legs_state = handle.getValueState("legs", ", ".join(f"{what}{i} long" for what in ("lit", "since") for i in range(3)))
        self.anchors = handle.getMapState("anchors", "anchor string", "forms string")
        self.excerpts_state = handle.getListState("excerpts", "excerpt string")
        return [*super().open(handle), self.legs_state, self.anchors, self.excerpts_state]

    def begin(self):
        super().begin()
        s, old = self.settings, self.legs_state.get() if self.legs_state.exists() else (0,) * 6
        self.legs = Legs(int(s.leg_ttl_s * 1_000_000), s.decay_after_calls, old[:3], old[3:])
        self.excerpts = [x for (x,) in self.excerpts_state.get()] if self.excerpts_state.exists() else []
        self.index, self.added = None, {}

    def index_of(self, anchor: str) -> list:
        got = self.anchors.getValue((anchor,)) if self.anchors.containsKey((anchor,)) else None
        return json.loads(got[0]) if got else []

    def learn(self, n: int, event: dict) -> None:
        for at, value, digest, preview in self.register(n, event):
            for name, make in _FORMS.items():
                form = _byte_chars(make(value))
                if form:
                    self.added.setdefault(form[:ANCHOR] if len(form) >= ANCHOR else "", []).append([n, at, _ORD[name], name, form, digest, preview])

    def flush(self) -> None:
        """Write new forms to the index, below their first characters; forms shorter than these are below ''."""
        for anchor, forms in self.added.items():
            self.anchors.updateValue((anchor,), (json.dumps(self.index_of(anchor) + forms),))
            if self.index is not None:
                self.index.setdefault(anchor, []).extend(forms)
        self.added = {}

    def found_in(self, text: str, n: int) -> list[list]:
        """Forms that the text (a character per byte) has, of secrets registered before event n."""
        self.flush()
        if self.index is None:
            self.index = {anchor: json.loads(forms) for (anchor,), (forms,) in self.anchors.iterator()}
        hits = [f for f in self.index.get("", ()) if f[0] < n and f[4] in text]
        for i in range(len(text) - ANCHOR + 1 if self.index else 0):
            for f in self.index.get(text[i : i + ANCHOR], ()):
                if f[0] < n and text.startswith(f[4], i):
                    hits.append(f)
        return hits

    def overlap(self, n: int, e: dict) -> tuple | None:
        """The first hit: match form, hash, preview. Raw text and gzip members, then joined leaves, then decoded layers."""
        if e.get("syscall") == "openat" or not e.get("text"):
            return None
        raw = min((f[1:] for f in self.found_in(_byte_chars(e["text"]), n)), default=None)
        members = [(pos, f[1], "gzip_base64", f[5], f[6]) for pos, text in enumerate(e.get("inflated") or ()) for f in self.found_in(text, n) if f[3] == "literal"]
        packed_ = min(members, default=None)
        if packed_ and (raw is None or packed_[1] < raw[0]):
            return packed_[2:]
        if raw is None and e.get("joined"):
            raw = min((f[1:] for f in self.found_in(_byte_chars(e["joined"]), n)), default=None)
        if raw is not None:
            return raw[2], raw[4], raw[5]
        layers = [(d["pos"], d["path"], f[1], f[2], d["match_form"], f[5], f[6]) for d in e.get("decoded") or () for f in self.found_in(d["c"], n) if f[3] in SINGLE]
        return min(layers)[4:] if layers else None

    def step(self, key, n, us, event, text):
        was = self.legs.lit[1]
        lights = tuple(bool(event.get(f"lights_{leg}")) for leg in ("source", "untrusted", "sink"))
        self.legs.step(n, us, lights, bool(event.get("relight_sink")))
        if was and self.legs.lit[1] != was:  # the leg went dark, or dark and lit again: what held under it is gone
            self.excerpts = []
        said = event.get("text") or ""
        if lights[1] and (excerpt := _byte_chars(said.strip(_SPACE))[:EXCERPT_BYTES]):
            self.excerpts = [*self.excerpts, excerpt][-EXCERPTS:]
        self.learn(n, event)
        if not event.get("can_trip"):
            return []
        hit, raw = self.overlap(n, event), _byte_chars(said)
        bound = not hit and all(self.legs.lit) and any(_shares(x, raw, self.settings.content_bind_min_len) for x in self.excerpts)
        form, digest, preview = hit or (None, None, None)
        where = ("egress payload" if event.get("payload") else "sink args") if hit else None
        return [(key[0], n, event["ingest_seq"], us, "EXFIL" if hit else "SUSPICIOUS" if bound else None, form, where, digest, preview, *self.legs.lit)]

    def end(self):
        super().end()
        self.flush()
        self.legs_state.update((*self.legs.lit, *self.legs.since))
        if self.excerpts:
            self.excerpts_state.put([(x,) for x in self.excerpts])
        else:
            self.excerpts_state.clear()


def with_candidates(events: DataFrame, settings: Settings) -> DataFrame:
    """The columns that the stateful step compares: found (secrets of a source's text), inflated, joined, decoded."""
    compared = F.col("can_trip") & (F.coalesce("syscall", F.lit("")) != "openat") & (F.coalesce("text", F.lit("")) != "")
    found = F.when(F.col("lights_source"), secrets("text", settings.patterns))
    rows = events.withColumns({"found": found, "_text": F.when(compared, F.col("text"))})
    rows = rows.withColumn("inflated", F.when(F.contains("_text", F.lit("H4sI")), inflated("_text")))
    return with_layers(with_reassembled(rows, "_text", "joined"), "_text", "decoded").drop("_text")


def _ordered(events: DataFrame, settings: Settings, lateness: str, compare: bool) -> DataFrame:
    use_rocksdb(events.sparkSession)
    rows = events.select(*INPUT)
    rows = with_candidates(rows, settings) if compare else rows.withColumn("found", F.when(F.col("lights_source"), secrets("text", settings.patterns)))
    # repeated deliveries are dropped before anything is computed twice
    once = packed(rows, ["session_id"], *[F.col(c) for c in rows.columns if c not in ("session_id", "ts")])
    once = once.withColumn("plane", F.get_json_object("event", "$.plane")).withWatermark("ts", lateness)
    return once.dropDuplicatesWithinWatermark(["session_id", "plane", "seq"]).drop("plane")


def detect_stream(events: DataFrame, settings: Settings, lateness: str = "10 minutes") -> DataFrame:
    """Decisions of a stream of prepared events (INPUT). Events may come in any order within the lateness; a decision comes
    when the watermark has passed its event."""
    rows = _ordered(events, settings, lateness, compare=True)
    out = rows.groupBy("session_id").transformWithStateInPandas(Detector(settings), DECISION, "append", "EventTime")
    return out.withColumn("ts", F.timestamp_micros("us")).drop("us")


def secrets_stream(events: DataFrame, settings: Settings, lateness: str = "10 minutes") -> DataFrame:
    """Secrets (SECRET) of a stream of prepared events as they are registered, for writers.forward_taint. They are raw: no
    sink but the sensors' may have them."""
    rows = _ordered(events, settings, lateness, compare=False)
    return rows.groupBy("session_id").transformWithStateInPandas(Secrets(settings), SECRET, "append", "EventTime")


def detect_raw_stream(tools: DataFrame, syscalls: DataFrame, tool_tags: DataFrame, server_tags: DataFrame, settings: Settings, lateness: str = "10 minutes") -> DataFrame:
    """Decisions of two raw streams: tool events and attributed system calls, tagged, fused and numbered on the way."""
    log = resolve_tags(tools.unionByName(syscalls, allowMissingColumns=True), tool_tags, server_tags)
    return detect_stream(prepare(log, settings), settings, lateness)


def session_ends(events: DataFrame, idle: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """One row per session and run of activity once it has been idle for long enough."""
    w = F.session_window("ts", idle)
    return events.withWatermark("ts", lateness).groupBy("session_id", w).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_activity"))


def trip_counts(decisions: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Trips by tumbling window and verdict."""
    rows = decisions.where("verdict is not null").withWatermark("ts", lateness)
    return rows.groupBy(F.window("ts", window), "verdict").agg(F.count(F.lit(1)).alias("trips"))


class Dimensions:
    """Tag tables that are read anew at the start of each micro-batch; a version that can't be read, or has a row without
    name or tags, leaves the last good one in place."""

    def __init__(self, spark: SparkSession, path: str, key: str = "tool_name") -> None:
        self.spark, self.path, self.key, self.good, self.errors = spark, path, key, None, []

    def current(self) -> DataFrame:
        try:
            table = self.spark.read.schema(f"{self.key} string, tags array<string>").json(self.path)
            if not table.where(f"{self.key} is null or tags is null").isEmpty():
                raise ValueError(f"a row without {self.key} or tags")
            self.good = table
        except Exception as e:  # noqa: BLE001  whatever is wrong with a new version, detection goes on with the old one
            self.errors.append(re.sub(r"\s+", " ", str(e))[:200])
            if self.good is None:
                raise
        return self.good


def tag_sink(tools: Dimensions, servers: Dimensions, path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over raw events: tags each micro-batch by the dimensions as they are then, for a detecting stream
    that reads path. A batch that is run again overwrites what it wrote."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        tagged = resolve_tags(batch, tools.current().select("tool_name", "tags"), servers.current().select("server_id", "tags"))
        tagged.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return sink


class Drops(StreamingQueryListener):
    """Rows that streams dropped because they were late, rows that they read, and what they observe (DataFrame.observe), as
    counters that only grow (name, ts, value), of which metrics.counter_increments tells the increments. A run of a query
    counts from zero. If nobody calls counters() for long, the samples but the latest of each counter go: these count all."""

    MOST = 10_000

    def __init__(self) -> None:
        self.totals: dict[tuple[str, str], int] = {}
        self.samples: list[tuple[str, float, int]] = []

    def _count(self, run: str, name: str, what: str, n: int) -> None:
        key = (run, what)
        self.totals[key] = self.totals.get(key, 0) + n
        self.samples.append((f"{name}/{what}", time.time(), self.totals[key]))
        if len(self.samples) > self.MOST:
            self.samples = list({s[0]: s for s in self.samples}.values())

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        run, name = str(p.runId), p.name or str(p.id)
        self._count(run, name, "late", sum(max(0, o.numRowsDroppedByWatermark) for o in p.stateOperators))
        self._count(run, name, "read", max(0, p.numInputRows))
        for observation, row in (p.observedMetrics or {}).items():
            for metric, value in row.asDict().items():
                if isinstance(value, int):
                    self._count(run, name, f"{observation}/{metric}", value)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        for key in [k for k in self.totals if k[0] == str(event.runId)]:
            self.totals.pop(key)

    def counters(self, spark: SparkSession) -> DataFrame:
        """The samples since the last call, one row per counter and batch; the caller appends them to its table."""
        taken, self.samples = self.samples, []
        return spark.createDataFrame(taken, COUNTERS).select("name", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"), "value")
