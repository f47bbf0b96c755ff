"""The three-leg state machine, over events in order, and what depends on its epochs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEGS = ("source", "untrusted", "sink")


class Legs:
    """Legs of one session: each is dark or lit since an event. Both limits are checked before an event lights a leg."""

    __slots__ = ("calls", "lit", "since", "ttl")

    def __init__(self, ttl_us: int, calls: int, lit=(0, 0, 0), since=(0, 0, 0)) -> None:
        self.ttl, self.calls, self.lit, self.since = ttl_us, calls, list(lit), list(since)

    def step(self, n: int, us: int, lights: tuple[bool, bool, bool], again: bool = False) -> None:
        """Event n at us: legs decay, then the event lights what is dark (again: the sink leg even if it is lit)."""
        for i in range(3):
            at = self.lit[i]
            if at and ((self.calls > 0 and n - at >= self.calls) or (self.ttl > 0 and us - self.since[i] >= self.ttl)):
                at = self.lit[i] = 0
            if lights[i] and (not at or (again and i == 2)):
                self.lit[i], self.since[i] = n, us


class Piece:
    """One leg over a run of a session's events, in arrays: where it may light, and where each lighting leads.

    A leg that an event lit stays so until the first event `calls` numbers or `ttl` microseconds later; then the next
    lighting event, or any that lights it again meanwhile, lights it. So each lighting event has one next one, and the
    events that do light the leg are the ones met by following these from where the leg stood before the run."""

    def __init__(self, n: np.ndarray, us: np.ndarray, lights: np.ndarray, again: np.ndarray, ttl: int, calls: int) -> None:
        at = np.flatnonzero(lights)
        self.n, self.us, self.ttl, self.calls = n[at], us[at], ttl, calls
        self.again = np.flatnonzero(again[at])
        self.next = self.after(self.n, self.us)

    def after(self, n: np.ndarray, us: np.ndarray) -> np.ndarray:
        """The index of the lighting event that follows one at (n, us): len(self.n) if none does here."""
        out = np.full(len(n), len(self.n))
        if self.calls > 0:
            out = np.minimum(out, np.searchsorted(self.n, n + self.calls))
        if self.ttl > 0:
            out = np.minimum(out, np.maximum(np.searchsorted(self.us, us + self.ttl), np.searchsorted(self.n, n, side="right")))
        if len(self.again):
            k = np.searchsorted(self.n[self.again], n, side="right")
            out = np.minimum(out, np.append(self.again, len(self.n))[k])
        return out

    def ends(self) -> np.ndarray:
        """For each lighting event the last one that following it leads to, by doubling."""
        end = len(self.n)
        to = np.append(self.next, end)
        last = np.arange(end + 1)
        while (to[:end] < end).any():
            last = np.where(to < end, last[to], last)
            to = to[to]
        return last[:end]

    def chain(self, n: int, us: int) -> np.ndarray:
        """Indexes of the events that light the leg, if before the run it was lit by (n, us); n 0: dark."""
        i, out = int(self.after(np.array([n]), np.array([us]))[0]) if n else 0, []
        while i < len(self.n):
            out.append(i)
            i = int(self.next[i])
        return np.array(out, np.int64)

    def states(self, n: np.ndarray, us: np.ndarray, lit: int, since: int) -> tuple[np.ndarray, tuple[int, int]]:
        """What lit the leg as of each event (0: dark), and the last lighting of all."""
        chain = self.chain(lit, since)
        lit_n, lit_us = np.append(lit, self.n[chain]), np.append(since, self.us[chain])
        k = np.searchsorted(lit_n[1:], n, side="right")
        a, t = lit_n[k], lit_us[k]
        dark = (a == 0) | ((self.calls > 0) & (n - a >= self.calls)) | ((self.ttl > 0) & (us - t >= self.ttl))
        return np.where(dark, 0, a), (int(lit_n[-1]), int(lit_us[-1]))


_FLAGS = [f"lights_{leg}" for leg in LEGS]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """(session, piece) and the columns of its rows, from batches sorted by them: one piece at a time in memory. The session
    is an Arrow scalar, typed even if it is null."""
    key, name, held = None, None, []

    def whole():
        t = pa.Table.from_batches(held)
        return {c: t.column(c).to_numpy() for c in t.column_names if c not in ("session_id", "piece")}

    for b in batches:
        s, p = b.column("session_id"), b.column("piece").to_numpy()
        ids = s.to_pylist()
        cut = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1] or p[i] != p[i - 1]], len(ids)]
        for i, j in zip(cut, cut[1:], strict=False):
            if i == j:
                continue
            if (ids[i], p[i]) != key:
                if held:
                    yield name, whole()
                key, name, held = (ids[i], p[i]), (s[i], int(p[i])), []
            held.append(b.slice(i, j - i))
    if held:
        yield name, whole()


def leg_states(log: DataFrame, ttl_s: float = 1800, decay_after_calls: int = 32, piece: int = 1 << 16) -> DataFrame:
    """session_id, n and, for each leg, the event that lit it as of event n (0: dark).

    log: session_id, n (1, 2, ... in order), ts (not falling as n grows), lights_source, lights_untrusted, lights_sink,
    relight_sink. Only these narrow columns are shuffled. A session is cut into pieces of so many events, each a task's work
    on arrays. What lit a leg before a piece can hold in it only if it is one of the last `decay_after_calls` events, so a
    piece's effect is a small table from these (and dark) to what it leaves behind; the tables of a long session are applied
    one after the other, a few rows a piece, and every piece then begins with its true state. Without a limit of calls any
    earlier event may hold, and a session is one piece."""
    ttl, calls = int(ttl_s * 1_000_000), decay_after_calls
    us = F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    relight = flag("relight_sink") if "relight_sink" in log.columns else F.lit(False).alias("relight_sink")
    at = F.floor((F.col("n") - 1) / piece).cast("long") if calls > 0 else F.lit(0).cast("long")
    rows = log.select("session_id", F.col("n").cast("long").alias("n"), us, *[flag(c) for c in _FLAGS], relight, at.alias("piece"))
    kind = log.schema["session_id"].dataType.simpleString()

    def legs(c: dict) -> list[Piece]:
        return [Piece(c["n"], c["us"], c[f"lights_{leg}"] & (c["entry"] == 0), (c["relight_sink"] if leg == "sink" else np.zeros(len(c["n"]), bool)), ttl, calls) for leg in LEGS]

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (session, k), c in _pieces(batches):
            out = []
            for i, leg in enumerate(legs(c)):
                ends = leg.ends()
                before = np.flatnonzero((c["entry"] == 1) & c[f"lights_{LEGS[i]}"])
                from_n, from_us = np.append(0, c["n"][before]), np.append(0, c["us"][before])
                first = np.append(0, leg.after(from_n[1:], from_us[1:]))
                some = first < len(ends)
                to_n, to_us = from_n.copy(), from_us.copy()
                to_n[some], to_us[some] = leg.n[ends[first[some]]], leg.us[ends[first[some]]]
                out += [(k, i, *map(int, x)) for x in zip(from_n, to_n, to_us, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.repeat(session, len(out)), *[pa.array(x) for x in zip(*out, strict=True)]], ["session_id", "piece", "leg", "from_n", "to_n", "to_us"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state at the beginning of each piece but the first, from the tables of the pieces before it, in order."""
        names = ["session_id", "piece", *[f"{what}{i}" for i in range(3) for what in ("lit", "since")]]
        session, state = None, []
        for (s, k), c in _pieces(batches):
            if session is None or not s.equals(session):
                session, state = s, [(0, 0)] * 3
            for i in range(3):
                own = c["leg"] == i
                hit = np.flatnonzero(own & (c["from_n"] == state[i][0]))
                # what is none of the last events before the piece is dark there
                j = hit[0] if len(hit) else np.flatnonzero(own & (c["from_n"] == 0))[0]
                if len(hit) or c["to_n"][j]:
                    state[i] = int(c["to_n"][j]), int(c["to_us"][j])
            flat = [x for pair in state for x in pair]
            yield pa.RecordBatch.from_arrays([pa.repeat(s, 1), *[pa.array([x]) for x in (k + 1, *flat)]], names)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (session, _), c in _pieces(batches):
            real = c["entry"] == 0
            start = np.flatnonzero(~real)
            own = {k: v[real] for k, v in c.items()}
            lit = [leg.states(own["n"], own["us"], *((int(c[f"lit{i}"][start[0]]), int(c[f"since{i}"][start[0]])) if len(start) else (0, 0)))[0] for i, leg in enumerate(legs(own))]
            n = len(own["n"])
            if n:
                yield pa.RecordBatch.from_arrays([pa.repeat(session, n), pa.array(own["n"]), *[pa.array(x, pa.int64()) for x in lit]], ["session_id", "n", *[f"{leg}_lit" for leg in LEGS]])

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(*by).sortWithinPartitions("session_id", "piece", *(["n"] if "n" in df.columns else []))

    here = rows.withColumn("entry", F.lit(0))
    long = rows.where("piece > 0").select(F.col("session_id").alias("_long")).distinct()
    ahead = here.where(F.col("n") > (F.col("piece") + 1) * piece - calls).withColumns({"piece": F.col("piece") + 1, "entry": F.lit(1)})
    table = dealt(here.unionByName(ahead).join(long, F.col("session_id").eqNullSafe(F.col("_long")), "left_semi"), "session_id", "piece").mapInArrow(tables, f"session_id {kind}, piece long, leg long, from_n long, to_n long, to_us long")
    carried = "".join(f", lit{i} long, since{i} long" for i in range(3))
    starts = dealt(table, "session_id").mapInArrow(begin, f"session_id {kind}, piece long{carried}").withColumns({"entry": F.lit(1), "n": F.lit(0).cast("long"), "us": F.lit(0).cast("long")} | {c: F.lit(False) for c in (*_FLAGS, "relight_sink")})
    zeros = {f"{what}{i}": F.lit(0).cast("long") for i in range(3) for what in ("lit", "since")}
    both = here.withColumns(zeros).unionByName(starts) if calls > 0 else here.withColumns(zeros)
    return dealt(both, "session_id", "piece").mapInArrow(replay, f"session_id {kind}, n long, source_lit long, untrusted_lit long, sink_lit long")


def excerpts(results: DataFrame, states: DataFrame, most: int = 8, most_bytes: int = 4096) -> DataFrame:
    """Texts of untrusted results (session_id, n, text), trimmed and cut, with the epoch of the untrusted leg in which
    they hold and the event from which on later ones have replaced them (until, null: none)."""
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    cut = F.substring(F.encode(trimmed, "UTF-8"), 1, most_bytes)
    rows = results.select("session_id", "n", F.decode(cut, "ISO-8859-1").alias("excerpt")).where(F.length("excerpt") > 0)
    rows = rows.join(states.select("session_id", "n", F.col("untrusted_lit").alias("epoch")), ["session_id", "n"])
    w = Window.partitionBy("session_id", "epoch").orderBy("n")
    return rows.withColumn("until", F.lead("n", most).over(w))
