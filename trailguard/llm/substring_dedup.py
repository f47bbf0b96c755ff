"""Removal of long repeated runs of words, exact, by recompression.

Every text is parsed in rounds: runs of one word get a name, then pairs of neighbouring symbols do, a pair being made
where a bit of the left name is 1 and the same round's bit of the right name is 0. A name is a 64-bit hash of what it
stands for, so names are the same in every task without a shuffle, and equal substrings get the same symbols, except near
their ends. Names only bring equal passages together: what goes is decided by 128 bits of BLAKE2b over the words
themselves, so texts whose names collide lose nothing. How far from the ends is known: with each symbol goes the span of words that decide it. A symbol whose span
lies within a window of `window` words therefore recurs wherever the window does.

Of each window's symbols of the highest level that has any, the one with the least hash is its anchor; consecutive windows
mostly share it and form a segment. (A window in which no symbol lies, as inside a run of one word, is its own anchor.)
Equal windows have equal anchors at equal places. So, in Spark:

1. anchors that occur once are dropped (a count by name, then a join);
2. where all segments of an anchor are alike, all but the first go, whole;
3. else of alike segments all but the first go, and the windows of those firsts are compared by hash, read from the texts.

Hot anchors are only aggregated with map-side sums and joined to one row per anchor, never gathered.

Null texts have no words; windows don't cross documents; a text of fewer words than a window keeps all; rows with one
doc_id are told apart by their text's hash, and of equal windows at one place of rows with one doc_id none is earlier; a
null doc_id counts as the smallest; texts are read in blocks, so one may be as long as a column can hold; further columns
of any name are kept apart in a struct; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NOT_SPACE, Joined, Runs, Words, blocks, key, mix, save, settled, signed, table, unkey

WINDOW, ROUNDS = 20, 3


class Symbols:
    """The symbols of one level of a block of texts. start, end: the words it stands for; low, high: those that decide it."""

    def __init__(self, name, start, end, low, high, text) -> None:
        self.name, self.start, self.end, self.low, self.high, self.text = name, start, end, low, high, text

    def take(self, at) -> Symbols:
        return Symbols(*(x[at] for x in (self.name, self.start, self.end, self.low, self.high, self.text)))


def name_runs(words: np.ndarray, text: np.ndarray) -> Symbols:
    """Level 0: maximal runs of one word, named by word and length. The words beside a run decide where it ends."""
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    return Symbols(mix(words[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), start, end, start - 1, end + 1, text[start])


def name_pairs(s: Symbols, turn: int) -> Symbols:
    """The next level: pairs of a left symbol and a right symbol get a name, other symbols stay. A left symbol that stays
    is decided by the next one too, a right one by the one before; at an end of the text by what is not there."""
    n = len(s.name)
    left = mix(s.name + np.uint64((turn + 1) * 0x9FB21C651E98DF25 % 2**64)) >> np.uint64(63) == 1
    first = np.zeros(n, bool)
    first[:-1] = left[:-1] & ~left[1:] & (s.text[1:] == s.text[:-1])
    second = np.zeros(n, bool)
    second[1:] = first[:-1]
    same = np.zeros(n + 1, bool)
    same[1:n] = s.text[1:] == s.text[:-1]
    before = np.where(same[:-1], np.append(s.low[:1], s.low[:-1]), s.low - 1)
    after = np.where(same[1:], np.append(s.high[1:], s.high[-1:]), s.high + 1)
    low = np.where(left, s.low, np.minimum(s.low, before))
    high = np.where(left, np.maximum(s.high, after), s.high)
    name, end = s.name.copy(), s.end.copy()
    a = np.flatnonzero(first)
    name[a] = mix(s.name[a] * np.uint64(0x9E3779B97F4A7C15) ^ mix(s.name[a + 1] + np.uint64(turn)))
    end[a] = s.end[a + 1]
    low[a], high[a] = s.low[a], s.high[a + 1]
    return Symbols(name, s.start, end, low, high, s.text).take(~second)


def anchors(low: np.ndarray, high: np.ndarray, rank: np.ndarray, start: np.ndarray, window: int, words: int) -> np.ndarray:
    """For each window (by its first word) the symbol of least rank, the leftmost of equals, whose span lies within it; -1
    for none. low and high ascend."""
    first = np.bincount(np.clip(low, -1, words) + 1, minlength=words + window + 2)
    last = np.bincount(np.clip(high, 0, words + window), minlength=len(first))
    begin = np.cumsum(first)[start]  # symbols with low < start
    stop = np.cumsum(last)[start + window]  # symbols with high <= start + window
    count = stop - begin
    best = np.full(len(start), -1)
    level = np.arange(len(low))
    width = 1
    while width <= count.max(initial=0):
        two = np.flatnonzero((count >= width) & (count < 2 * width))
        a, b = level[begin[two]], level[stop[two] - width]
        best[two] = np.where(rank[b] < rank[a], b, a)
        if len(level) > width:
            level = np.where(rank[level[width:]] < rank[level[:-width]], level[width:], level[:-width])
        width *= 2
    return best


def segments(words: Words, window: int, rounds: int, digests: bool = True) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: text, first word (in the text), number of windows, name of the anchor and, with
    digests, s1 and s2, a digest of all their words. Equal words make equal runs, their anchor at one place."""
    per_text = np.diff(words.first)
    text = np.repeat(np.arange(len(per_text)), per_text)
    windows = np.flatnonzero(np.repeat(per_text, per_text) - (np.arange(len(text)) - np.repeat(words.first[:-1], per_text)) >= window)
    if not len(windows):
        return {k: np.zeros(0, np.int64) for k in ("text", "start", "n", "anchor", "s1", "s2")}
    levels = [name_runs(words.hash, text)]
    for turn in range(rounds):
        levels.append(name_pairs(levels[-1], turn))
    n = len(words.hash)
    low, high, which = windows.copy(), windows + window, np.full(len(windows), -1)
    open_ = np.arange(len(windows))
    for k in range(rounds, -1, -1):
        s = levels[k]
        if not len(open_):
            break
        found = anchors(s.low, s.high, mix(s.name ^ np.uint64(0x5851F42D4C957F2D)), windows[open_], window, n)
        got = found >= 0
        at, a = open_[got], found[got]
        low[at], high[at], which[at] = s.low[a], s.high[a], k
        open_ = open_[~got]
    new = np.ones(len(windows), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (which[1:] != which[:-1]) | (windows[1:] != windows[:-1] + 1)
    head = np.flatnonzero(new)
    count = np.diff(np.append(head, len(windows)))
    start = windows[head]
    anchor = mix(Runs(words.hash).hash(low[head], high[head]) + (which[head] + 2).astype(np.uint64))
    found = {"text": text[start], "start": start - words.first[text[start]], "n": count, "anchor": signed(anchor)}
    if digests:
        found["s1"], found["s2"] = Joined(words).digests(start, start + count + window - 1).T
    return found


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(key().alias("d"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "text", *more)


ANCHORS = "anchor long, s1 long, s2 long, d long, h long, start int, n int"


def find_anchors(keyed: DataFrame, window: int, rounds: int) -> DataFrame:
    """The anchor of each segment: what tells which segments may recur."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(segments(Words(block.column(0), NOT_SPACE, False), window, rounds, digests=False)["anchor"])], ["anchor"])

    return keyed.select("text").mapInArrow(rows, "anchor long")


def find_segments(keyed: DataFrame, window: int, rounds: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            s = segments(Words(block.column(2), NOT_SPACE, False), window, rounds)
            d, h = (block.column(i).to_numpy()[s["text"]] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s["anchor"], s["s1"], s["s2"], d, h, s["start"].astype(np.int32), s["n"].astype(np.int32))], [x.split()[0] for x in ANCHORS.split(", ")])

    return keyed.mapInArrow(rows, ANCHORS)


def packed(keyed: DataFrame) -> DataFrame:
    """The texts compressed for the shuffle, with what else stands beside them."""
    schema = T.StructType([T.StructField("packed", T.BinaryType()) if f.name == "text" else f for f in keyed.schema.fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [squeeze(x.as_py().encode()) if x.is_valid else None for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.binary()), *batch.columns[3:]], schema.names)

    return keyed.mapInArrow(rows, schema)


def lists(spans: DataFrame) -> DataFrame:
    """The spans of a text as lists: of distinct spans, never more than it has words."""
    return spans.groupBy("d", "h").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("ns"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (d, h, packed, ...) with the text (null: empty) in the place of what it was packed to, in bounded
    blocks."""
    grow = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            text = pa.array([grow(x.as_py()) if x.is_valid else b"" for x in part.column(2)], pa.binary()).cast(pa.string())
            names = [*part.schema.names[:2], "text", *part.schema.names[3:]]
            yield from blocks(iter([pa.RecordBatch.from_arrays([*part.columns[:2], text, *part.columns[3:]], names)]))


def _expand(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the block, start and n of every span."""
    starts, ns = block.column("starts"), block.column("ns")
    rows = np.repeat(np.arange(block.num_rows), [len(x) if x.is_valid else 0 for x in starts])
    starts, ns = (np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy() for x in c if x.is_valid)]).astype(np.int64) for c in (starts, ns))
    return rows, starts, ns


def find_windows(keyed: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The digest of each window of the spans, with its place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _texts(batches):
            words = Words(block.column(2), NOT_SPACE, False)
            row, start, n = _expand(block)
            at = np.repeat(words.first[row] + start - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(row, n)
            place = at - words.first[row]
            yield pa.RecordBatch.from_arrays([*map(pa.array, Joined(words).digests(at, at + window).T)] + [pa.array(block.column(i).to_numpy()[row]) for i in (0, 1)] + [pa.array(place.astype(np.int32))], ["w1", "w2", "d", "h", "start"])

    return packed(keyed).join(lists(spans), ["d", "h"]).mapInArrow(rows, "w1 long, w2 long, d long, h long, start int")


def repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """Spans (d, h, start, n): the n windows from word `start` on occur earlier too."""
    keyed = _keyed(docs)
    segment = ["s1", "s2"]
    # tables of their own, so that the sides of the joins with hot anchors and windows are plain shuffles, which split
    again = save(find_anchors(keyed, window, rounds).groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("anchor"), "again")
    shared = save(find_segments(keyed, window, rounds).join(again, "anchor"), "shared")
    place = F.struct("d", "start")
    alike = F.struct(*segment)
    by_anchor = save(shared.groupBy("anchor").agg(F.min(alike).alias("least"), F.max(alike).alias("most")).where("least != most").select("anchor"), "mixed")
    firsts = save(shared.groupBy(*segment).agg(F.min(place).alias("first"), F.min("anchor").alias("anchor"), F.count(F.lit(1)).alias("times")), "firsts")
    later = shared.join(firsts.where("times > 1").select(*segment, "first"), segment).where(F.struct("d", "start") > F.col("first")).select("d", "h", "start", "n")
    mixed = firsts.join(by_anchor, "anchor").select(*segment, F.col("first.d").alias("fd"), F.col("first.start").alias("fs"))
    # of rows with one doc_id and one text all are read: which is first doesn't matter
    unsure = shared.join(mixed, segment).where("d = fd and start = fs").select("d", "h", "start", "n")
    # rows that repeat a doc_id may repeat its text too, and with it every span
    repeated = not docs.groupBy(key()).count().where("count > 1").isEmpty()
    once = (lambda spans: spans.distinct()) if repeated else (lambda spans: spans)
    windows = save(find_windows(keyed, save(once(unsure), "unsure"), window), "windows")
    earliest = save(windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("w1", "w2", "first"), "earliest")
    single = windows.join(earliest, ["w1", "w2"]).where(F.struct("d", "start") > F.col("first")).select("d", "h", "start", F.lit(1).alias("n"))
    return once(later.union(single))


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, keep_rows: bool = True) -> DataFrame:
    """d, h, n_words, n_removed, kept_sha256 (of the words kept, joined by one space) of every row; with keep_rows also
    row: all columns of docs, the text of rows that lost words replaced by the words kept."""
    others = [c for c in docs.columns if c != "text"]
    keyed = _keyed(docs, *[F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest")] * keep_rows)
    schema = T.StructType.fromDDL("d long, h long, n_words long, n_removed long, kept_sha256 string, kept string")
    if keep_rows:
        schema = T.StructType([*schema.fields, keyed.schema["rest"]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _texts(batches):
            words = Words(block.column(2), NOT_SPACE, False)
            row, start, n = _expand(block)
            edge = np.zeros(len(words.hash) + 1, np.int64)
            np.add.at(edge, words.first[row] + start, 1)
            np.add.at(edge, words.first[row] + start + n + window - 1, -1)
            keep = np.cumsum(edge)[:-1] == 0
            out = []
            for i, text in enumerate(block.column(2)):
                a, b = words.first[i], words.first[i + 1]
                kept = text.as_py().encode().split()
                gone = b - a - int(keep[a:b].sum())
                if gone:
                    kept = [w for w, k in zip(kept, keep[a:b].tolist(), strict=True) if k]
                kept = b" ".join(kept)
                out.append((b - a, gone, hashlib.sha256(kept).hexdigest(), kept.decode() if gone and keep_rows else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
            if keep_rows:  # texts that lost nothing stay as they are
                columns[3] = pc.coalesce(columns[3], block.column(2))
                columns.append(block.column("rest"))
            yield pa.RecordBatch.from_arrays([*block.columns[:2], *columns], schema.names)

    spans = save(repeats(docs, window, rounds), "repeats")
    found = packed(keyed).join(lists(spans), ["d", "h"], "left").mapInArrow(rows, schema)
    if not keep_rows:
        return found.drop("kept")
    columns = [F.col("kept").alias("text") if c == "text" else F.col(f"rest.`{c}`") for c in docs.columns]
    return found.withColumn("row", F.struct(*columns)).drop("kept", "rest")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled("kept", lambda: remove_repeats(table(spark, sf_dir, "documents"), keep_rows=False))
    return found.select(unkey("d").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
l AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, j FROM l, unnest(range(i, i + 20)) AS t(j)),
a AS (SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(j)),
k AS (SELECT a.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY a.j) AS kept FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.j = g.j WHERE g.j IS NULL GROUP BY a.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
