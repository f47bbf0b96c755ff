"""Benchmark passages in documents, by Wu-Manber search over words.

Patterns are the runs of `window` words of every benchmark item (an item of fewer words is one pattern). Patterns of one
length m form a searcher: a shift table over hashed pairs of words says how far the end of the window may move on without
missing a pattern, pairs that end a pattern have shift 0; there a bucket of patterns with that suffix is looked up and
each is compared with the text, word by word. All stretches of a block of texts are searched side by side, each moving on
by its own shifts, so a shift of m-1 words skips that many positions.

Spark makes the patterns and deals them to parts of at most some `most`. A part's searchers are arrays (hashes, bytes,
tables), built once on the driver and broadcast; each part is a pass over the documents whose hits are saved before the
next part is built, so one part is in memory at a time and the benchmark, or one item of it, may be of any size.

Null texts and items have no words; a null doc_id is kept; rows with one doc_id are told apart by their text's hash (equal
rows have equal results); items with one item_id count once; with no items nothing is hit; texts of any length are
searched whole; further columns, of any name, travel in a struct; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Joined, Words, as_row, blocks, mix, save, table, with_row

WINDOW = 10
#: Patterns in a broadcast: some 200 bytes each.
MOST = 500_000
#: Slots of the shift table, and words that a lane searches.
SLOTS, LANE = 1 << 20, 128


class Searcher:
    """Patterns (words joined by one space) of m words each, in arrays. ids: the items that each is from."""

    def __init__(self, m: int, patterns: list[bytes], ids: list[list[str]]) -> None:
        self.m, self.block = m, min(2, m)
        self.names, codes = np.unique(np.array([i for own in ids for i in own], object).astype(str), return_inverse=True)
        self.items = codes.astype(np.int32)
        self.own = np.append(0, np.cumsum([len(x) for x in ids]))
        self.bytes = b"".join(patterns)
        self.at = np.append(0, np.cumsum([len(p) for p in patterns]))
        words = Words(pa.array([p.decode() for p in patterns], pa.string()), ALNUM, False)
        self.hashes = words.hash.reshape(len(patterns), m)
        per = m - self.block + 1
        pairs = self.pairs_of(self.hashes) if self.block == 2 else self.hashes
        self.shift = np.full(SLOTS, per, np.int16)
        slots = (pairs % np.uint64(SLOTS)).astype(np.int64)
        for k in range(per):  # the block at k ends m - block - k words before the pattern does
            np.minimum.at(self.shift, slots[:, k], m - self.block - k)
        self.bucket = np.argsort(pairs[:, -1], kind="stable")
        self.suffixes = pairs[self.bucket, -1]

    def pairs_of(self, hashes: np.ndarray) -> np.ndarray:
        return mix(hashes[:, :-1] * np.uint64(31) + hashes[:, 1:])

    def pairs(self, h: np.ndarray) -> np.ndarray:
        """The hash of the block of words that ends at each word; the first word's block is only itself."""
        if self.block == 1:
            return h
        out = np.zeros(len(h), np.uint64)
        out[1:] = mix(h[:-1] * np.uint64(31) + h[1:])
        return out

    def search(self, words: Words) -> Iterator[tuple[int, int, int]]:
        """(text, first word, pattern) of every occurrence in a block of texts."""
        h, m = words.hash, self.m
        pair = self.pairs(h)
        ends, tops, texts = [], [], []
        for t in np.flatnonzero(np.diff(words.first) >= m):
            a, b = words.first[t], words.first[t + 1]
            lanes = np.arange(a + m - 1, b, LANE)
            ends.append(lanes)
            tops.append(np.minimum(lanes + LANE, b))
            texts.append(np.full(len(lanes), t))
        if not ends:
            return
        at, top, text = (np.concatenate(x) for x in (ends, tops, texts))
        found_at, found_text = [], []
        while len(at):
            step = self.shift[(pair[at] % np.uint64(SLOTS)).astype(np.int64)]
            hit = step == 0
            found_at.append(at[hit])
            found_text.append(text[hit])
            at = at + np.maximum(step, 1)
            on = at < top
            at, top, text = at[on], top[on], text[on]
        end, text = np.concatenate(found_at), np.concatenate(found_text)
        low, high = (np.searchsorted(self.suffixes, pair[end], side) for side in ("left", "right"))
        for k in np.flatnonzero(low < high).tolist():
            first = int(end[k]) - m + 1
            for i in self.bucket[low[k] : high[k]].tolist():
                if np.array_equal(h[first : first + m], self.hashes[i]) and b" ".join([words.text(first + j) for j in range(m)]) == self.bytes[self.at[i] : self.at[i + 1]]:
                    yield int(text[k]), first, i

    def items_of(self, i: int) -> list[str]:
        return self.names[self.items[self.own[i] : self.own[i + 1]]].tolist()


PATTERNS = "m int, k string, item_id string"


def patterns_of(benchmark: DataFrame, window: int) -> DataFrame:
    """m, k (the words joined by one space) and items of every distinct pattern."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column(1), ALNUM, True)
            n = np.diff(words.first)
            count = np.where(n, np.maximum(n - window + 1, 1), 0)
            text = np.repeat(np.arange(len(n)), count)
            start = np.repeat(words.first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            m = np.minimum(n, window)[text]
            joined = Joined(words)
            edges = zip(joined.start[start].tolist(), (joined.end[start + m - 1] - 1).tolist(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(m.astype(np.int32)), pa.array([joined.bytes[a:b] for a, b in edges], pa.binary()).cast(pa.string()), block.column(0).take(pa.array(text))], ["m", "k", "item_id"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null and item_id is not null")
    return items.mapInArrow(rows, PATTERNS).groupBy("m", "k").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def _parts(benchmark: DataFrame, window: int, most: int) -> Iterator[list[Searcher]]:
    """Searchers for about `most` patterns at a time."""
    patterns = save(patterns_of(benchmark, window), "patterns")
    parts = max(1, -(-patterns.count() // most))
    for k in range(parts):
        rows = patterns.where(F.pmod(F.xxhash64("k"), F.lit(parts)) == k) if parts > 1 else patterns
        by: dict[int, list] = defaultdict(list)
        for r in rows.collect():  # about `most`
            by[r["m"]].append((r["k"].encode(), r["items"]))
        yield [Searcher(m, [p for p, _ in sorted(v)], [i for _, i in sorted(v)]) for m, v in sorted(by.items())]


def _scan(docs: DataFrame, shared) -> DataFrame:
    """row, n_words, hits and items of all docs for one part of the patterns, its searchers in a broadcast."""
    schema = with_row(docs, "n_words long", "hits array<struct<first:int,m:int>>", "items array<string>")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("first", pa.int32()), ("m", pa.int32())])), pa.list_(pa.string())
        for batch in batches:
            all_rows = batch.column(0)
            done = 0
            for block in blocks(iter([pa.RecordBatch.from_arrays([all_rows.field("text")], ["text"])])):
                words = Words(block.column(0), ALNUM, True)
                spans, items = defaultdict(set), defaultdict(set)
                for s in shared.value:
                    for t, first, i in s.search(words):
                        spans[t].add((int(first - words.first[t]), s.m))
                        items[t].update(s.items_of(i))
                n = block.num_rows
                hits = [[{"first": a, "m": m} for a, m in sorted(spans.get(t, ()))] for t in range(n)]
                found = [sorted(items.get(t, ())) for t in range(n)]
                yield pa.RecordBatch.from_arrays([all_rows.slice(done, n), pa.array(np.diff(words.first)), pa.array(hits, kinds[0]), pa.array(found, kinds[1])], schema.names)
                done += n

    return docs.select(as_row(docs)).mapInArrow(rows, schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = MOST) -> DataFrame:
    """row (all columns of docs, doc_id and text among them), n_words, hits (spans of first word and number of words) and
    items."""
    context = docs.sparkSession.sparkContext
    parts = _parts(benchmark, window, most)
    found = _scan(docs, context.broadcast(next(parts)))
    ids = [F.col("row.doc_id").alias("d"), F.xxhash64("row.text").alias("h")]
    more = None
    for part in parts:
        shared = context.broadcast(part)
        hits = save(_scan(docs, shared).where(F.size("hits") > 0).select(*ids, "hits", "items"), "hits")
        shared.destroy()
        more = hits if more is None else more.union(hits)
    if more is None:
        return found
    more = more.groupBy("d", "h").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits_"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items_"))
    joined = found.withColumns({"d_": ids[0], "h_": ids[1]}).join(more, F.col("d_").eqNullSafe(F.col("d")) & (F.col("h_") == F.col("h")), "left")
    both = lambda a: F.when(F.col(f"{a}_").isNull(), F.col(a)).otherwise(F.array_union(a, f"{a}_")).alias(a)
    return joined.select("row", "n_words", both("hits"), both("items"))


def hit_words(hits: str = "hits"):
    """How many words lie in any of the spans: sorted by their first word, each adds what goes beyond those before."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["first"] + x["m"] - F.greatest(a["to"], x["first"]))).alias("n"), F.greatest(a["to"], x["first"] + x["m"]).alias("to"))
    return F.aggregate(F.array_sort(hits), start, step, lambda a: a["n"].cast("long"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort("items")
    return found.select("row.doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
m AS (SELECT DISTINCT m FROM p),
x AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM d, m, unnest(range(1, len(w) - m + 2)) AS t(i)),
h AS (SELECT x.doc_id, x.i, x.m, p.item_id FROM x JOIN p ON x.m = p.m AND x.k = p.k),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + m)) AS t(j) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s.items, '')) AS items_sha256, n.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)
"""
