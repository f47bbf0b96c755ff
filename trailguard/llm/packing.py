"""Packing of documents into sequences of a fixed number of tokens, shortest pack first, over the histogram of lengths.

A document longer than a sequence gives full pieces, each a sequence of its own, and a remainder. Only the histogram of
the remainders' lengths (at most as many bins as a sequence has tokens) comes to the driver. There the needed number of
packs is opened and lengths are placed longest first into the pack with the most room; packs that are alike are one
pattern with a count, so a placement takes a whole run of documents of that length at once. Where a length no longer fits
into any pack, it is cut at the room that is left and the rest goes back to the histogram. The plan says, for each
length, which ranks of its documents go to which packs; documents get their rank from counts by input partition, with
prefix sums, so no group of equal lengths meets in one task.

Null texts are empty (one token, the end); rows with one doc_id are packed each by itself; very long texts are cut into
full sequences; an empty table gives no rows; further columns, of any name, don't matter.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, save, settled, table
from .tokens import default_tokenizer, encoder

SEQUENCE = 2048


def shortest_pack_first(histogram: dict[int, int], size: int) -> tuple[int, list[tuple]]:
    """How many packs, and the placements (length, first rank, count, from, tokens, first pack, offset): of the `count`
    pieces of that length from that rank on, the tokens from `from` on go to the packs from `first pack` on."""
    total = sum(length * n for length, n in histogram.items())
    packs = -(-total // size)
    if not packs:
        return 0, []
    open_packs = [(0, 0, packs)]  # a heap of (filled, first pack, count): packs filled alike are one pattern
    waiting: dict[int, list] = {length: [(length, 0, n, 0)] for length, n in histogram.items() if n}
    todo = [-length for length in waiting]
    heapq.heapify(todo)
    plan = []
    while todo:
        length = -heapq.heappop(todo)
        for source, rank, left, start in waiting.pop(length):
            while left:
                filled, pack, count = heapq.heappop(open_packs)
                used, fits = min(left, count), min(length, size - filled)
                plan.append((source, rank, used, start, fits, pack, filled))
                if filled + fits < size:
                    heapq.heappush(open_packs, (filled + fits, pack, used))
                if count > used:
                    heapq.heappush(open_packs, (filled, pack + used, count - used))
                if fits < length:
                    rest = length - fits
                    if rest not in waiting:
                        waiting[rest] = []
                        heapq.heappush(todo, -rest)
                    waiting[rest].append((source, rank, used, start + fits))
                rank, left = rank + used, left - used
    return packs, plan


class Plan:
    """Placements by length and rank."""

    def __init__(self, plan: list[tuple]) -> None:
        self.by: dict[tuple[int, int], list] = defaultdict(list)
        for source, rank, count, start, tokens, pack, offset in sorted(plan):
            self.by[source, start].append((rank, count, tokens, pack, offset))
        self.ranks = {k: [x[0] for x in v] for k, v in self.by.items()}

    def pieces(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(from, tokens, pack, offset) of each part of the piece."""
        start = 0
        while start < length:
            k = bisect_right(self.ranks[length, start], rank) - 1
            first, count, tokens, pack, offset = self.by[length, start][k]
            yield start, tokens, pack + rank - first, offset
            start += tokens


PIECES = "part int, slot long, length int, doc_id long, start long, ids_crc32 long, doc_tokens long, ids binary"


def cut(docs: DataFrame, tokenizer: str, end_id: int, size: int, with_ids: bool) -> DataFrame:
    """Full pieces and remainders of all documents, counted by length within each input partition."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for block in blocks(batches):
            rows = []
            for doc_id, text in zip(block.column(0).to_pylist(), block.column(1), strict=True):
                coded = enc.text(text.as_py().encode()) + end
                n = len(coded) // width
                for start in range(0, n, size):
                    ids = coded[start * width : (start + size) * width]
                    length = len(ids) // width
                    crc = zlib.crc32(np.frombuffer(ids, enc.dtype).astype("<u4").tobytes()) if length == size else None
                    rows.append((part, seen[length], length, doc_id, start, crc, n, ids if with_ids or length < size else None))
                    seen[length] += 1
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, size: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    with_ids the ids themselves (little-endian, 16 or 32 bits)."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    pieces = save(cut(docs, path, end_id, size, with_ids), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = save(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    # at most `size` rows
    histogram = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    histogram.pop(size, None)
    packs, placements = shortest_pack_first(histogram, size)
    plan = spark.sparkContext.broadcast(placements)  # its size depends on the number of lengths, not of documents

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, by = encoder(path).dtype, Plan(plan.value)
        width = dtype.itemsize
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            out = []
            for doc_id, start, length, crc, n, rank, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids")), strict=True):
                if length == size:
                    out.append((doc_id, start, length, crc, n, packs + rank, 0, ids))
                    continue
                for at, tokens, sequence, offset in by.pieces(length, rank):
                    own = ids[at * width : (at + tokens) * width]
                    crc = zlib.crc32(np.frombuffer(own, dtype).astype("<u4").tobytes())
                    out.append((doc_id, start + at, tokens, crc, n, sequence, offset, own))
            if out:
                columns = list(zip(*out, strict=True))[: len(names)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, columns, strict=True)], names)

    # bases has a row per length and input partition, so it grows with the input: joined by sorting, never broadcast
    ranked = pieces.join(bases.drop("n").hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("slot"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "ids").mapInArrow(placed, schema + ", ids binary" * with_ids)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled("packed", lambda: pack(table(spark, sf_dir, "documents"), with_ids=False))
