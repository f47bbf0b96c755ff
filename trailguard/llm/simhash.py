"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A 64-bit fingerprint of a document has a bit set where over half of its word shingles' XXH64 values have it set. Two
fingerprints that differ in at most 2r bits have a value in common within r bits of both, so every distinct fingerprint
emits all values within half the radius, the shuffle brings equal values together, and neighbours in the order of a
value's fingerprints are linked after a count of differing bits. All fingerprints at a value are within half the radius of
it, so within the radius of each other, and these links join what all pairs would join. The radius is even. Links are
between distinct fingerprints only: copies share one. Groups are the connected components of the links, by rounds of
hooking to the least neighbour under a fresh random order and contraction, every round a table in the shared folder.

Null and empty texts have no words and the fingerprint zero, linked like any other; a null doc_id counts as the smallest;
rows with one doc_id are documents of their own; texts of any length are read whole, block by block; further columns don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, Runs, Words, blocks, key, mix, run_once, save, settled, table, unkey

#: A pair of similarity 0.8 has a band in common with probability 1 - (1 - 0.8^5)^16 = 0.998, one of 0.9 all but surely.
BANDS, ROWS = 16, 5
#: Shingles are counted by so many values of their hashes, a power of two, in so many parts.
CELLS, PARTS = 1 << 22, 256
#: Words of 64 bits in a text's parity bits.
PARITY = 8
_ASCII_LOWER = LOWER.tobytes()


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    words = text.translate(_ASCII_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(r, seed) for r in runs), np.uint64)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[first : first + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, words: int = 0, similarity: float = 1.0) -> DataFrame:
    """doc (the doc_id as a key), fp (the fingerprint as a signed long), sum (a hash of the text) of all documents (doc_id,
    text). Where `words` isn't 0 also bands, size, prefix and parity of their shingles of that many words."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_cells(docs, words) if words else None)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fp = np.array([fingerprint(x.as_py().encode(), shingle) for x in block.column(1)], np.uint64)
            columns = [block.column(0), pa.array(fp.view(np.int64)), block.column(2)]
            if words:
                h, at = shingles(block.column(1), words)
                own = np.unique(h.view(np.int64))
                columns += [band_hashes(h, at), *prefixes(h, at, similarity, own, counts.value[own & (CELLS - 1)])]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc long, fp long, sum long" + (", bands array<long>, size int, prefix array<long>, parity array<long>" if words else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(key().alias("doc"), "text", F.xxhash64("text").alias("sum")).mapInArrow(rows, schema)


def shingles(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts (of fewer words: one of all its words; of none: none), and where each text's
    begin (one more than texts)."""
    w = Words(text, NOT_SPACE, lower=True)
    n = np.diff(w.first)
    count = np.where(n, np.maximum(n - words + 1, 1), 0)
    at = np.append(0, np.cumsum(count))
    start = np.repeat(w.first[:-1] - at[:-1], count) + np.arange(at[-1])
    return Runs(w.hash).hash(start, np.minimum(start + words, np.repeat(w.first[1:], count))), at


def _of_texts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[np.ndarray]:
    """The shingles of each block of texts, every text's distinct ones."""
    for block in blocks(batches):
        h, at = shingles(block.column(0), words)
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        yield h[new].view(np.int64)


def shingle_cells(docs: DataFrame, words: int) -> np.ndarray:
    """By the last bits of a shingle's hash, how many distinct texts have it, all shingles of all texts counted: those that
    share a cell add up, so none seems rarer than it is. The counts only set the order in which prefixes take shingles:
    every order gives the same links, one by frequency the fewest candidates. A task sums its own texts and hands on
    compressed counts, so what is shuffled is a few bits a cell and task, and the driver gets CELLS counts."""
    codec, width = "zstd", CELLS // PARTS

    def packed(part: list[int], counts: list[np.ndarray]) -> pa.RecordBatch:
        # the bytes of one place stand together: the upper ones are mostly zero
        n = [pa.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), codec, asbytes=True) for x in counts]
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.binary())], ["part", "n"])

    def unpacked(n: bytes) -> np.ndarray:
        planes = np.frombuffer(pa.decompress(n, 4 * width, codec, asbytes=True), np.uint8)
        return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(CELLS, "<u4")
        for h in _of_texts(batches, words):
            cell, times = np.unique(h & (CELLS - 1), return_counts=True)
            n[cell] += times.astype("<u4")
        parts = n.reshape(PARTS, width)
        some = np.flatnonzero(parts.any(axis=1)).tolist()
        yield packed(some, [parts[k] for k in some])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, np.uint32(0)) + unpacked(n.as_py())
        yield packed(list(sums), list(sums.values()))

    parts = docs.select("text").distinct().mapInArrow(counted, "part int, n binary").repartition("part").mapInArrow(added, "part int, n binary")
    cells = np.zeros((PARTS, width), np.int64)
    with run_once(docs.sparkSession):
        for r in parts.collect():
            cells[r["part"]] = unpacked(r["n"])
    return cells.ravel().astype(np.uint32)


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that over two texts have, sorted, and how many distinct texts have each: exact, and all of them come to
    the caller, so for small tables. `shingle_cells` counts those of large ones."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h in _of_texts(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array(h)], ["h"])

    counts = docs.select("text").distinct().mapInArrow(rows, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    with run_once(docs.sparkSession):
        found = counts.toArrow().sort_by("h")
    return found["h"].to_numpy(), found["n"].to_numpy()


def prefixes(h: np.ndarray, at: np.ndarray, similarity: float, common: np.ndarray, count: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each text the number n of its distinct shingles; the first n - ceil(similarity * n) + 1 of them in the order
    by frequency: of two texts of at least that similarity, the prefixes have a shingle in common; and its parity bits, each
    of which says whether the number of shingles that fall on it is odd: two texts' bits differ in no more places than there
    are shingles that only one of them has."""
    h = h.view(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rank = np.zeros(len(h), np.int64)
    if len(common):
        place = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[place] == h, count[place], 0)
    order = np.lexsort((h, rank, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    n = np.bincount(text, minlength=len(at) - 1)
    take = np.where(n, n - np.ceil(similarity * n - 1e-6).astype(np.int64) + 1, 0)
    inside = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(take, n)
    bit = mix(h.view(np.uint64) ^ np.uint64(0x2127599BF4325C37))
    cell = text * PARITY + (bit >> np.uint64(6)).astype(np.int64) % PARITY
    order = np.argsort(cell, kind="stable")
    odd, first = np.zeros((len(at) - 1) * PARITY, np.uint64), np.flatnonzero(np.append(True, np.diff(cell[order]) > 0)[: len(cell)])
    if len(first):
        odd[cell[order][first]] = np.bitwise_xor.reduceat((np.uint64(1) << (bit & np.uint64(63)))[order], first)
    parity = pa.ListArray.from_arrays(pa.array(np.arange(0, len(odd) + 1, PARITY), pa.int32()), pa.array(odd.view(np.int64)))
    return pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(take)), pa.int32()), pa.array(h[inside])), parity


def band_hashes(h: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """For each text a hash of each band's least shingle hashes under ROWS functions; of a text without words, none."""
    some = np.flatnonzero(np.diff(at))
    out = np.zeros((len(some), BANDS), np.uint64)
    if len(some):
        seeds = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS)
        for band in range(BANDS):
            name = np.full(len(some), band, np.uint64)
            for seed in seeds[band]:
                name = mix(name + np.minimum.reduceat((h ^ seed) * (seed | np.uint64(1)), at[some]))
            out[:, band] = name
    sizes = np.zeros(len(at) - 1, np.int64)
    sizes[some] = BANDS
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(out.reshape(-1).view(np.int64)))


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts (id, text) have at least that similarity."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            (x, at_x), (y, at_y) = (shingles(block.column(k).cast(pa.string()), words) for k in (2, 3))
            near = np.zeros(block.num_rows, bool)
            for k in range(block.num_rows):
                p, q = np.unique(x[at_x[k] : at_x[k + 1]]), np.unique(y[at_y[k] : at_y[k + 1]])
                common = len(np.intersect1d(p, q, assume_unique=True))
                near[k] = common >= similarity * (len(p) + len(q) - common)
            yield block.select(["a", "b"]).filter(pa.array(near))

    both = pairs.join(texts.toDF("a", "text"), "a").join(texts.toDF("b", "other"), "b")
    return save(both.select("a", "b", "text", "other").mapInArrow(linked, "a long, b long"), "near")


def similar(docs: DataFrame, prints: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between fingerprints of prints whose texts have a Jaccard similarity of shingles of at least that: most
    of them, for few comparisons, so that `missed` has to compare only what these don't join."""
    banded = save(prints.select("fp", F.explode("bands").alias("band")).distinct(), "bands")
    picks = F.array_distinct(F.array(*[F.min_by("fp", F.xxhash64("fp", "band", F.lit(k))) for k in range(3)]))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), picks.alias("picks")).where("n > 1").drop("n")
    members = save(banded.join(shared, "band"), "members")
    owner = prints.groupBy("fp").agg(F.min(F.struct("doc", "sum")).alias("o")).select("fp", "o.doc", "o.sum")
    wanted = members.select("fp").distinct().join(owner, "fp")
    texts = docs.select(key().alias("doc"), F.xxhash64("text").alias("sum"), "text").join(wanted, ["doc", "sum"])
    texts = save(texts.select("fp", "text").dropDuplicates(["fp"]), "texts")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a != fp").select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")).distinct()

    first = save(ordered(members.select("fp", F.explode("picks").alias("a"))), "candidates")
    near = verified(first, texts, words, similarity)
    degree = near.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").count()
    hubs = members.join(degree, "fp").groupBy("band").agg(F.max_by("fp", F.struct("count", "fp")).alias("a"))
    return near.union(verified(ordered(members.join(hubs, "band")).join(first, ["a", "b"], "left_anti"), texts, words, similarity))


def missed(docs: DataFrame, prints: DataFrame, roots: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) between roots of fingerprints that are not joined yet, by all pairs of texts of at least the similarity.

    Such texts have a shingle in common that is in the longer one's prefix and among the first n - ceil(2s / (1 + s) n) + 1
    of the other's n; the first one in common also stands so early in both that enough shingles follow. Lists of texts
    that have one root are left out before texts are paired, and pairs whose parity bits differ too much for the similarity
    before their texts are read."""
    one = prints.where("size > 0").groupBy("sum").agg(F.first("fp").alias("fp"), F.first("size").alias("n"), F.first("prefix").alias("prefix"), F.first("parity").alias("parity"))
    rooted = save(one.join(roots.toDF("fp", "root"), "fp", "left").select("sum", "n", F.coalesce("root", "fp").alias("root"), "prefix", "parity"), "prefixes")
    lists = rooted.select("root", F.explode("prefix").alias("h")).groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    mixed = save(lists.where("least < most").select("h"), "mixed")
    postings = save(rooted.select("sum", "n", "root", F.posexplode("prefix").alias("i", "h")).join(mixed, "h"), "postings")
    x = postings.where(F.col("i") <= F.col("n") * (1 - 2 * similarity / (1 + similarity)) + 1e-6).toDF("h", "x", "n_x", "root_x", "i_x")
    y = postings.toDF("h", "y", "n_y", "root_y", "i_y")
    apart = F.col("root_x") != F.col("root_y")
    sizes = (F.col("n_x") >= similarity * F.col("n_y") - 1e-6) & ((F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("x") < F.col("y"))))
    rest = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y")) >= similarity / (1 + similarity) * (F.col("n_x") + F.col("n_y")) - 1e-6
    pairs = save(x.join(y, (x["h"] == y["h"]) & apart & sizes & rest).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "candidates")
    bits = [save(pairs.select(c).distinct().join(rooted.select(F.col("sum").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}")), c), "parity") for c in "ab"]
    differ = sum((F.bit_count(F.col("p_a")[k].bitwiseXOR(F.col("p_b")[k])) for k in range(PARITY)), F.lit(0))
    alike = differ <= (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    pairs = save(pairs.join(bits[0], "a").join(bits[1], "b").where(alike).select("a", "b"), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("sum")).distinct()
    texts = docs.select(F.xxhash64("text").alias("sum"), "text").join(wanted, "sum").groupBy("sum").agg(F.first("text").alias("text"))
    near = verified(pairs, save(texts, "texts"), words, similarity)
    root = rooted.select("sum", "root")
    return near.join(root.toDF("a", "root_a"), "a").join(root.toDF("b", "root_b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()


def ball(bits: int) -> list[int]:
    """Masks of at most `bits` of 64 bits, as signed longs."""
    masks = [sum(1 << b for b in c) for r in range(bits + 1) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within the radius of each other, directly or by others."""
    if radius % 2:
        raise ValueError("the radius must be even: two halves make it")
    masks = F.array(*[F.lit(m) for m in ball(radius // 2)])
    balls = fps.select("fp", F.explode(masks).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp")
    # sorted within a variant, at most as many as its ball has members
    one = Window.partitionBy("variant").orderBy("fp")
    near = balls.withColumn("before", F.lag("fp").over(one)).where(F.col("before").isNotNull())
    return near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= radius).select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()


def _order(c: Column, turn: int) -> Column:
    return F.xxhash64(c, F.lit(turn))


def components(edges: DataFrame) -> DataFrame:
    """node, root of all nodes of the links (a, b): nodes of one component have one root.

    Each round orders nodes anew at random, hooks every node to the least of itself and its neighbours, and replaces the
    ends of each link by what they hooked to (twice). A node with a great many links is one row of a partial aggregate
    and the side of a join that Spark can split, so it costs no more than the links themselves."""
    edges = save(edges.where(F.col("a") != F.col("b")), "links")
    labels = save(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct().withColumn("root", F.col("node")), "labels")
    turn = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min(_order(F.col("b"), turn)).alias("rank"), F.min_by("b", _order(F.col("b"), turn)).alias("b"))
        own = _order(F.col("a"), turn)
        hook = save(least.select(F.col("a").alias("node"), F.when(F.col("rank") < own, F.col("b")).otherwise(F.col("a")).alias("up")), "hook")
        upper = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook = save(hook.join(upper, "up").select("node", F.col("top").alias("up")), "hook")
        labels = save(labels.join(hook.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        to = [hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab"]
        moved = edges.join(to[0], "a").select("a_up", "b").join(to[1], "b").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b"))
        edges = save(moved.where(F.col("a") != F.col("b")).distinct(), "links")
        turn += 1
    return labels


def grouped(docs: DataFrame, shingle: int = 3, radius: int = 2, similarity: float | None = None, words: int = 5) -> DataFrame:
    """doc, fp, sum as of fingerprints, and component (the smallest doc of its group, possibly its own). With a similarity,
    texts with that Jaccard similarity of shingles of `words` words, or more, are linked as well."""
    prints = save(fingerprints(docs, shingle) if similarity is None else fingerprints(docs, shingle, words, similarity), "fingerprints")
    distinct = save(prints.groupBy("fp").agg(F.min("doc").alias("doc")), "distinct")
    edges = links(distinct.select("fp"), radius)
    if similarity is not None:
        edges = edges.union(similar(docs, prints, words, similarity)).distinct()
    roots = components(edges)
    if similarity is not None:
        more = components(missed(docs, prints, roots, words, similarity))
        own = distinct.select("fp").join(roots.toDF("fp", "root"), "fp", "left").select(F.col("fp").alias("node"), F.coalesce("root", "fp").alias("root"))
        roots = own.join(more.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    rooted = save(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "doc", F.coalesce("root", "fp").alias("root")), "rooted")
    least = save(rooted.groupBy("root").agg(F.min("doc").alias("component")), "least")
    groups = save(rooted.join(least, "root").select("fp", "component"), "groups")
    return prints.join(groups, "fp").select("doc", "fp", "sum", "component")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, similarity: float | None = None, words: int = 5) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id of its group, possibly its own)."""
    return grouped(docs, shingle, radius, similarity, words).select(unkey("doc").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), unkey("component").alias("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled("near", lambda: near_duplicates(table(spark, sf_dir, "documents")))
