"""Document fingerprints from prefix polynomial hashes.

For the code points c of a text, prefix[k] is the sum of c[i] * base^i for i < k, modulo a prime; two primes make a pair. A
span's hash is a difference of two prefixes, moved to a common power, so equality of any two spans costs a few
operations, and the longest common extension of two places is found by a binary search over its length. A text that is
put together from spans of others has prefixes that follow from theirs.

A fingerprint is the number of code points, a hash of the whole, and a sketch: the text is cut after every `GRAM` code points
whose hash (from the prefixes) has its bits of `EVERY` zero, so the same passages are cut alike wherever they stand, and the
`KEPT` least hashes of the spans between cuts are kept. The likeness of two texts is the larger of two shares: of the sketch
(an estimate of how many of all their spans both have; exact where a sketch has all of them), and of what they have in common
at their beginning and their end, found by binary search over prefix hashes, over the longer one's length.

Null texts are empty; the likeness of two empty texts is 1, of an empty and another text 0; rows with one doc_id follow
each other in the order of their texts' hashes; a null doc_id comes first; a single document is its own next one; the longest
text's prefixes take 8 bytes a code point; further columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, key, mix, shuffle_partitions, table, unkey

PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
CHUNK = 1 << 16
#: Code points whose hash decides on a cut, spans that have one cut on average, and hashes of a sketch.
GRAM, EVERY, KEPT = 16, 64, 32


class _Powers:
    """Powers of a base and of its inverse modulo a prime, at any places."""

    def __init__(self, base: int, prime: int) -> None:
        self.base, self.prime, self.inverse = base, prime, pow(base, -1, prime)
        self.powers, self.down = self._table(base), self._table(self.inverse)

    def _table(self, base: int) -> np.ndarray:
        powers = np.ones(1, np.uint64)
        while len(powers) < CHUNK:
            powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), self.prime)) % np.uint64(self.prime)])
        return powers

    def inverses(self, at: np.ndarray) -> np.ndarray:
        low = self.down[at % CHUNK]
        if not len(at) or int(at.max()) < CHUNK:
            return low
        far, where = np.unique(at // CHUNK, return_inverse=True)
        high = np.array([pow(self.inverse, int(k) * CHUNK, self.prime) for k in far], np.uint64)
        return low * high[where] % np.uint64(self.prime)


_POWERS = [_Powers(b, p) for b, p in zip(BASES, PRIMES, strict=True)]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class _Text:
    """What a text of n code points answers from its `prefix` and `prefixes`; `cuts` are where it is cut."""

    def spans(self, a: np.ndarray, b: np.ndarray, primes: slice = slice(None)) -> list[np.ndarray]:
        """Hashes of the code points from each a to before b, as if they stood at 0."""
        x, y = self.prefixes(a)[primes], self.prefixes(b)[primes]
        return [(v + np.uint64(p.prime) - u) * p.inverses(a) % np.uint64(p.prime) for u, v, p in zip(x, y, _POWERS[primes], strict=True)]

    def common(self, a: int, other: _Text, b: int, back: bool = False) -> int:
        """The longest common extension: how many code points from a on equal the other's from b on; `back`: before a
        equal the other's before b."""
        if a < b:
            return other.common(b, self, a, back)
        far = [pow(p.base, a - b, p.prime) for p in _POWERS]
        x, y, way = self.prefix(a), other.prefix(b), -1 if back else 1
        low, high = 0, b if back else min(self.n - a, other.n - b)
        while low < high:
            mid = (low + high + 1) // 2
            u, v = self.prefix(a + way * mid), other.prefix(b + way * mid)
            if all((u[k] - x[k] - (v[k] - y[k]) * far[k]) % p.prime == 0 for k, p in enumerate(_POWERS)):
                low = mid
            else:
                high = mid - 1
        return low


def _cuts(text: _Text, begin: np.ndarray) -> np.ndarray:
    h = text.spans(begin, begin + GRAM, slice(1))[0]
    return begin[(h * np.uint64(0x9E3779B1) >> np.uint64(12)) % np.uint64(EVERY) == 0] + GRAM


class Prefixes(_Text):
    """Prefix hashes of a text, for both primes."""

    def __init__(self, points: np.ndarray) -> None:
        self.n = n = len(points)
        self.hashes, self._own = [], None
        for p in _POWERS:
            prime = np.uint64(p.prime)
            out = np.zeros(n + 1, np.uint32)
            for first in range(0, n, CHUNK):
                part = points[first : first + CHUNK].astype(np.uint64) + np.uint64(1)
                sums = np.cumsum(part * p.powers[: len(part)] % prime) % prime  # below 2^16 terms of 31 bits
                if first:
                    sums = (sums * np.uint64(pow(p.base, first, p.prime)) + np.uint64(out[first])) % prime
                out[first + 1 : first + 1 + len(part)] = sums
            self.hashes.append(out)

    def prefix(self, k: int) -> tuple[int, int]:
        return int(self.hashes[0][k]), int(self.hashes[1][k])

    def prefixes(self, k: np.ndarray) -> list[np.ndarray]:
        return [h[k].astype(np.uint64) for h in self.hashes]

    def cuts(self) -> np.ndarray:
        if self._own is None:
            found = [_cuts(self, np.arange(first, min(first + CHUNK, self.n - GRAM + 1))) for first in range(0, self.n - GRAM + 1, CHUNK)]
            self._own = np.concatenate(found) if found else np.zeros(0, np.int64)
        return self._own


class Joined(_Text):
    """The first k code points of one text and then the first m of another, without a pass over them."""

    def __init__(self, one: Prefixes, k: int, two: Prefixes, m: int) -> None:
        self.one, self.k, self.two, self.m, self.n = one, k, two, m, k + m
        self.head, self.far = one.prefix(k), [pow(p.base, k, p.prime) for p in _POWERS]

    def prefix(self, i: int) -> tuple[int, int]:
        if i <= self.k:
            return self.one.prefix(i)
        tail = self.two.prefix(i - self.k)
        return tuple((h + t * f) % p.prime for h, t, f, p in zip(self.head, tail, self.far, _POWERS, strict=True))

    def prefixes(self, i: np.ndarray) -> list[np.ndarray]:
        own, rest = self.one.prefixes(np.minimum(i, self.k)), self.two.prefixes(np.maximum(i - self.k, 0))
        return [np.where(i <= self.k, a, (b * np.uint64(f) + np.uint64(h)) % np.uint64(p.prime)) for a, b, h, f, p in zip(own, rest, self.head, self.far, _POWERS, strict=True)]

    def cuts(self) -> np.ndarray:
        own, rest = self.one.cuts(), self.two.cuts()
        across = _cuts(self, np.arange(max(0, self.k - GRAM + 1), min(self.k, self.n - GRAM + 1)))
        return np.concatenate([own[own <= self.k], across, rest[rest <= self.m] + self.k])


def fingerprint(text: _Text) -> str:
    """n:whole:sketch in hex; a span's hash in the sketch has 32 bits mixed from both primes'."""
    cuts = text.cuts()
    edges = np.concatenate([[0], cuts[cuts < text.n], [text.n]]).astype(np.int64)
    x, y = text.spans(edges[:-1], edges[1:]) if text.n else np.zeros((2, 0), np.uint64)
    kept = np.unique(mix(x << np.uint64(32) | y) >> np.uint64(32))[:KEPT]
    whole = text.prefix(text.n)
    return f"{text.n:x}:{whole[0]:08x}{whole[1]:08x}:{kept.astype('>u4').tobytes().hex()}"


def overlap(a: str, b: str) -> float:
    """The share that the spans of both texts have of those of either, estimated from the least of all."""
    x, y = ({s[i : i + 8] for i in range(0, len(s), 8)} for s in (a.rsplit(":", 1)[1], b.rsplit(":", 1)[1]))
    least = sorted(x | y)[:KEPT]
    return sum(h in x and h in y for h in least) / len(least) if least else 0.0


def likeness(a: str, b: str, one: _Text, two: _Text) -> float:
    """What two texts with these fingerprints have in common, from 0 to 1: the larger share, of spans or at the ends."""
    if a == b:
        return 1.0
    short, long = sorted((one.n, two.n))
    if not short:
        return 0.0
    ends = one.common(0, two, 0) + one.common(one.n, two, two.n, back=True)
    return max(overlap(a, b), min(ends, short, long - 1) / long)


ROWS = "d long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_half(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents (doc_id, text), of their texts with the second half replaced by the beginning of the
    next document's text, and likenesses. Documents are dealt to ranges of doc_id and text hash; a doc_id with many rows is
    several ranges. The first document of a range goes to the range before it too, as the next one of that range's last."""
    spark = docs.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    keyed = docs.select(key().alias("d"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), "text")
    # a sketch of bounded size: with a great many ranges their sizes differ a little more
    bounds = sorted(int(x) for x in keyed.approxQuantile("d", [i / ranges for i in range(1, ranges)], max(0.1 / ranges, 1e-5)) or [])
    cuts = spark.sparkContext.broadcast(np.array(bounds, np.int64))  # fewer than ranges

    @F.pandas_udf("int")
    def range_of(d: pd.Series, h: pd.Series) -> pd.Series:
        """A doc_id that is n bounds at once has n ranges, by equal shares of its texts' hashes."""
        ids, low = d.to_numpy(), h.to_numpy().view(np.uint64) >> np.uint64(32)
        before, after = (np.searchsorted(cuts.value, ids, side) for side in ("left", "right"))
        share = ((low ^ np.uint64(1 << 31)) * (after - before).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        return pd.Series((before + np.where(after > before, 1 + share, 0)).astype(np.int32))

    keyed = keyed.withColumn("r", range_of("d", "h"))
    # one row per range comes to the driver
    heads = sorted((r["r"], *r["first"]) for r in keyed.groupBy("r").agg(F.min(F.struct("d", "h")).alias("first")).collect())
    if not heads:
        return spark.createDataFrame([], ROWS)
    before = [(heads[i][1], heads[i][2], heads[i - 1][0], i == 0) for i in range(len(heads))]
    ghosts = spark.createDataFrame(before, "d long, h long, r int, last boolean")
    own = keyed.select("r", F.lit(False).alias("ghost"), F.lit(False).alias("last"), "d", "text", "h")
    again = keyed.drop("r").join(F.broadcast(ghosts), ["d", "h"]).select("r", F.lit(True).alias("ghost"), "last", "d", "text", "h")
    # a range's own documents, then the ghost that follows
    dealt = own.union(again).repartition(shuffle_partitions(spark), "r").sortWithinPartitions("r", "ghost", "last", "d", "h", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ROWS.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        held, out, size = None, [], 0
        for block in blocks(batches, column="text"):
            for r, ghost, d, text in zip(*(block.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if held and held[0] != r:  # further ghosts with the head's doc_id
                    held = None
                if ghost and not held:
                    continue
                now = (r, d, text, Prefixes(code_points(text)))
                own = fingerprint(now[3])
                if held:
                    out.append(_edited(*held[1:], text, now[3], own))
                    size += len(held[2])
                held = None if ghost else (*now, own)
            if len(out) > 500 or size > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(rows, ROWS)


def _edited(d: int, text: str, prefixes: Prefixes, own: str, next_text: str, next_prefixes: Prefixes, next_own: str) -> tuple:
    n = prefixes.n
    tail = n // 2
    taken = min(tail, next_prefixes.n)
    joined = Joined(prefixes, n - tail, next_prefixes, taken)
    edited = fingerprint(joined)
    sha = hashlib.sha256((text[: n - tail] + next_text[:taken]).encode()).hexdigest()
    return d, n, sha, own, edited, likeness(own, edited, prefixes, joined), likeness(own, next_own, prefixes, next_prefixes)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_half(table(spark, sf_dir, "documents")).withColumn("d", unkey("d")).withColumnRenamed("d", "doc_id")
