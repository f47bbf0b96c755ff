"""Centroid clustering: Lloyd rounds whose nearest-centroid searches are Orchard's.

Each centroid has a list of the others, nearest first. A vector starts at one centroid and walks its list: a centroid that
is closer (or as close, with a smaller number) becomes the vector's own, and the walk goes on in that one's list, past those
visited already. It ends strictly beyond twice the current distance, where the triangle inequality rules out the rest, ties
included. All arithmetic is on integers, so distances, ties and means are exact and the same in any split of the rows.

Centroids and their lists are the only things sent to tasks (k x dims numbers), and a task returns its k sums, counts and
inertias: a round shuffles k rows a task, however the vectors are spread over clusters. Vectors are written once as
integers and scanned again by each round; rounds end early when no centroid moves, for later ones would change nothing.

Left out are vectors that are null, of another length, or with a null or non-finite component. Rows that repeat count each;
rows of one vec_id tie as starting centroids and are then taken by their components; a null vec_id hashes as `<seed>:`.
Fewer vectors than centroids make fewer centroids; an empty table gives no rows. Components whose integers pass 2^27 have no
distances that fit a long: they end the job with an error that says so. Columns besides vec_id and embedding may have any
name: they aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import save, settled, table

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
_LARGEST = 2**27


def integers(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, an array of floor(scale * x), of the vectors that are whole."""
    x = F.col("embedding")
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    far = F.exists("v", lambda c: F.abs(c) > _LARGEST)
    scaled = vectors.where(x.isNotNull() & whole).select("vec_id", F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))
    return scaled.select("vec_id", F.when(far, F.raise_error(F.lit(f"a component is beyond {_LARGEST // scale}"))).otherwise(F.col("v")).cast("array<int>").alias("v"))


def starts(rows: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least hashes of their ids."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    least = rows.select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in least], np.int64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Orchard:
    """Nearest of k centroids, ties to the smaller number."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids, k = centroids, len(centroids)
        between = apart(centroids[:, None], centroids[None])
        np.fill_diagonal(between, -1)  # a centroid is the first of its own list
        self.lists = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.between = np.take_along_axis(between, self.lists, 1)
        self.k = k

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Each row's centroid and squared distance, and how many distances that took."""
        n = len(v)
        own, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        distance = apart(v, self.centroids[own])
        visited = np.zeros((n, self.k), bool)
        visited[:, 0] = True
        on, took = np.arange(n if self.k > 1 else 0), n
        while len(on):
            mine, at = own[on], place[on]
            more = self.between[mine, at] <= 4 * distance[on]  # strictly beyond twice the distance none can win or tie
            on, mine, at = on[more], mine[more], at[more]
            other = self.lists[mine, at]
            place[on] += 1
            new = ~visited[on, other]
            rows, other, mine = on[new], other[new], mine[new]
            visited[rows, other] = True
            d = apart(v[rows], self.centroids[other])
            took += len(rows)
            better = (d < distance[rows]) | (d == distance[rows]) & (other < mine)
            rows, other, d = rows[better], other[better], d[better]
            own[rows], distance[rows], place[rows] = other, d, 0
            on = on[place[on] < self.k - 1]
        return own, distance, took


def matrix(v: pa.Array, dims: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def tally(rows: DataFrame, centroids: np.ndarray) -> list[tuple[int, list[int], int]]:
    """For each centroid how many vectors are nearest to it, their componentwise sums and the sum of their distances."""
    k, dims = centroids.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        count, total, inertia = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), [0] * k
        for b in batches:
            v = matrix(b.column("v"), dims)
            own, distance, _ = search.nearest(v)
            for c in np.unique(own).tolist():
                mine = own == c
                count[c] += mine.sum()
                total[c] += v[mine].sum(0)
                inertia[c] += sum(distance[mine].tolist())
        seen = np.flatnonzero(count)
        decimal = lambda x: pa.array(x, pa.decimal128(38, 0))
        components = pa.array([total[c].tolist() for c in seen], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(count[seen]), components, decimal([inertia[c] for c in seen])], ["c", "n", "total", "inertia"])

    parts = rows.select("v").mapInArrow(task, "c long, n long, total array<long>, inertia decimal(38,0)")
    sums = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(dims)]
    out = [(0, [0] * dims, 0)] * k
    for r in parts.groupBy("c").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *sums).collect():
        out[r["c"]] = (r["n"], [int(r[f"t{i}"]) for i in range(dims)], int(r["inertia"]))
    return out


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        moved = np.array([[t // n for t in total] if n else old.tolist() for (n, total, _), old in zip(tally(rows, centroids), centroids, strict=True)], np.int64)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance."""
    dims = centroids.shape[1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for b in batches:
            own, distance, _ = search.nearest(matrix(b.column("v"), dims))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(own, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    kind = dict(rows.dtypes)["vec_id"]
    return rows.select("vec_id", "v").mapInArrow(task, f"vec_id {kind}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector."""
    rows = save(integers(vectors, dims, scale), "vectors")
    first = starts(rows, k, seed)
    if not len(first):
        return rows.selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    centroids = fit(rows, first, rounds)
    inertia = [i for *_, i in tally(rows, centroids)]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    return assign(rows, centroids).withColumns({"cluster_inertia": of(inertia).cast("long"), "inertia": F.lit(sum(inertia)).cast("long"), "centroid_sha256": of(digests)})


def op12_orchard_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled("op12", lambda: cluster(table(spark, sf_dir, "embeddings")))


def _sql() -> str:
    parts = [f"""kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"m0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT sha256('{SEED}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept) ORDER BY h, v LIMIT {CLUSTERS})"]
    for i in range(ROUNDS + 1):
        parts.append(f"""d{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM
  (SELECT r, vec_id, v, c, list_sum(list_transform(range(1, {DIMS} + 1), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM (SELECT *, row_number() OVER () AS r FROM kept), m{i}) GROUP BY r)""")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM d{i}) GROUP BY c, i) GROUP BY c),
m{i + 1} AS MATERIALIZED (SELECT m{i}.c, coalesce(s{i}.m::BIGINT[], m{i}.m) AS m FROM m{i} LEFT JOIN s{i} ON m{i}.c = s{i}.c)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM d{ROUNDS} JOIN m{ROUNDS} ON best.c = m{ROUNDS}.c"""


OP12_SQL = _sql()
