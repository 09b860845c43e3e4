"""Centroid clustering of integer vectors with one upper and one lower bound a vector (Hamerly, 2010).

A vector's upper bound is on the distance to its own centroid, its lower bound on that to the second nearest. When centroids move, the upper
bound grows by its own centroid's drift and the lower one falls by the largest drift of the others. While the upper bound stays under the
lower one, or under half the way from its centroid to the nearest other, the vector keeps its centroid without a look at any; only the rest
is compared with all centroids, in exact integers. Bounds are floats and are widened by more than their rounding, so they never decide a tie.

Vectors and bounds are a table that each round reads and writes anew; sums are added where the vectors are. What meets in the driver are k centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, dropped, slices, written

#: Relative slack of the bounds; float rounding over some rounds is a ten thousandth of it.
SLACK = 1e-11
#: Components are under this size, so that squared distances fit 64 bits.
LARGEST = 1 << 26
STATE = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long, full_scans int"
TYPES = {"vec_id": pa.int64(), "v": pa.list_(pa.int32()), "cluster": pa.int32(), "upper": pa.float64(), "lower": pa.float64(), "distance": pa.int64(), "full_scans": pa.int32()}


def scaled_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors with just ``dims`` components, none null or not finite; other rows are left out.

    A component whose integer has 2^26 or more raises, as squared distances would not fit 64 bits.
    """
    x = F.col("embedding").cast("array<double>")
    usable = (F.size(x) == dims) & F.forall(x, lambda a: F.coalesce(F.abs(a) < float("inf"), F.lit(False)))
    far = F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}")).cast("int")
    whole = F.transform(x, lambda a: F.when(F.abs(a * scale) < LARGEST, F.floor(a * scale).cast("int")).otherwise(far))
    return embeddings.select(F.col("vec_id").cast("long"), F.when(usable, whole).alias("v")).where("v is not null")


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of ``salt:vec_id``, in that order (rows of one id by their components); a null id comes last."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    return np.array([r["v"] for r in rows], np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids, as integers."""
    largest = int(max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)))
    exact = 4 * x.shape[1] * largest**2 < 1 << 53  # then doubles hold every sum, and their products are faster
    a, b = (x.astype(float), centroids.astype(float)) if exact else (x, centroids)
    return ((a**2).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b**2).sum(axis=1)).astype(np.int64)


class Centroids:
    """What a round knows of the centroids: where they are, how far each has moved, and half the way from each to its nearest other."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at
        moved = np.zeros(len(at)) if before is None else np.sqrt(((at - before) ** 2).sum(axis=1).astype(float))
        self.moved = moved * (1 + SLACK)
        order = np.argsort(-self.moved, kind="stable")
        self.others_moved = np.full(len(at), self.moved[order[0]])
        self.others_moved[order[0]] = self.moved[order[1]] if len(at) > 1 else 0.0
        gaps = squared_distances(at, at).astype(float)
        np.fill_diagonal(gaps, np.inf)
        self.half_gap = np.sqrt(gaps.min(axis=1)) / 2 * (1 - SLACK)

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest centroid (of equally near ones the first), the squared distance, and the lower bound on all others."""
        found = squared_distances(x, self.at)
        own = found.argmin(axis=1)
        nearest = found[np.arange(len(x)), own]
        found[np.arange(len(x)), own] = np.iinfo(np.int64).max
        return own, nearest, np.sqrt(found.min(axis=1).astype(float)) * (1 - SLACK)

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """New cluster, upper and lower bound, squared distance, and whether all centroids were looked at."""
        upper, lower = upper + self.moved[own], lower - self.others_moved[own]
        bound = np.maximum(lower, self.half_gap[own]) * (1 - SLACK)
        distance = ((x - self.at[own]) ** 2).sum(axis=1)
        open_ = np.flatnonzero(upper * (1 + SLACK) >= bound)
        upper[open_] = np.sqrt(distance[open_].astype(float)) * (1 + SLACK)  # tightened first
        open_ = open_[upper[open_] * (1 + SLACK) >= bound[open_]]
        own, scanned = own.copy(), np.zeros(len(x), bool)
        if len(open_):
            own[open_], distance[open_], lower[open_] = self.scan(x[open_])
            upper[open_], scanned[open_] = np.sqrt(distance[open_].astype(float)) * (1 + SLACK), True
        return own, upper, lower, distance, scanned


def components(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def assigned(state: DataFrame, centroids: Centroids) -> DataFrame:
    """The next state of (vec_id, v) or of a state."""
    fresh = "cluster" not in state.columns

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, 4 << 20):
                x = components(part.column(1))
                if fresh:
                    own, distance, lower = centroids.scan(x)
                    upper, scans = np.sqrt(distance.astype(float)) * (1 + SLACK), np.ones(len(x), np.int64)
                else:
                    own, upper, lower, _, scans = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in range(2, 7))
                    own, upper, lower, distance, scanned = centroids.assign(x, own.astype(np.int64), upper, lower)
                    scans = scans + scanned
                yield batch_of(TYPES, {"vec_id": part.column(0), "v": part.column(1), "cluster": own, "upper": upper, "lower": lower, "distance": distance, "full_scans": scans})

    return state.mapInArrow(run, STATE)


def cluster_sums(state: DataFrame, dims: int) -> dict[int, tuple[int, np.ndarray]]:
    """Count and sums of each cluster: k rows of dims numbers a task, added by Spark."""
    def run(batches: Iterable[pa.RecordBatch]):
        counts: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x, own = components(batch.column(1)), batch.column(0).to_numpy()
            for c in np.unique(own).tolist():
                counts[c] = counts.get(c, 0) + int((own == c).sum())
                sums[c] = sums.get(c, 0) + x[own == c].sum(axis=0)
        yield batch_of({"cluster": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.int64())}, {"cluster": list(counts), "n": list(counts.values()), "sums": [s.tolist() for s in sums.values()]})

    parts = state.select("cluster", "v").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(dims))).collect()
    return {r["cluster"]: (r["n"], np.array(r[2:], np.int64)) for r in total}


def cluster(vectors: DataFrame, first: np.ndarray, rounds: int = 5) -> tuple[DataFrame, np.ndarray]:
    """Rounds of assignment and exact floored means, and a last assignment: its state (a table in the shared folder; full_scans counts the
    assignments in which a vector was compared with all centroids), and the centroids.

    ``vectors`` is (vec_id, v), ids null or repeated as they come; ``first`` has k rows, one or more. Of equally near centroids the first counts;
    a centroid without vectors stays.
    """
    now = Centroids(first)
    state = written(assigned(vectors, now), "clusters")
    for _ in range(rounds):
        at = now.at.copy()
        for c, (n, sums) in cluster_sums(state, at.shape[1]).items():
            at[c] = sums // n
        now = Centroids(at, now.at)
        following = written(assigned(state, now), "clusters")
        dropped(state)
        state = following
    return state, now.at


def cluster_report(embeddings: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    One row for each vector with ``dims`` finite components, repeated rows and null ids included; other rows have no result, and a
    table without such vectors gives an empty one. Fewer vectors than k make as many centroids. Further columns are ignored.
    """
    spark, vectors = embeddings.sparkSession, scaled_vectors(embeddings, dims, scale)
    first = first_centroids(vectors, k, salt)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(first):
        return spark.createDataFrame([], names)
    state, at = cluster(vectors, first, rounds)
    sizes = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda row: hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()
    known = spark.createDataFrame([(c, sizes[c], sum(sizes.values()), digest(at[c])) for c in sorted(sizes)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(known), "cluster").select(*(c.split(" ")[0] for c in names.split(", ")))


def cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """The same by plain comparison of all vectors with all centroids, a round a step."""
    steps = [f"""vecs AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM vecs QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, arg_min(c, d * {k} + c) AS c
          FROM (SELECT row, vec_id, v, c, CAST(list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM vecs, c{i}) GROUP BY row)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(any_value(n.m), any_value(c{i}.m)) AS m FROM c{i} LEFT JOIN
              (SELECT c, list(f ORDER BY k) AS m FROM (SELECT c, k, (sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS f FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS k FROM a{i}) GROUP BY c, k) GROUP BY c) n ON n.c = c{i}.c GROUP BY c{i}.c)""")
    return f"""WITH {', '.join(steps)} SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
