"""Clusters of whole-number vectors by centroids, the nearest found with the threshold algorithm.

Per dimension the centroids stand in a list sorted by their value. From a vector's own value
every list is walked outward, nearest value first. What a list has yielded so far is compared
exactly; the frontier, the sum over all dimensions of the squared distance to the value read
last, bounds every centroid not yet seen from below. A vector is done when its frontier
strictly exceeds its best exact distance (an equal one could still hide a tie), or when
nothing unseen is left.

Only the centroids, k x dimensions whole numbers, are sent to the tasks; a round brings back
one sum per centroid and dimension.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import shipped
from lectern.session import written

K, DIMENSIONS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
#: Whole numbers beyond this are set to it, so that squared distances stay exact in 64 bits.
LARGEST = 1 << 27
#: Vectors walked at a time, which bounds a task's memory.
LOT = 2_048


def whole_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, values): the vectors of the right length without null or non-finite components, as doubles."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    infinite = F.lit(float("inf"))
    odd = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return embeddings.select("vec_id", values.alias("values")).where((F.size("values") == dimensions) & ~odd)


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(256 x) within the largest whole number that the distances allow."""
    return np.clip(np.floor(SCALE * np.clip(values, -1e300, 1e300)), -LARGEST, LARGEST).astype(np.int64)


class SortedLists:
    """The centroids sorted by value in every dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.k, self.dimensions = centroids.shape
        order = np.argsort(centroids, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(centroids, order, axis=0).T)

    def _start(self, vectors: np.ndarray) -> np.ndarray:
        """Per vector and dimension, the place in the list of the first value not below the vector's."""
        return np.stack([np.searchsorted(self.values[d], vectors[:, d]) for d in range(self.dimensions)], axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid; the smaller number on ties."""
        n = len(vectors)
        number, best = np.full(n, self.k, np.int64), np.full(n, np.iinfo(np.int64).max, np.int64)
        seen = np.zeros((n, self.k), bool)
        dims = np.arange(self.dimensions)[None, :]
        high = self._start(vectors)
        low = high - 1
        rows = np.arange(n)
        while len(rows):
            mine = vectors[rows]
            lo, hi = low[rows], high[rows]
            down = np.where(lo >= 0, mine - self.values[dims, np.maximum(lo, 0)], np.iinfo(np.int64).max)
            up = np.where(hi < self.k, self.values[dims, np.minimum(hi, self.k - 1)] - mine, np.iinfo(np.int64).max)
            below = down <= up
            met = self.order[dims, np.where(below, lo, hi)]
            gap = np.where(below, down, up)
            low[rows], high[rows] = lo - below, hi + ~below
            fresh = np.zeros((len(rows), self.k), bool)
            fresh[np.arange(len(rows))[:, None], met] = True
            fresh &= ~seen[rows]
            seen[rows] |= fresh
            # In rising order of number, so that an equal later distance does not replace an earlier one.
            for c in np.flatnonzero(fresh.any(axis=0)):
                here = np.flatnonzero(fresh[:, c])
                away = mine[here] - self.centroids[c]
                distance = np.einsum("ij,ij->i", away, away)
                at = rows[here]
                wins = (distance < best[at]) | ((distance == best[at]) & (c < number[at]))
                best[at[wins]], number[at[wins]] = distance[wins], c
            frontier = np.einsum("ij,ij->i", gap, gap)
            rows = rows[(frontier <= best[rows]) & ~seen[rows].all(axis=1)]
        return number, best


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, LOT):
            part = batch.slice(at, LOT)
            values = np.asarray(part.column(1).flatten(), np.float64).reshape(part.num_rows, -1)
            yield part.column(0), scaled(values)


def _sums(centroids):
    """One row per task and centroid that has vectors: their count and componentwise sums."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids())
        count = np.zeros(lists.k, np.int64)
        total = np.zeros((lists.k, lists.dimensions), np.int64)
        for _, vectors in _lots(batches):
            number, _ = lists.nearest(vectors)
            count += np.bincount(number, minlength=lists.k)
            np.add.at(total, number, vectors)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    return sums


def _assigned(centroids):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedLists(centroids())
        for ids, vectors in _lots(batches):
            number, distance = lists.nearest(vectors)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return assigned


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The vectors of the k smallest digests of seed and id, in that order; rows of one id in order of their values."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    whole = F.transform("values", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))))
    top = vectors.select("values", digest.alias("digest"), whole.alias("whole")).orderBy(
        F.asc_nulls_last("digest"), "whole").limit(k).collect()
    return scaled(np.array([r["values"] for r in top], np.float64)) if top else np.empty((0, 0), np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: every centroid that has vectors goes to the floor of their exact mean."""
    sent = shipped(vectors.sparkSession, centroids)
    partial = vectors.mapInArrow(_sums(sent), "cluster long, n long, sums array<long>")
    means = partial.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    after = centroids.copy()
    for row in means:
        after[row.cluster, row.d] = int(row.s) // row.n
    return after


def clusters(embeddings: DataFrame, k: int = K, dimensions: int = DIMENSIONS, rounds: int = ROUNDS,
             seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per kept vector.

    ``embeddings`` has (vec_id, embedding); other columns are not looked at. Vectors that are
    null or empty, have another length, or hold a null, NaN or infinite component give no row.
    Every other row gives one, rows that share an id included; a null id is kept and is among
    the first centroids only where fewer than k rows have an id. Of fewer than k kept vectors
    each is a first centroid; of none the result is empty. Equal centroids stay apart, and the
    smaller number gets the vectors. Whole numbers beyond 2^27 (components beyond 524,288)
    count as 2^27; sums beyond a long stop at the greatest long.
    """
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, dimensions)
    centroids = first_centroids(vectors, k, seed)
    out = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    assigned = written(vectors.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(
        _assigned(shipped(spark, centroids)), out), "clusters")
    inertia = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most, total = (1 << 63) - 1, sum(inertia.values())
    # At most k rows, so this side of the join is small whatever the table's size.
    told = spark.createDataFrame(
        [(c, min(s, most), min(total, most), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
         for c, s in sorted(inertia.items())],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clusters_sql(k: int = K, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same by comparing every vector with every centroid."""
    nearest = """SELECT v.row, v.vec_id, v.x, arg_min(c.cluster, list_sum(list_transform(list_zip(v.x, c.x),
            lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT * {k} + c.cluster) AS cluster,
            min(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))::BIGINT AS distance
            FROM v, c{i} c GROUP BY v.row, v.vec_id, v.x"""
    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
        WHERE len(embedding) = {dimensions}
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
             f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, x) - 1)::INTEGER AS cluster, x FROM (
        SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, x FROM v ORDER BY h, x LIMIT {k}))"""]
    for i in range(rounds):
        parts.append(f"a{i} AS MATERIALIZED ({nearest.format(k=k, i=i)})")
        parts.append(f"""m{i} AS (SELECT cluster, list(m ORDER BY d) AS x FROM (SELECT cluster, d,
            floor_div(sum(x[d])::HUGEINT, count(*)) AS m FROM a{i}, range(1, {dimensions} + 1) r(d)
            GROUP BY cluster, d) GROUP BY cluster)""")
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(m{i}.x, c{i}.x) AS x
            FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    parts.append(f"a AS MATERIALIZED ({nearest.format(k=k, i=rounds)})")
    body = ",\n".join(parts).replace("floor_div(sum(x[d])::HUGEINT, count(*))", """CASE WHEN sum(x[d])::HUGEINT % count(*) < 0
            THEN sum(x[d])::HUGEINT // count(*) - 1 ELSE sum(x[d])::HUGEINT // count(*) END::BIGINT""")
    return f"""WITH {body}
        SELECT a.vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
            sum(a.distance) OVER ()::BIGINT AS inertia,
            sha256(array_to_string(list_transform(c.x, lambda v: v::VARCHAR), ',')) AS centroid_sha256
        FROM a JOIN c{rounds} c USING (cluster)"""


CLUSTERS_SQL = clusters_sql()
