"""Centroid clustering of whole-number vectors, with an n-simplex projection that rules out centroids.

The distances of a vector to ``n`` pivots fix the apex of a simplex over the pivots: ``n - 1`` coordinates in the space the
pivots span and a height above it. For two vectors the Euclidean distance of their apexes is a lower bound of their distance;
with one of them mirrored below the pivots' space it is an upper bound. A vector's distances to the pivots are measured
once and its apex is stored beside it; a pass measures the few centroids only, rules out those whose lower bound is above the
least upper bound, and compares the rest by exact integer distances.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vakanta.llm.common import checkpointed

PIVOTS = 40
# squared distances of vectors within it stay below 2^62 at up to 1024 components
LARGEST = 2.0**25
# share of a squared length by which rounding may move an apex distance; measured errors are below 1e-12
SLACK = 1e-9


def whole_vectors(vectors: DataFrame, width: int = 64, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(key, v array<int>): every component as ``floor(scale * x)``; rows that take part, repeats included.

    Rows take no part whose vector is null, has another number of components, or holds null or non-finite ones. Components
    beyond ``LARGEST`` after scaling, whose distances could pass 64 bits, count as non-finite. A null key stays.
    """
    wide = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale).cast("double"))
    fit = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LARGEST) & ~F.isnan(x))
    some = vectors.filter(F.col(vector).isNotNull() & (F.size(vector) == width) & fit)
    return some.select(F.col(key).cast("long").alias("key"), F.transform(wide, lambda x: x.cast("int")).alias("v"))


def first_by_hash(vectors: DataFrame, k: int, seed: int = 2) -> list[list[int]]:
    """The ``k`` vectors (fewer, if there are no more) of the smallest SHA-256 of ``<seed>:<key>``; ties by vector.

    A null key hashes as the empty text. Only these reach the driver; every task hands on ``k`` at most.
    """
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    rows = vectors.withColumn("h", F.sha2(name.cast("binary"), 256)).orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in rows]


class Simplex:
    """The base simplex of pivots, and the apexes of vectors above it."""

    def __init__(self, pivots):
        import numpy as np

        self.pivots = np.asarray(pivots, dtype=np.float64)
        first = self.pivots[0]
        # a triangular base: each pivot in use adds one direction, those that add none are left out
        basis, self.used = [], [0]
        for i, p in enumerate(self.pivots[1:], 1):
            rest = p - first
            size = float(rest @ rest)
            for b in basis + basis:  # twice, against rounding
                rest = rest - (rest @ b) * b
            if float(rest @ rest) > 1e-9 * max(size, 1.0):
                basis.append(rest / np.sqrt(rest @ rest))
                self.used.append(i)
        directions = np.array(basis).reshape(len(basis), self.pivots.shape[1])
        self.base = (self.pivots[self.used] - first) @ directions.T
        # x from distances alone: 2 p_i . x = |p_i|^2 + d_0^2 - d_i^2
        self.solve = np.linalg.inv(2 * self.base[1:]) if len(self.used) > 1 else np.zeros((0, 0))
        self.squares = (self.base[1:] ** 2).sum(axis=1)

    def distances(self, rows):
        """Squared distances to the pivots in use: exact whole numbers, as doubles."""
        import numpy as np

        chosen = self.pivots[self.used].astype(np.int64)
        rows = rows.astype(np.int64)
        return np.stack([((rows - p) ** 2).sum(axis=1) for p in chosen], axis=1).astype(np.float64)

    def apexes(self, squared):
        """Coordinates within the pivots' space and the height above it, from squared distances to the pivots."""
        import numpy as np

        inside = (self.squares[None, :] + squared[:, :1] - squared[:, 1:]) @ self.solve.T
        height = np.sqrt(np.maximum(squared[:, 0] - (inside**2).sum(axis=1), 0.0))
        return np.column_stack([inside, height])


def bounds(left, right):
    """Squared lower and upper bounds of the distances between the vectors of two sets of apexes, rounding allowed for."""
    import numpy as np

    inside = (left[:, None, :-1] - right[None, :, :-1]) ** 2
    within = inside.sum(axis=2)
    low = within + (left[:, None, -1] - right[None, :, -1]) ** 2
    high = within + (left[:, None, -1] + right[None, :, -1]) ** 2
    room = SLACK * ((left**2).sum(axis=1)[:, None] + (right**2).sum(axis=1)[None, :] + 1.0)
    return np.maximum(low - room, 0.0), high + room


def nearest(rows, apexes, centroids, simplex):
    """(cluster, squared distance, number of centroids compared) of each vector; ties to the smaller number."""
    import numpy as np

    centroids = np.asarray(centroids, dtype=np.int64)
    low, high = bounds(apexes, simplex.apexes(simplex.distances(centroids)))
    open_ = low <= high.min(axis=1)[:, None]
    every = np.arange(len(rows))
    cluster = low.argmin(axis=1).astype(np.int32)  # the likeliest first: its distance rules out more than any bound
    best = ((rows - centroids[cluster]) ** 2).sum(axis=1)
    compared = np.ones(len(rows), dtype=np.int64)
    open_[every, cluster] = False
    for j in range(len(centroids)):
        at = np.flatnonzero(open_[:, j] & (low[:, j] <= best))
        d = ((rows[at] - centroids[j]) ** 2).sum(axis=1)
        compared[at] += 1
        better = (d < best[at]) | ((d == best[at]) & (j < cluster[at]))
        best[at[better]], cluster[at[better]] = d[better], j
    return cluster, best, compared


def _arrays(batch: pa.RecordBatch, name: str, kind):
    import numpy as np

    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0), dtype=kind)


def with_apexes(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """(key, v, apex): the cached projection of every vector, where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                apex = simplex.apexes(simplex.distances(_arrays(batch, "v", "int64")))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(apex))], ["key", "v", "apex"])

    return vectors.mapInArrow(run, "key long, v array<int>, apex array<double>")


def assigned(cached: DataFrame, centroids: list[list[int]], simplex: Simplex) -> DataFrame:
    """(key, cluster, distance, compared): nearest centroids by squared distance, and how many were compared exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = nearest(_arrays(batch, "v", "int64"), _arrays(batch, "apex", "float64"), centroids, simplex)
                columns = [batch.column(0), pa.array(found[0], pa.int32()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "cluster", "distance", "compared"])

    return cached.mapInArrow(run, "key long, cluster int, distance long, compared long")


def _sums(cached: DataFrame, centroids: list[list[int]], simplex: Simplex) -> DataFrame:
    """(cluster, n, compared, s array<decimal>): exact sums of the vectors nearest to each centroid.

    A task adds up its own vectors; a cluster moves as one row of each task.
    """
    width, k = len(centroids[0]), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # 2^25 a component: 2^37 vectors in a task fit 64 bits
        sums, counts, compared = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                rows = _arrays(batch, "v", "int64")
                cluster, _, looked = nearest(rows, _arrays(batch, "apex", "float64"), centroids, simplex)
                np.add.at(sums, cluster, rows)
                counts += np.bincount(cluster, minlength=k)
                compared += np.bincount(cluster, weights=looked, minlength=k).astype(np.int64)
        some = np.flatnonzero(counts)
        columns = [pa.array(some, pa.int32()), pa.array(counts[some]), pa.array(compared[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "compared", "s"])

    parts = cached.mapInArrow(run, "cluster int, n long, compared long, s array<long>")
    total: list[Column] = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("compared").alias("compared"), *total)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, pivots: int = PIVOTS, seed: int = 2) -> tuple[DataFrame, list[list[int]], list[float]]:
    """Labels (key, cluster, distance, compared), final centroids, and the share of centroids compared in each round.

    ``vectors`` is (key, v array<int>), one row per vector of equal widths; repeats take part as rows of their own. The first
    centroids are ``first_by_hash``; the first ``pivots`` of them are the pivots. A round assigns every vector and moves each
    centroid that has any to the floored mean; others stay. Fewer vectors than ``k`` give fewer centroids; an empty table gives
    no labels. Only ``k`` rows of sums reach the driver in a round.
    """
    stored = checkpointed(vectors)
    centroids = first_by_hash(stored, k, seed)
    if not centroids:
        return stored.selectExpr("key", "0 as cluster", "0L as distance", "0L as compared").limit(0), [], []
    simplex = Simplex(centroids[:pivots])
    cached = checkpointed(with_apexes(stored, simplex))
    shares = []
    for _ in range(rounds):
        moved, seen, compared = list(centroids), 0, 0
        for row in _sums(cached, centroids, simplex).collect():
            moved[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(len(centroids[0]))]
            seen, compared = seen + row["n"], compared + row["compared"]
        shares.append(compared / (seen * len(centroids)))
        centroids = moved
    return checkpointed(assigned(cached, centroids, simplex)), centroids, shares


def cluster_report(vectors: DataFrame, k: int = 40, rounds: int = 5, pivots: int = PIVOTS, seed: int = 2) -> DataFrame:
    """``cluster`` with the inertia of each cluster and of all, and a digest of each final centroid.

    (key, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared).
    """
    import hashlib

    labels, centroids, _ = cluster(vectors, k, rounds, pivots, seed)
    spark = vectors.sparkSession
    digests = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    by_cluster = labels.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # a row per cluster: k at most
    known = by_cluster.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    known = known.crossJoin(labels.agg(F.sum("distance").alias("inertia")))
    found = labels.join(F.broadcast(known), "cluster")
    return found.select("key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
