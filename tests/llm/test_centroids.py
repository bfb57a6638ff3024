"""Centroid clustering against brute force on odd rows, ties and copies, and the bounds of the projection."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vakanta.llm import centroids as C


def brute(data, width, k, rounds):
    kept = []
    for key, vector in data:
        if vector is not None and len(vector) == width and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((key, [math.floor(256 * x) for x in vector]))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in set(of):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            of_j = [sum(x) // len(own) for x in zip(*own, strict=True)]
            centres = [*centres[:j], of_j, *centres[j + 1 :]] if own else centres
    return sorted(((key, near(v)[1], near(v)[0]) for key, v in kept), key=str), centres


def vectors(seed, rows, width, spread):
    chance = random.Random(seed)
    places = [[chance.uniform(-1, 1) for _ in range(width)] for _ in range(4)]
    out = []
    for i in range(rows):
        out.append((i, [x + chance.uniform(-spread, spread) for x in places[i % 4]]))
    return out


ODD = [
    (900, None), (901, []), (902, [1.0] * 3), (903, [None] * 6), (904, [float("nan")] * 6), (905, [float("inf")] * 6),
    (None, [0.1] * 6), (None, [0.1] * 6), (906, [-0.0] * 6), (907, [0.25] * 6), (907, [0.25] * 6), (907, [-0.25] * 6),
]


def frame(spark, data):
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    return docs.withColumns({c: F.lit("other") for c in ("key", "v", "apex", "cluster", "distance")}).repartition(3)


@pytest.mark.parametrize(("spread", "pivots", "k"), [(0.05, 3, 7), (1.0, 7, 7), (0.0, 5, 9)])
def test_as_brute_force(spark, spread, pivots, k):
    data = vectors(4, 200, 6, spread) + ODD + [(1000 + i, [0.5] * 6) for i in range(100)]
    labels, centres, shares = C.cluster(C.whole_vectors(frame(spark, data), width=6), k=k, rounds=3, pivots=pivots)
    want, want_centres = brute(data, 6, k, 3)
    assert sorted(((r["key"], r["cluster"], r["distance"]) for r in labels.collect()), key=str) == want
    assert centres == want_centres and len(shares) == 3


def test_fewer_vectors_than_centroids_and_none(spark):
    data = vectors(1, 3, 6, 0.2)
    rows = C.cluster_report(C.whole_vectors(frame(spark, data), width=6)).collect()
    assert sorted(r["key"] for r in rows) == [0, 1, 2] and {r["distance"] for r in rows} == {0} and {r["inertia"] for r in rows} == {0}
    assert C.cluster_report(C.whole_vectors(frame(spark, ODD[:6]), width=6)).collect() == []


def test_components_out_of_range_take_no_part(spark):
    data = [(1, [1e300] * 6), (2, [-2.0**20] * 6), (3, [1.0] * 6)]
    assert [r["key"] for r in C.whole_vectors(frame(spark, data), width=6).collect()] == [3]


def test_bounds_hold_and_few_centroids_are_compared():
    chance = np.random.default_rng(2)
    places = chance.integers(-200, 200, (30, 16))
    rows = (places[chance.integers(0, 30, 500)] + chance.integers(-15, 15, (500, 16))).astype(np.int64)
    for pivots in (places[:1], places[:6], np.vstack([places[:5], places[:5]]), places):
        simplex = C.Simplex(pivots.tolist())
        left, right = simplex.apexes(simplex.distances(rows)), simplex.apexes(simplex.distances(places))
        low, high = C.bounds(left, right)
        true = ((rows[:, None, :] - places[None, :, :]) ** 2).sum(axis=2)
        assert (low <= true).all() and (true <= high).all()
        cluster, distance, compared = C.nearest(rows, left, places, simplex)
        assert (cluster == true.argmin(axis=1)).all() and (distance == true.min(axis=1)).all()
    assert compared.mean() < 3
