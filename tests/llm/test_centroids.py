"""Exact k-means against a plain one, on odd and on skewed rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from cohortlane.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, distance int"


def brute(rows, dimensions, clusters, rounds, seed=3, factor=1024):
    """(id, cluster, distance) of every kept row, the clusters' inertia and their hashes, in whole numbers."""
    kept = []
    for i, vector in rows:
        if vector is not None and len(vector) == dimensions and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((i, tuple(math.floor(factor * float(np.float32(x))) for x in vector)))
    told = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    centres = [list(v) for _, v in told[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        found = [nearest(v)[1] for _, v in kept]
        for n in range(len(centres)):
            own = [v for (_, v), c in zip(kept, found) if c == n]
            if own:
                centres[n] = [sum(column) // len(own) for column in zip(*own)]
    final = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {n: sum(d for _, c, d in final if c == n) for n in range(len(centres))}
    shas = {n: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for n, c in enumerate(centres)}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), shas[c]) for i, c, d in final), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def vectors(n, dimensions, seed=1):
    rng = random.Random(seed)
    found = [(i, [rng.gauss(0, 1) for _ in range(dimensions)]) for i in range(n)]
    found += [(1000 + i, [0.25] * dimensions) for i in range(n // 2)]  # a third of all rows are one vector
    found += [(2000 + i, [round(rng.random() * 3) / 4] + [0.5] * (dimensions - 1)) for i in range(20)]
    found += [(3, found[3][1]), (4, found[5][1]), (None, found[0][1]), (None, found[1][1])]
    odd = [None, [], [1.0] * (dimensions - 1), [1.0] * (dimensions + 1), [None] + [1.0] * (dimensions - 1), [float("nan")] * dimensions, [float("-inf")] + [0.0] * (dimensions - 1)]
    return found + [(5000 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize("dimensions, clusters, rounds", [(64, 8, 10), (5, 3, 4), (1, 2, 3), (6, 1, 2)])
def test_centroid_clusters(spark, dimensions, clusters, rounds, monkeypatch):
    monkeypatch.setattr(centroids, "CHUNK", 37)
    rows = vectors(120, dimensions)
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA).repartition(3)
    found = centroids.centroid_clusters(df, dimensions=dimensions, clusters=clusters, rounds=rounds)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(found) == brute(rows, dimensions, clusters, rounds)


def test_few_rows_and_ties(spark):
    rows = [(7, [1.0, 2.0]), (7, [1.0, 2.0]), (9, [-1.0, 2.0]), (8, [0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    assert got(centroids.centroid_clusters(df, dimensions=2)) == brute(rows, 2, 8, 10)
    assert got(centroids.centroid_clusters(df, dimensions=2, clusters=2, rounds=1)) == brute(rows, 2, 2, 1)
    assert got(centroids.centroid_clusters(df.limit(0), dimensions=2)) == []
    assert got(centroids.centroid_clusters(df, dimensions=64)) == []


def test_text_keys_and_doubles(spark):
    df = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [-0.1, 1e-9]), (None, [3.0, 4.0])], "vec_id string, embedding array<double>")
    found = {r.vec_id: (r.cluster, r.distance) for r in centroids.centroid_clusters(df, dimensions=2, clusters=1, rounds=0).collect()}
    first = min("ab", key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())
    grid = {"a": (102, 204), "b": (-103, 0), None: (3072, 4096)}
    assert found == {i: (0, sum((x - y) ** 2 for x, y in zip(v, grid[first]))) for i, v in grid.items()}


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="may not fit 64 bits"):
        centroids.centroid_clusters(df, dimensions=2).collect()


def test_blocks_are_lossless():
    rng = np.random.default_rng(5)
    free = rng.integers(-50, 50, (400, 6))
    repeated = np.repeat(rng.integers(-(1 << 27), 1 << 27, (20, 7)), 20, axis=0)
    for found, most in ((free, 6), (repeated, 2), (np.zeros((9, 5), np.int64), 1), (free[:1], 6)):
        blocks = centroids.encode_blocks(found)
        assert (np.concatenate([entries[codes] for entries, codes in blocks], axis=1) == found).all()
        assert all(len(np.unique(entries, axis=0)) == len(entries) for entries, _ in blocks)
        assert len(blocks) <= most


def test_partial_distances_and_sums():
    rng = np.random.default_rng(6)
    found = rng.integers(-2000, 2000, (300, 9))
    found[100:200] = found[0]
    chunk = centroids.Chunk(centroids.encode_blocks(found), len(found))
    centres = found[[1, 5, 5, 250]]
    clusters, distances = chunk.nearest(centres)
    plain = ((found[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (distances == plain.min(axis=1)).all() and (clusters == plain.argmin(axis=1)).all()
    assert (chunk.sums(clusters, 4) == np.stack([found[clusters == c].sum(axis=0) for c in range(4)])).all()
