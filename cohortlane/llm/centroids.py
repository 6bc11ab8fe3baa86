"""Exact integer k-means on dictionary-encoded dimension blocks.

Vectors are encoded once, in chunks. A chunk cuts its dimensions into blocks and keeps, for each
block, the distinct subvectors (the dictionary) and one code per vector. Nothing is lost: the
dictionary holds the integers themselves. Neighbouring blocks are joined to longer ones as long as
the joined dictionary stays well below the number of vectors, so data with few distinct values,
repeated vectors or repeated parts get long blocks, and other data get short ones.

A round looks at no vector. It computes the exact squared distance of every dictionary entry to the
centroids' parts once, sums these partial distances by code, and counts how often each cluster holds
each code: the clusters' sums are those counts times the dictionary. What leaves a task is one
number per cluster and dimension. A chunk's dictionary is bounded by its rows, so nothing that grows
with the data is broadcast or held: the centroids are all that goes to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from cohortlane.session import written

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
FACTOR = 1024
#: Vectors of a chunk; codes are 16 bits wide.
CHUNK = 16_384
#: A joined dictionary has at most one entry per so many vectors.
SHARE = 2
#: Beyond this a squared distance of 64 components may not fit 64 bits.
LARGEST = 1 << 27


def integer_vectors(values: pa.Array, dimensions: int, factor: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list array are kept, and floor(factor * component) of these, a row each."""
    lengths = values.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fitting = np.flatnonzero(lengths == dimensions)
    flat = values.take(pa.array(fitting)).flatten()
    found = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # nulls become NaN
    sound = np.isfinite(found).all(axis=1)
    scaled = np.floor(factor * found[sound])
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise OverflowError(f"a component beyond {LARGEST / factor:g}: its squared distances may not fit 64 bits")
    kept = np.zeros(len(lengths), bool)
    kept[fitting[sound]] = True
    return kept, scaled.astype(np.int64)


def encode_blocks(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(dictionary, codes) of every block: entries are distinct subvectors, ``dictionary[codes]`` gives the block back."""
    blocks = []
    for place in range(vectors.shape[1]):
        values, codes = np.unique(vectors[:, place], return_inverse=True)
        blocks.append((values[:, None], codes))
    most = max(1, len(vectors) // SHARE)
    while len(blocks) > 1:
        joined, changed = [], False
        for i in range(0, len(blocks), 2):
            if i + 1 == len(blocks):
                joined.append(blocks[i])
                continue
            (left, a), (right, b) = blocks[i], blocks[i + 1]
            pairs, codes = np.unique(a * len(right) + b, return_inverse=True)
            if len(pairs) <= most:
                joined.append((np.concatenate([left[pairs // len(right)], right[pairs % len(right)]], axis=1), codes))
                changed = True
            else:
                joined += blocks[i : i + 2]
        blocks = joined
        if not changed:
            break
    return blocks


@dataclass
class Chunk:
    """The blocks of one encoded chunk."""

    blocks: list[tuple[np.ndarray, np.ndarray]]
    rows: int

    @classmethod
    def read(cls, rows: int, widths: list[int], sizes: list[int], dictionary: bytes, codes: bytes) -> Chunk:
        entries, places = np.frombuffer(dictionary, "<i4").astype(np.int64), np.frombuffer(codes, "<u2").reshape(len(widths), rows)
        blocks, at = [], 0
        for block, (width, size) in enumerate(zip(widths, sizes)):
            blocks.append((entries[at : at + width * size].reshape(size, width), places[block]))
            at += width * size
        return cls(blocks, rows)

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of every vector, the smaller number among equals, and the squared distance."""
        total = np.zeros((self.rows, len(centroids)), np.int64)
        at = 0
        for entries, codes in self.blocks:
            part = centroids[:, at : at + entries.shape[1]]
            at += entries.shape[1]
            partial = ((entries[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)  # once per entry
            total += partial[codes]
        clusters = total.argmin(axis=1)
        return clusters, total[np.arange(self.rows), clusters]

    def sums(self, clusters: np.ndarray, k: int) -> np.ndarray:
        """The sum of every cluster's vectors, from counts of codes."""
        found = []
        for entries, codes in self.blocks:
            held = np.bincount(clusters * len(entries) + codes, minlength=k * len(entries)).reshape(k, len(entries))
            found.append(held @ entries)
        return np.concatenate(found, axis=1)


def encoded(df: DataFrame, key: str, vector: str, dimensions: int, factor: int, clusters: int, seed: int) -> DataFrame:
    """One row per chunk: ``ids``, its blocks, and in ``starts`` its rows with the smallest seeded hashes."""
    ids = df.schema[key].dataType
    start = StructType([StructField("hash", StringType()), StructField("components", ArrayType(LongType()))])
    schema = StructType([
        StructField("ids", ArrayType(ids)),
        StructField("widths", ArrayType(IntegerType())),
        StructField("sizes", ArrayType(IntegerType())),
        StructField("dictionary", BinaryType()),
        StructField("codes", BinaryType()),
        StructField("starts", ArrayType(start)),
    ])
    plain = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{key}`").cast("string").alias("told"), F.col(f"`{vector}`").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        layout = to_arrow_schema(schema)
        held_ids, held_names, held_vectors = [], [], []

        def flush() -> pa.RecordBatch:
            vectors, names = np.concatenate(held_vectors), [n for part in held_names for n in part]
            hashes = [hashlib.sha256(f"{seed}:{name}".encode()).hexdigest() if name is not None else "~" for name in names]
            first = sorted(zip(hashes, range(len(names))))[:clusters]
            if len(names) > clusters:  # rows with the last hash of these compete by their components
                last = first[-1][0]
                first = [(h, i) for i, h in enumerate(hashes) if h <= last]
            starts = sorted({(h, tuple(vectors[i].tolist()), i) for h, i in first})[:clusters]
            blocks = encode_blocks(vectors)
            row = {
                "ids": pa.concat_arrays(held_ids).to_pylist(),
                "widths": [entries.shape[1] for entries, _ in blocks],
                "sizes": [len(entries) for entries, _ in blocks],
                "dictionary": b"".join(entries.astype("<i4").tobytes() for entries, _ in blocks),
                "codes": b"".join(codes.astype("<u2").tobytes() for _, codes in blocks),
                "starts": [{"hash": h, "components": list(v)} for h, v, _ in starts],
            }
            held_ids.clear(), held_names.clear(), held_vectors.clear()
            return pa.RecordBatch.from_pylist([row], schema=layout)

        size = 0
        for batch in (whole.slice(i, CHUNK) for whole in batches for i in range(0, len(whole), CHUNK)):
            kept, vectors = integer_vectors(batch.column("vector"), dimensions, factor)
            if size + len(vectors) > CHUNK:
                yield flush()
                size = 0
            if len(vectors):
                chosen = batch.filter(pa.array(kept))
                held_ids.append(chosen.column("id"))
                held_names.append(chosen.column("told").to_pylist())
                held_vectors.append(vectors)
                size += len(vectors)
        if size:
            yield flush()

    return plain.mapInArrow(run, schema)


def chunks_of(batch: pa.RecordBatch) -> Iterator[tuple[Chunk, pa.Array | None]]:
    for i in range(len(batch)):
        widths, sizes, dictionary, codes = (batch.column(c)[i].as_py() for c in ("widths", "sizes", "dictionary", "codes"))
        ids = batch.column("ids")[i].values if "ids" in batch.schema.names else None
        yield Chunk.read(len(codes) // 2 // len(widths), widths, sizes, dictionary, codes), ids


PARTS = ("widths", "sizes", "dictionary", "codes")


def assigned_sums(chunks: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, sum of vectors and sum of distances of every cluster; one number each per task, added by Spark."""
    k, dimensions = centroids.shape
    schema = StructType([StructField("cluster", IntegerType()), StructField("place", IntegerType()), StructField("total", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dimensions + 2), np.int64)
        for batch in batches:
            for chunk, _ in chunks_of(batch):
                clusters, distances = chunk.nearest(centroids)
                total[:, 0] += np.bincount(clusters, minlength=k)
                np.add.at(total[:, 1], clusters, distances)
                total[:, 2:] += chunk.sums(clusters, k)
        at = np.argwhere(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array(total[at[:, 0], at[:, 1]])], names=schema.names)

    found = np.zeros((k, dimensions + 2), object)
    for row in chunks.select(*PARTS).mapInArrow(run, schema).groupBy("cluster", "place").agg(F.sum("total").alias("total")).collect():
        found[row.cluster, row.place] = row.total
    return found[:, 0], found[:, 2:], found[:, 1]


def first_centroids(chunks: DataFrame, clusters: int) -> np.ndarray:
    best = chunks.select(F.inline("starts")).orderBy("hash", "components").limit(clusters).collect()
    return np.asarray([row.components for row in best], np.int64)


def moved(centroids: np.ndarray, held: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """floor(sum / count) of every component; empty clusters stay."""
    after = centroids.copy()
    for cluster in range(len(centroids)):
        if held[cluster]:
            after[cluster] = [int(total) // int(held[cluster]) for total in sums[cluster]]
    return after


def centroid_clusters(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, factor: int = FACTOR) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every kept vector.

    Kept are vectors of exactly ``dimensions`` components, none null or non-finite; other rows, null
    vectors among them, are not in the result. A component x becomes floor(``factor`` * x), x as
    double, and all that follows is exact integer arithmetic; a component too large for squared
    distances in 64 bits raises. The first centroids are the ``clusters`` rows with the smallest
    sha256 of ``seed:key``, in that order. Rows with equal keys are vectors of their own, among the
    first centroids too, in the order of their components; null keys come after all others. With
    fewer kept rows than ``clusters`` there are as many clusters as rows, and an empty table gives no
    rows. Vectors go to the nearest centroid, the smaller number among equals, in each of ``rounds``
    rounds and once more at the end. Other columns are not read.
    """
    chunks = written(encoded(df, key, vector, dimensions, factor, clusters, seed), "encoded")
    centroids = first_centroids(chunks, clusters)
    schema = StructType([
        StructField(key, df.schema[key].dataType),
        StructField("cluster", IntegerType()),
        StructField("distance", LongType()),
        StructField("cluster_inertia", LongType()),
        StructField("inertia", LongType()),
        StructField("centroid_sha256", StringType()),
    ])
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        held, sums, _ = assigned_sums(chunks, centroids)
        after = moved(centroids, held, sums)
        if (after == centroids).all():  # nothing moves any more, in no later round either
            break
        centroids = after
    inertia = [int(n) for n in assigned_sums(chunks, centroids)[2]]
    hashes = np.asarray([hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, whole = np.asarray(inertia, np.int64), sum(inertia)
        for batch in batches:
            for chunk, ids in chunks_of(batch):
                nearest, distances = chunk.nearest(centroids)
                columns = [ids, nearest.astype(np.int32), distances, own[nearest], np.full(chunk.rows, whole), hashes[nearest]]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return chunks.select("ids", *PARTS).mapInArrow(run, schema)
