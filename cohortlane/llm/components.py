"""Connected components of edges that no task has to hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cohortlane.session import written

EDGE = StructType([StructField("a", LongType()), StructField("b", LongType())])
#: Edges that a task folds at a time.
PORTION = 500_000


def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges as stars: each node with the smallest one it reaches among them."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    least = np.arange(len(nodes))
    while True:  # hooking and pointer jumping; sorted nodes, so the smallest place is the smallest node
        low = np.minimum(least[left], least[right])
        before = least.copy()
        np.minimum.at(least, least[left], low)
        np.minimum.at(least, least[right], low)
        least = least[least]
        if (least == before).all() and (least[left] == least[right]).all():
            break
    away = least != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[away]), pa.array(nodes[least[away]])], names=["a", "b"])


def folded_portions(portions: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Stars of a task's edges, which come as arrays of two rows, ``PORTION`` of them at a time."""
    held: list[np.ndarray] = []
    size = 0
    for edges in portions:
        held.append(edges)
        size += edges.shape[1]
        if size >= PORTION:
            yield stars(*np.concatenate(held, 1))
            held, size = [], 0
    if size:
        yield stars(*np.concatenate(held, 1))


def folded(edges: DataFrame) -> DataFrame:
    """The edges of every portion of a task as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folded_portions(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]) for batch in batches)

    return edges.select("a", "b").mapInArrow(run, EDGE)


def hung_lower(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One star step: the neighbours of a node, larger or not larger than it, go to the least of them."""
    if larger_only:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("least"))
        near = edges.join(least, "a")
        moved = near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def with_roots(hung: DataFrame) -> DataFrame:
    roots = hung.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return hung.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def connected(edges: DataFrame, fold: bool = True) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, of every node that has an edge to another.

    Edges ``a``, ``b`` may repeat, lead back and form long chains. They are folded within tasks
    first. If no more than one portion is left, one more fold ends it; else larger and smaller star
    steps alternate until nothing moves, a number of rounds that grows with the logarithm of the
    number of nodes. Each round is written to the shared folder. Without ``fold`` the edges are the
    stars of ``folded_portions`` already.
    """
    straight = folded(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")) if fold else edges
    hung, state = written(straight.distinct(), "stars"), None
    if hung.count() <= PORTION:  # what any task folds at a time
        return with_roots(written(folded(hung.repartition(1)), "stars"))
    while True:
        after = hung.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if after == state or not after[0]:
            return with_roots(hung)
        state = after
        hung = written(hung_lower(written(hung_lower(hung, True), "larger"), False), "stars")
