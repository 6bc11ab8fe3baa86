"""Many-to-many joins whose keys may be heavy on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.times import own_prefix
from cohortlane.session import written

#: Cells per task's share of the rows, so that where cells meet in a task they even out.
FINE = 4


def key_weights(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``on``, ``n_left`` and ``n_right``: the exact rows of every key of ``left`` on both sides; null keys are keys."""
    sides = left.select(*on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*on, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.groupBy(*on).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).filter("n_left > 0")


def heavy_grid(weights: DataFrame, shares: int) -> DataFrame:
    """Keys above one task's share, with the rows and columns of the grid each is cut into.

    A key makes ``n_left * max(1, n_right)`` rows. It gets ``FINE`` cells for each share that it has of
    all rows made or of all left rows. Cells are about square in rows moved: with the left rows cut into
    ``down`` slices, copied ``across`` times, and the right rows the other way round, the copies are
    fewest when ``down / across`` is ``n_left / n_right``. At most ``2 * FINE * shares`` keys can be heavy.
    """
    made = F.col("n_left") * F.greatest("n_right", F.lit(1))
    totals = weights.agg(F.sum(made).alias("made"), F.sum("n_left").alias("left")).select(F.struct("*")).scalar()
    cells = F.ceil(F.greatest(made * FINE * shares / totals["made"], F.col("n_left") * FINE * shares / totals["left"]))
    across = F.least(F.greatest(F.round(F.sqrt(cells * F.col("n_right") / F.col("n_left"))), F.lit(1)), F.greatest("n_right", F.lit(1))).cast("int")
    cut = weights.withColumns({"cells": cells, "across": across}).filter("cells > 1")
    return cut.withColumn("down", F.least(F.ceil(F.col("cells") / F.col("across")), F.col("n_left")).cast("int"))


def grid_join(left: DataFrame, right: DataFrame, on: list[str], spread_left: list[Column], spread_right: list[Column]) -> DataFrame:
    """Left join on ``on``, nulls matching nulls, heavy keys cut on both sides.

    A heavy key is a grid: each of its left rows lies in one row of the grid and is copied to all its
    columns, each right row lies in one column and is copied to all rows, so every pair meets in one
    cell and no cell holds more than a task's share. Weights are exact and written first. What is
    broadcast is the list of heavy keys, whose length is bounded by the number of shuffle partitions.
    ``spread_left`` and ``spread_right`` must tell the rows of one key apart. The columns of both
    sides come back, ``on`` once; no other names may be shared.
    """
    shares = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own_prefix(left) + own_prefix(right)
    weights = written(key_weights(left, right, on), "weights")
    keys = {name: f"{own}key{i}" for i, name in enumerate(on)}
    heavy = written(heavy_grid(weights, shares).select(*on, "down", "across", (F.col("n_right") > 0).alias("met")), "heavy").withColumnsRenamed(
        {**keys, "down": own + "down", "across": own + "across", "met": own + "met"}
    )

    def same(rows: DataFrame, others: dict[str, str]) -> Column:
        return reduce(lambda a, b: a & b, (rows[name].eqNullSafe(F.col(key)) for name, key in others.items()))

    def cut(rows: DataFrame, slices: str, copies: str, place: str, copy: str, spread: list[Column]) -> DataFrame:
        marked = rows.join(F.broadcast(heavy), same(rows, keys), "left")
        number = F.coalesce(F.pmod(F.xxhash64(*spread), F.col(own + slices)).cast("int"), F.lit(0))
        every = F.when(F.col(own + copies) > 1, F.sequence(F.lit(0), F.col(own + copies) - 1)).otherwise(F.array(F.lit(0)))
        return marked.withColumn(own + place, number).withColumn(own + copy, F.explode(every)).drop(*keys.values(), own + "down", own + "across")

    there = {name: f"{own}right{i}" for i, name in enumerate(on)}
    lefts = cut(left, "down", "across", "i", "j", spread_left)
    rights = cut(right, "across", "down", "j", "i", spread_right).drop(own + "met").withColumnsRenamed({**there, own + "i": own + "ri", own + "j": own + "rj"})
    rights = rights.withColumn(own + "found", F.lit(True))
    joined = lefts.join(rights, same(lefts, there) & (F.col(own + "i") == F.col(own + "ri")) & (F.col(own + "j") == F.col(own + "rj")), "left")
    # A copy of a row of a heavy key may meet no row in its column; another copy does.
    told = joined.filter(F.col(own + "found") | ~F.coalesce(F.col(own + "met"), F.lit(False)))
    return told.drop(*(own + name for name in ("i", "j", "ri", "rj", "met", "found")), *there.values())
