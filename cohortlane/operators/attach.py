"""Joining one-row-per-key facts to many rows, whatever share of the rows a key has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.times import own_prefix


def attach(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, spread_by: list[Column], how: str = "left") -> DataFrame:
    """Join ``facts`` to ``rows`` on ``on``, cutting heavy keys into even slices.

    ``weight`` names the column of ``facts`` with the number of rows per key, so the heavy
    keys are known exactly. A key above one shuffle partition's share of the rows is cut
    into as many slices as it has shares. At most ``spark.sql.shuffle.partitions`` keys can
    be above that share, which bounds the broadcast list of heavy keys, and at most twice
    as many copies of facts arise. Null keys match null keys and are cut like any other. ``spread_by`` must tell the rows of one key apart. Hand in
    facts that are written already, since they are read three times here.
    """
    shares = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = facts.agg(F.sum(weight)).scalar()
    own = own_prefix(rows)
    slice_, slices = own + "slice", own + "slices"
    keys = {name: f"{own}key{i}" for i, name in enumerate(on)}
    cut = facts.withColumn(slices, F.ceil(F.col(weight) * shares / total).cast("int"))
    cut = cut.withColumnsRenamed(keys)

    def same(left: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, (left[name].eqNullSafe(F.col(key)) for name, key in keys.items()))

    heavy = cut.select(*keys.values(), slices).filter(F.col(slices) > 1)
    places = F.when(F.col(slices) > 1, F.sequence(F.lit(0), F.col(slices) - 1)).otherwise(F.array(F.lit(0)))
    copies = cut.withColumn(slice_ + "_of", F.explode(places)).drop(slices, weight)
    number = F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col(slices)).cast("int"), F.lit(0))
    spread = rows.join(F.broadcast(heavy), same(rows), "left").withColumn(slice_, number).drop(*keys.values(), slices)
    return spread.join(copies, same(spread) & (F.col(slice_) == F.col(slice_ + "_of")), how).drop(*keys.values(), slice_, slice_ + "_of")
