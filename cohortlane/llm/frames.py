"""Shared plumbing: text through Arrow batches, case folding, ranks without a single-task window."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from cohortlane.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = " \t\n\x0b\x0c\r"
ROWS = 512


def per_text(df: DataFrame, keep: Sequence[str], text: str, add: StructType, factory: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """Columns computed from a text column, batch by batch.

    ``factory`` is called once in every task and returns a function from ``ROWS`` texts at most
    (nulls included) to one list per column of ``add``. Columns of ``df`` not in ``keep`` are
    not read. A text column that is itself kept goes to the workers once.
    """
    keep = list(keep)
    once = text in keep and df.select(F.col(f"`{text}`")).schema[0].dataType == StringType()
    body = text if once else "__text"
    plain = df.select(*[F.col(f"`{k}`") for k in keep], *([] if once else [F.col(f"`{text}`").cast("string").alias(body)]))
    schema = StructType([plain.schema[k] for k in keep] + list(add))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = factory()
        types = None
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, len(whole), ROWS)):
            types = types or arrow_types(add)
            found = compute(batch.column(body).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array(found[f.name], types[f.name]) for f in add], names=[*keep, *add.names]
            )

    return plain.mapInArrow(run, schema)


def arrow_types(schema: StructType) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema}


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does the same on pure ASCII and is much faster there than ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """Pin ``df`` and add ``part``, its task, and ``nth``, the row's number under its ``key`` there."""
    schema = StructType([*df.schema, StructField("part", LongType()), StructField("nth", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), {}
        for batch in batches:
            nth = []
            for value in batch.column(key).to_pylist():
                n = held.get(value, 0)
                held[value] = n + 1
                nth.append(n)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * len(nth), pa.int64()), pa.array(nth, pa.int64())], names=[*batch.schema.names, "part", "nth"]
            )

    return written(df.mapInArrow(run, schema), "numbered")


def ranked_within(df: DataFrame, key: str, rank: str) -> DataFrame:
    """Number the rows of every ``key`` from 0, whatever share of the rows a key has.

    ``key`` must take few values (lengths, room left), so that the counts held by task are few.
    Rows are numbered where they lie; only one count per task and key is shuffled.
    """
    placed = numbered(df, key)
    held = placed.groupBy(key, "part").agg(F.count("*").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = held.select(key, "part", F.coalesce(ahead, F.lit(0)).alias("base"))
    return placed.join(bases, [key, "part"]).withColumn(rank, F.col("base") + F.col("nth")).drop("base", "part", "nth")
