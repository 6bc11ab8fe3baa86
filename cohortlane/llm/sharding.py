"""Shuffled shards by a two-pass external shuffle.

The first pass scatters whole records by seeded hashes: a consistent hash of the key picks the
shard, and a second hash picks one of the shard's buckets, as many as keep a bucket in a task's
memory. The second pass takes one bucket per task, shuffles it by Fisher-Yates and writes it. Slots
go on from bucket to bucket of a shard. The consistent hash depends on the key and the number of
shards alone, and one more shard takes rows only into itself.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from cohortlane.session import shared_folder

OVERHEAD = 16
BUCKET_BYTES = 64 << 20


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys: a key moves only into a shard that is new.

    The multiplier is the fixed value of the published method.
    """
    keys = keys.copy()
    place = np.zeros(len(keys), np.int64)
    jump = np.zeros(len(keys), np.int64)
    open_ = np.arange(len(keys))
    while len(open_):
        place[open_] = jump[open_]
        keys[open_] = keys[open_] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (keys[open_] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[open_] = ((place[open_] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        open_ = open_[jump[open_] < shards]
    return place


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation of ``n`` places."""
    order = list(range(n))
    swaps = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    for i in range(n - 1, 0, -1):
        j = swaps[i]
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, np.int64)


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The struct of ``now``, the key's shard, and ``grown``, its shard if there were one more."""

    @F.pandas_udf(StructType([StructField("now", IntegerType()), StructField("grown", IntegerType())]))
    def place(keys: pd.Series) -> pd.DataFrame:
        unsigned = keys.to_numpy(np.int64).view(np.uint64)
        return pd.DataFrame({"now": jump_hash(unsigned, shards), "grown": jump_hash(unsigned, shards + 1)})

    return place(F.xxhash64(F.lit(seed), key))


def write_shards(
    df: DataFrame, path: str | None = None, shards: int = 40, seed: int = 7, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """Write the records as shuffled shards and return ``key``, ``size``, ``text_crc32``, ``shard``, ``slot``, ``grown_shard``.

    The files lie under ``path``, one folder per shard, with all columns of ``df`` under ``record``;
    by default they go to the shared folder. ``size`` is the bytes of the text and 16 more; null
    and empty texts have none. Rows with equal keys share a shard, rows with a null key too; equal
    texts are told apart by key. An empty table gives no rows.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/cohortlane/shards-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    sized = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record"), F.col(f"`{key}`").alias("__id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size")
    )
    total = df.select(F.sum(F.octet_length(body) + OVERHEAD).alias("n")).first().n or 0
    split = max(1, -(-int(total) // (shards * bucket_bytes)))
    placed = sized.withColumn("placed", shard_of(F.col("__id"), shards, seed))
    places = placed.select(*sized.columns, F.col("placed.now").alias("shard"), F.col("placed.grown").alias("grown_shard"))
    inner = F.pmod(F.xxhash64(F.lit(seed + 1), "__id", F.col(f"record.`{text}`")), F.lit(split)).cast("int")
    scattered = places.withColumn("bucket", F.col("shard") * split + inner).repartitionById(shards * split, F.col("bucket")).sortWithinPartitions("bucket", "__id", "size")
    schema = StructType([f for f in scattered.schema if f.name != "__id"] + [StructField("text_crc32", LongType()), StructField("place", LongType())])

    def shuffled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        bucket = None

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            order = fisher_yates(len(table), np.random.default_rng([seed, bucket]))
            for begin in range(0, len(order), 1024):
                part = table.take(pa.array(order[begin : begin + 1024]))
                texts = part.column("record").combine_chunks().field(text).to_pylist()
                crc = [zlib.crc32((t if isinstance(t, str) else "" if t is None else str(t)).encode("utf-8")) for t in texts]
                part = part.drop_columns(["__id"]).append_column("text_crc32", pa.array(crc, pa.int64()))
                yield from part.append_column("place", pa.array(range(begin, begin + len(crc)), pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            of = batch.column("bucket").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if bucket is not None and of[a] != bucket:
                    yield from flush()
                    held = []
                bucket = int(of[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from flush()

    scattered.mapInArrow(shuffled, schema).write.partitionBy("shard").parquet(path)
    files = spark.read.schema(schema).parquet(path)
    lengths = files.groupBy("shard", "bucket").agg(F.count("*").alias("held"))
    ahead = F.sum("held").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = lengths.select("bucket", F.coalesce(ahead, F.lit(0)).alias("base"))
    return files.join(bases, "bucket").select(
        F.col(f"record.`{key}`").alias(key), "size", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot"), "grown_shard"
    )
