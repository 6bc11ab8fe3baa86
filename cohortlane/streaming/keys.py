"""Stored keys by hash bucket, with a Bloom filter per bucket and batch."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlane.session import written

BUCKETS = 256
#: Bits of a filter per key, and places that each key sets: about 1 in 70 strange keys looks known.
BITS_PER_KEY = 16
PLACES = 2
#: Bits of one bitmap, as the engine's bitmap functions have them.
BITMAP = 32_768


def key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def filter_places(key: Column, bitmaps: Column) -> Column:
    """The bits of a key in a filter of so many bitmaps: pairs of bitmap and bit."""
    places = [F.pmod(F.xxhash64(F.lit(i + 1), key), bitmaps.cast("long") * BITMAP) for i in range(PLACES)]
    return F.array(*(F.struct(F.floor(p / BITMAP).cast("int").alias("bitmap"), (p % BITMAP).cast("int").alias("bit")) for p in places))


def bit_is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.call_function("getbit", byte, bit % 8) == 1


class KeyIndex:
    """The keys of a store, for asking which keys of a batch it has without reading them all.

    Every batch adds its keys, dealt to ``BUCKETS`` folders by hash, and one filter per bucket, as
    large as its keys need. A question looks its keys up in the filters; only buckets of batches in
    which a key may be are opened. Each batch of a run has folders of its own, so that one that runs
    again replaces what it wrote itself, and does not see it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.keys, self.filters = spark, f"{folder.rstrip('/')}/keys", f"{folder.rstrip('/')}/filters"

    def exists(self) -> bool:
        return self._filters() is not None

    def _filters(self) -> DataFrame | None:
        layout = "bucket int, bitmaps int, bitmap int, bits binary, run string, batch long"
        try:
            return self.spark.read.schema(layout).parquet(self.filters)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def add(self, keys: DataFrame, run: str, batch: int) -> None:
        """Add the keys of the one column of ``keys``; null is no key, repeated ones count once."""
        own, name = f"run={run}/batch={batch}", keys.columns[0]
        plain = keys.select(F.col(f"`{name}`").alias("key")).filter("key IS NOT NULL").distinct().withColumn("bucket", key_bucket(F.col("key")))
        plain.repartition("bucket").sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.keys}/{own}")
        if plain.isEmpty():
            return
        held = self.spark.read.schema(T.StructType([plain.schema["key"], plain.schema["bucket"]])).parquet(f"{self.keys}/{own}")
        sizes = held.groupBy("bucket").agg(F.ceil(F.count("*") * BITS_PER_KEY / BITMAP).cast("int").alias("bitmaps"))
        placed = held.join(sizes, "bucket").select("bucket", "bitmaps", F.inline(filter_places(F.col("key"), F.col("bitmaps"))))
        maps = placed.groupBy("bucket", "bitmaps", "bitmap").agg(F.bitmap_construct_agg(F.col("bit")).alias("bits"))
        maps.write.mode("overwrite").parquet(f"{self.filters}/{own}")

    def suspects(self, asked: DataFrame, run: str, batch: int) -> DataFrame | None:
        """``key``, ``run``, ``batch`` and ``bucket`` of asked keys that the filters do not rule out; None without filters."""
        filters = self._filters()
        if filters is None:
            return None
        others = filters.filter(~((F.col("run") == run) & (F.col("batch") == batch)))
        plain = asked.select(F.col(f"`{asked.columns[0]}`").alias("key")).filter("key IS NOT NULL").distinct().withColumn("bucket", key_bucket(F.col("key")))
        sizes = others.select("run", "batch", "bucket", "bitmaps").distinct()
        probes = plain.join(sizes, "bucket").select("key", "run", "batch", "bucket", F.inline(filter_places(F.col("key"), F.col("bitmaps"))))
        met = probes.join(others.drop("bitmaps"), ["run", "batch", "bucket", "bitmap"]).filter(bit_is_set(F.col("bits"), F.col("bit")))
        # A key's places may fall together, so the bits met are counted against those looked for.
        wanted = probes.groupBy("key", "run", "batch", "bucket").agg(F.count_distinct("bitmap", "bit").alias("wanted"))
        found = met.groupBy("key", "run", "batch", "bucket").agg(F.count_distinct("bitmap", "bit").alias("found"))
        return written(wanted.join(found, ["key", "run", "batch", "bucket"]).filter("found = wanted").drop("found", "wanted"), "suspects")

    def opened(self, suspects: DataFrame) -> list[str]:
        """The folders that may hold a suspect: at most one per bucket and batch, as in any listing of files."""
        places = suspects.select("run", "batch", "bucket").distinct().orderBy("run", "batch", "bucket").collect()
        return [f"{self.keys}/run={p['run']}/batch={p['batch']}/bucket={p['bucket']}" for p in places]

    def known(self, asked: DataFrame, run: str, batch: int) -> DataFrame:
        """The keys of the one column of ``asked`` that batches but this one have stored, each once."""
        name = asked.columns[0]
        suspects = self.suspects(asked, run, batch)
        folders = [] if suspects is None else self.opened(suspects)
        if not folders:
            return self.spark.createDataFrame([], asked.schema)
        held = self.spark.read.schema(T.StructType([suspects.schema["key"]])).parquet(*folders)
        return suspects.select("key").distinct().join(held, "key", "left_semi").withColumnRenamed("key", name)
