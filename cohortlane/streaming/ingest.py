"""New sample files in a folder, appended once each."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cohortlane.functions.values import named
from cohortlane.operators.constraints import key_violations
from cohortlane.streaming.keys import KeyIndex


def sample_file_stream(spark: SparkSession, folder: str, schema: T.StructType | str, sep: str = ",") -> DataFrame:
    """Rows of csv files as they arrive, with the ``file_name`` they came in."""
    rows = spark.readStream.schema(schema).option("header", True).option("sep", sep).option("nullValue", "NA").csv(folder)
    return rows.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"))


def append_new_files(stream: DataFrame, key: str, target: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Append every new file to ``target`` and refused rows to ``rejected``.

    A file is skipped when its name was taken already, and of equal names in one batch the
    smallest path is kept. Rows are refused when their key is null, repeated in the batch or
    stored already, which an index beside the target, ``<target>_index``, tells without reading all
    that is stored; a target without one gets it first. What is stored decides, not the checkpoint: with a fresh checkpoint the
    target is appended to. Every batch of a checkpoint has a folder of its own, so a batch that
    is run again after a failure replaces what it wrote itself and nothing else. Taken names
    stand in a small table beside the target, ``<target>_files``.
    """
    schema = stream.schema
    names = f"{target.rstrip('/')}_files"
    place = f"{target.rstrip('/')}_index"

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = _run_of(spark, checkpoint)
        own = f"run={run}/batch={batch_id}"
        taken = _stored(spark, names, T.StructType([schema["file_name"]]), run, batch_id)
        fresh = batch.groupBy("file_name").agg(F.min("file_path").alias("file_path"))
        kept = fresh.join(taken.select("file_name").distinct(), "file_name", "left_anti").persist()
        rows = batch.join(kept, ["file_name", "file_path"], "left_semi")
        repeated = key_violations(rows, key).select(named(key).alias("refused_key"))
        asked = rows.select(named(key).alias("refused_key")).filter("refused_key IS NOT NULL").distinct()
        index = KeyIndex(spark, place)
        if not index.exists():
            index.add(_stored(spark, target, schema, run, batch_id).select(named(key).alias("key")), "before", 0)
        refused_keys = repeated.unionByName(index.known(asked, run, batch_id)).filter("refused_key IS NOT NULL").distinct()
        # Rows without a key need no join; together they would all meet in one task.
        marked = rows.filter(named(key).isNotNull()).select(F.struct("*").alias("row"), named(key).alias("row_key"))
        marked = marked.join(refused_keys, F.col("row_key") == F.col("refused_key"), "left")
        unkeyed = rows.filter(named(key).isNull()).select(F.struct("*").alias("row"), F.lit(True).alias("refused"))
        told = marked.select("row", F.col("refused_key").isNotNull().alias("refused")).unionByName(unkeyed).persist()
        try:
            for wanted, folder in (("NOT refused", target), ("refused", rejected)):
                told.filter(wanted).select("row.*").write.mode("overwrite").parquet(f"{folder}/{own}")
            index.add(told.filter("NOT refused").select(F.col("row").getField(key).alias("key")), run, batch_id)
            kept.select("file_name").write.mode("overwrite").parquet(f"{names}/{own}")
        finally:
            told.unpersist()
            kept.unpersist()

    return (
        stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that lives and dies with the checkpoint: kept inside it, made when it is not there."""
    place = f"{checkpoint.rstrip('/')}/run_name"
    try:
        return spark.read.schema("name string").parquet(place).first()["name"]
    except (AnalysisException, TypeError):  # no such folder, or a write that was cut off
        spark.createDataFrame([(uuid.uuid4().hex,)], "name string").write.mode("overwrite").parquet(place)
        return spark.read.schema("name string").parquet(place).first()["name"]


def _stored(spark: SparkSession, folder: str, schema: T.StructType, run: str, batch_id: int) -> DataFrame:
    """What is stored in ``folder``, but for what this very batch wrote before it failed."""
    wanted = T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])
    try:
        stored = spark.read.schema(wanted).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    this = (F.coalesce("run", F.lit("")) == run) & (F.coalesce("batch", F.lit(-1)) == batch_id)
    return stored.filter(~this).drop("run", "batch")
