"""Counts and ranges per subject and modality while samples arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortlane.functions.times import TIME, with_time_value
from cohortlane.functions.values import as_text
from cohortlane.operators.reshape import unpivot_available
from cohortlane.spec import StudySpec


def running_ranges(samples: DataFrame, spec: StudySpec) -> DataFrame:
    """Samples, first and last raw time per subject and modality over a stream of samples.

    The time kind must be fixed in the spec, since a stream cannot be looked through first.
    State has one row per subject and modality, so no watermark is needed. Date times stay
    microseconds, as the start of a subject may still move.
    """
    if spec.time_kind is None:
        raise ValueError("a stream needs a spec with a time kind")
    spec = spec.on(samples)
    kept = {"subject": as_text(samples, spec.subject), "time": F.col(TIME)}
    return unpivot_available(with_time_value(samples, spec.time, spec.time_kind, spec.date_order), spec, kept).groupBy("subject", "modality").agg(
        F.count("*").alias("n_samples"), F.min("time").alias("min_time"), F.max("time").alias("max_time")
    )


def write_updates(running: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write the changed rows of every batch to ``target/batch=<n>``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        running.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(updates: DataFrame) -> DataFrame:
    """The newest row per subject and modality of stored updates."""
    values = F.struct("n_samples", "min_time", "max_time")
    return updates.groupBy("subject", "modality").agg(F.max_by(values, "batch").alias("newest")).select(
        "subject", "modality", "newest.*"
    )


KEYS = ["subject", "modality"]
#: Parts of a snapshot; a batch writes those anew in which a subject of it lies.
PARTS = 64


def write_snapshots(running: DataFrame, target: str, checkpoint: str, parts: int = PARTS) -> StreamingQuery:
    """Merge the changed rows of every batch into a versioned snapshot under ``target``.

    A version is a list of parts, by hash of the subject, and of the batch that wrote each part last.
    A batch reads the parts in which it has subjects, puts its rows in the place of the older ones
    and writes these parts whole, then the list; other parts are neither read nor written. So every
    part is compact, a reader opens one version only, and earlier versions stay readable. A batch
    that runs again starts from the version before it and replaces what it wrote itself. The number
    of ``parts`` must not change for a target.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changed = batch.withColumn("part", F.pmod(F.xxhash64("subject"), F.lit(parts)).cast("int")).persist()
        try:
            touched = {row["part"] for row in changed.select("part").distinct().collect()}
            before = snapshot_parts(spark, target, batch_id - 1)
            old = {part: written_by for part, written_by in before.items() if part in touched}
            rows = changed
            if old:
                stored = spark.read.schema(batch.schema).parquet(*(f"{target}/rows/batch={b}/part={p}" for p, b in old.items()))
                kept = stored.join(changed.select(*(F.col(k).alias(f"_{k}") for k in KEYS)), _same_keys(), "left_anti")
                rows = changed.unionByName(kept.withColumn("part", F.pmod(F.xxhash64("subject"), F.lit(parts)).cast("int")))
            rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{target}/rows/batch={batch_id}")
            listed = {**before, **dict.fromkeys(touched, batch_id)}
            spark.createDataFrame(sorted(listed.items()), "part int, written_by long").coalesce(1).write.mode("overwrite").parquet(f"{target}/versions/batch={batch_id}")
        finally:
            changed.unpersist()

    return running.writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _same_keys():
    return F.col("subject").eqNullSafe(F.col("_subject")) & F.col("modality").eqNullSafe(F.col("_modality"))


def snapshot_parts(spark: SparkSession, target: str, version: int | None = None) -> dict[int, int]:
    """The parts of the newest version, or of the newest up to ``version``, with the batch that wrote each."""
    try:
        listed = spark.read.schema("part int, written_by long, batch long").parquet(f"{target}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    wanted = listed if version is None else listed.filter(F.col("batch") <= version)
    newest = wanted.agg(F.max("batch")).first()[0]
    if newest is None:
        return {}
    return {row["part"]: row["written_by"] for row in wanted.filter(F.col("batch") == newest).collect()}


def read_snapshot(spark: SparkSession, target: str, version: int | None = None) -> DataFrame:
    """The rows of one version, by default the newest; only its parts are opened."""
    held = snapshot_parts(spark, target, version)
    if not held:
        return spark.createDataFrame([], "subject string, modality string, n_samples long, min_time double, max_time double")
    return spark.read.parquet(*(f"{target}/rows/batch={b}/part={p}" for p, b in sorted(held.items())))
