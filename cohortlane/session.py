"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local applications that name none.
LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cores: int | str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    cores = cores or os.cpu_count() or 4
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("cohortlane")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables.

    A temporary folder is made only for a local master; on a cluster a
    machine-local folder would not be visible to the other executors.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in LOCAL_FOLDERS:
        LOCAL_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="cohortlane-")
    return LOCAL_FOLDERS[context.applicationId]


def table_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables lie."""
    return f"{shared_folder(spark)}/cohortlane/{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; frames that read them are void afterwards."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(table_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage, pins values that must not be computed twice, survives
    lost executors, and gives the planner the true size, so that it broadcasts the
    table only when that size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{table_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
