"""Study frames over the sales and event tables used by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.spec import StudySpec

RETURN_FLAGS = ("A", "N", "R")
# The types of the test tables, for the SQL; the studies take those that occur.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders_with_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with one boolean per line return flag."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        *(F.max(F.col("l_returnflag") == f).alias(f"has_{f}") for f in RETURN_FLAGS)
    )
    orders = table(spark, folder, "orders")
    joined = orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").drop("l_orderkey")
    return joined.withColumns({f"has_{f}": F.coalesce(f"has_{f}", F.lit(False)) for f in RETURN_FLAGS})


def orders_study(spark: SparkSession, folder: str, customer: bool = False, nation: bool = False) -> tuple[DataFrame, StudySpec]:
    """One sample per order, Yes/No flags per return flag, customer columns on request."""
    df = orders_with_flags(spark, folder)
    df = df.withColumns({f"ret_{f}": F.when(F.col(f"has_{f}"), "Yes").otherwise("No") for f in RETURN_FLAGS})
    df = df.drop(*(f"has_{f}" for f in RETURN_FLAGS))
    if customer or nation:
        customers = table(spark, folder, "customer")
        df = df.join(customers, df["o_custkey"] == customers["c_custkey"], "left").drop("c_custkey")
        # Null for every 17th customer, so that missing groups are met.
        df = df.withColumn("segment", F.when(F.col("o_custkey") % 17 != 0, F.col("c_mktsegment")))
    if nation:
        nations = table(spark, folder, "nation")
        df = df.join(nations, df["c_nationkey"] == nations["n_nationkey"], "left").drop("n_nationkey", "n_regionkey")
    return df, StudySpec("o_orderkey", "o_custkey", "o_orderdate", tuple(f"ret_{f}" for f in RETURN_FLAGS))


def event_types(events: DataFrame) -> tuple[str, ...]:
    """The types that occur, by name; each is to be a column."""
    return tuple(row["event_type"] for row in events.select("event_type").filter("event_type IS NOT NULL").distinct().orderBy("event_type").collect())


def events_study(spark: SparkSession, folder: str) -> tuple[DataFrame, StudySpec]:
    """One sample per user and day since the first one, a boolean per event type."""
    events = table(spark, folder, "events")
    types = event_types(events)
    first = events.agg(F.to_date(F.min("ts"))).scalar()
    daily = events.groupBy("user_id", F.datediff(F.to_date("ts"), first).alias("day")).agg(
        *(F.max(F.col("event_type") == e).alias(e) for e in types)
    )
    df = daily.withColumn("sample", F.concat_ws("-", "user_id", "day"))
    return df, StudySpec("sample", "user_id", "day", types)


def labels_study(spark: SparkSession, folder: str) -> tuple[DataFrame, StudySpec]:
    """One sample per labelled document, by source, with 0/1 flags."""
    documents = table(spark, folder, "documents").select("doc_id", "source", "n_chars", "lang")
    return (
        table(spark, folder, "labels").join(documents, "doc_id"),
        StudySpec("doc_id", "source", "n_chars", ("quality", "toxic")),
    )
