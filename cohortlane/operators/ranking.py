"""Dense ranks and running totals over a global order, without a single-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.values import as_text, column, none_label
from cohortlane.operators.attach import attach
from cohortlane.operators.covariates import first_value, subject_pairs
from cohortlane.operators.aggregates import points_per_subject
from cohortlane.session import written
from cohortlane.spec import StudySpec

ROW_BITS = 33


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """Sort by range partitioning and write with ``_slice`` and ``_place``.

    ``_slice`` numbers the sorted partitions and ``_place`` the rows in each, both from
    ``monotonically_increasing_id``. Writing pins them: the range bounds come from a sample
    and would differ in a second evaluation.
    """
    placed = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    mask = F.lit((1 << ROW_BITS) - 1)
    return written(placed, "ordered").select(
        *df.columns, F.shiftright("_id", ROW_BITS).alias("_slice"), F.col("_id").bitwiseAND(mask).alias("_place")
    )


def rows_before(placed: DataFrame) -> list[int]:
    """Rows ahead of each slice; one number per sorted partition."""
    held = dict(placed.groupBy("_slice").agg(F.count("*")).collect())
    return [0, *accumulate(held.get(i, 0) for i in range(max(held, default=0)))]


def dense_order(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Number all rows 1..n in the given total order.

    The result is a plain projection of the written rows, so the planner knows its size.
    """
    placed = in_order(df, *order)
    ahead = F.expr(f"array({', '.join(f'{n}L' for n in rows_before(placed))})")
    return placed.select(*df.columns, (F.get(ahead, F.col("_slice").cast("int")) + F.col("_place") + 1).alias(rank))


def subject_order_by_points(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Subjects with data, most available cells first, ties by subject."""
    return dense_order(points_per_subject(df, spec), [F.desc("n_points"), F.asc("subject")], "subject_rank")


def subject_places(pairs: DataFrame, with_secondary: bool) -> DataFrame:
    """Where subjects stand, from ``subject``, ``primary`` and, if used, ``secondary``.

    Larger primary groups come first, then larger groups within them, then labels. A subject
    in several primary groups stands where it comes first. ``pairs`` has one row per subject
    and primary label and is read several times, so it should come from a written table.
    Result: ``subject`` and the struct ``place``.
    """
    def sized(rows: DataFrame, labels: list[str], name: str) -> DataFrame:
        sizes = pairs.groupBy(*labels).agg(F.count("*").alias(name), F.count("*").alias("weight"))
        return attach(rows, written(sizes, "sizes"), labels, "weight", [F.col("subject")])

    keyed = sized(pairs, ["primary"], "n_primary")
    place = [(-F.col("n_primary")).alias("a"), F.col("primary").alias("b")]
    if with_secondary:
        keyed = sized(keyed, ["primary", "secondary"], "n_local")
        place += [(-F.col("n_local")).alias("c"), F.col("secondary").alias("d")]
    return keyed.groupBy("subject").agg(F.min(F.struct(*place)).alias("place"))


def place_order(with_secondary: bool) -> list[Column]:
    return [F.col(f"place.{f}") for f in ("abcd" if with_secondary else "ab")]


def order_pairs(pairs: DataFrame, with_secondary: bool) -> DataFrame:
    """Rank subjects by their place, then by name."""
    places = subject_places(pairs, with_secondary)
    ranked = places.select(as_text(places, "subject").alias("subject"), "place")
    ordered = dense_order(ranked, [*place_order(with_secondary), F.col("subject")], "subject_rank")
    shown = [F.col("place.b").alias("primary")] + ([F.col("place.d").alias("secondary")] if with_secondary else [])
    return ordered.select("subject", *shown, "subject_rank")


def subject_order_primary(df: DataFrame, spec: StudySpec, primary: str) -> DataFrame:
    """All subjects by size of their primary group, label, subject."""
    spec = spec.on(df)
    pairs = df.select(column(df, spec.subject).alias("subject"), none_label(as_text(df, primary)).alias("primary")).distinct()
    return order_pairs(written(pairs, "pairs"), with_secondary=False)


def subject_order_primary_secondary(df: DataFrame, spec: StudySpec, primary: str, secondary: str) -> DataFrame:
    """All subjects by primary group size, then size of the secondary group within it."""
    return order_pairs(subject_pairs(df, spec, primary, secondary), with_secondary=True)


def subject_order_secondary(df: DataFrame, spec: StudySpec, secondary: str) -> DataFrame:
    """All subjects by size of their secondary group, label, subject."""
    firsts = first_value(df, spec, secondary)
    labelled = firsts.select("subject", none_label(F.col("value")).alias("primary"))
    return order_pairs(written(labelled, "pairs"), with_secondary=False).withColumnRenamed("primary", "secondary")
