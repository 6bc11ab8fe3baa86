"""Normalising the time column."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.times import TIME, date_order_fits, elapsed, own_prefix, typed_time_kind, with_date_parts, with_date_text, with_time_value
from cohortlane.functions.values import as_text, column, is_number_text, named, type_of
from cohortlane.operators.attach import attach
from cohortlane.session import written
from cohortlane.spec import StudySpec


def time_column_facts(df: DataFrame, time: str) -> DataFrame:
    """One row that says how a time column is to be read, from one pass.

    A text column is numeric when every value is a number, a date when more than half of
    all values parse as dates, and numeric otherwise. ``n_mdy`` and ``n_dmy`` count the values that
    are dates with the month and with the day first; what fits both counts for both, so the others
    decide ``date_order``, and ``mdy`` wins a tie.
    """
    typed = typed_time_kind(type_of(df, time))
    text = column(df, time).cast("string")
    rows = df.select(text.alias("text"))
    if typed is None:
        own = own_prefix(rows)
        parted = with_date_parts(with_date_text(rows, F.col("text"), "moment"), F.col("text"), own)
        rows = parted.select(
            is_number_text(F.col("text")).alias("number"), F.col("moment").isNotNull().alias("date"), *(fit.alias(order) for order, fit in date_order_fits(own).items())
        )
    else:
        fixed = F.lit(False)
        rows = rows.select(F.lit(typed == "numeric").alias("number"), ((F.lit(typed) == "date") & F.col("text").isNotNull()).alias("date"), fixed.alias("mdy"), fixed.alias("dmy"))
    facts = rows.agg(
        F.coalesce(F.bool_and("number"), F.lit(typed != "date")).alias("all_numeric"),
        F.avg(F.col("date").cast("int")).alias("ratio"),
        F.count_if("mdy").alias("n_mdy"),
        F.count_if("dmy").alias("n_dmy"),
    )
    ratio = F.when(F.col("all_numeric"), 0.0).otherwise(F.coalesce("ratio", F.lit(0.0)))
    kind = F.lit(typed) if typed else F.when(ratio > 0.5, "date").otherwise("numeric")
    order = F.when(F.col("n_dmy") > F.col("n_mdy"), "dmy").otherwise("mdy")
    return facts.select("all_numeric", ratio.alias("parsed_ratio"), kind.alias("time_kind"), "n_mdy", "n_dmy", order.alias("date_order"))


def time_kind_facts(df: DataFrame, time: str) -> DataFrame:
    """How a time column is to be read, without the votes on the order of dates."""
    return time_column_facts(df, time).select("all_numeric", "parsed_ratio", "time_kind")


def settle_time_kind(df: DataFrame, spec: StudySpec) -> StudySpec:
    """Fix the time kind and the order of date texts; only a text column without a given kind costs a pass."""
    kind, order = spec.time_kind or typed_time_kind(type_of(df, spec.time)), spec.date_order
    if kind is None:
        facts = time_column_facts(df, spec.time).first()
        kind, order = facts["time_kind"], order or facts["date_order"]
    return replace(spec, time_kind=kind, date_order=order or "mdy")


def days_since_start(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Every sample with its normalised time.

    Dates become days since the subject's first sample, taken over all its samples; numeric
    times stay, with null for what is not a number. Result: ``sample_id``, ``subject``,
    ``time_raw``, ``time``.
    """
    spec = settle_time_kind(df, spec.on(df))
    rows = with_time_value(df, spec.time, spec.time_kind, spec.date_order).select(
        as_text(df, spec.sample).alias("sample_id"),
        column(df, spec.subject).alias("subject"),
        named(spec.time).cast("string").alias("time_raw"),
        F.col(TIME).alias("time"),
    )
    if spec.time_kind == "date":
        rows = since_start(rows, rows)
    return rows.withColumn("subject", as_text(rows, "subject"))


def since_start(rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Turn ``time`` from microseconds to days since the subject's start over ``all_rows``.

    The starts, one row per subject, are written first: that takes one narrow pass, and their
    known size lets the planner keep the samples where they are when they can be broadcast.
    """
    starts = all_rows.groupBy("subject").agg(F.min("time").alias("start"), F.count("*").alias("n_rows"))
    joined = attach(rows, written(starts, "starts"), ["subject"], "n_rows", [F.col("sample_id")])
    timed = joined.withColumn("time", elapsed(F.col("time"), F.col("start"), "date"))
    return timed.select(*(named(c) for c in rows.columns))
