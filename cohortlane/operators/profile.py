"""One pass over the samples that keeps all that is known per subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.flags import is_available
from cohortlane.functions.times import TIME, elapsed, with_time_value
from cohortlane.functions.values import as_text, column, named
from cohortlane.spec import StudySpec


def points(modalities: Sequence[str]) -> Column:
    """Available cells of a subject over all modalities."""
    return sum((F.col(f"n_{i}") for i in range(len(modalities))), F.lit(0).cast("bigint"))


def subject_profile(
    df: DataFrame, spec: StudySpec, by: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None
) -> DataFrame:
    """Group the samples by subject, and by the expressions in ``by`` if given.

    Per modality ``i``: ``n_i`` available samples, ``lo_i`` and ``hi_i`` first and last time,
    ``gap_i`` available samples without a time. Besides: ``n_rows``, and ``start``, the first
    time over all samples. ``firsts`` asks for the first non-null value of an expression by
    time and sample, kept as a struct so that ``roll_up`` can merge it. Times are
    unnormalised here. Every aggregate combines before the shuffle, so a subject with a large
    share of the samples costs no more than any other.
    """
    by, firsts = by or {}, firsts or {}
    timed = spec.time_kind is not None
    rows = with_time_value(df, spec.time, spec.time_kind, spec.date_order) if timed else df.withColumn(TIME, F.lit(None).cast("double"))
    rows = rows.select(
        column(df, spec.subject).alias("subject"),
        named(spec.sample).alias("sample"),
        F.col(TIME).alias("value"),
        *(e.alias(name) for name, e in by.items()),
        *(e.alias(name) for name, e in firsts.items()),
        *(is_available(df, m).alias(f"on_{i}") for i, m in enumerate(spec.modalities)),
    )
    measures = [F.count("*").alias("n_rows"), F.min("value").alias("start")]
    for i in range(len(spec.modalities)):
        on = F.col(f"on_{i}")
        measures += [
            F.count(F.when(on, 1)).alias(f"n_{i}"),
            F.min(F.when(on, F.col("value"))).alias(f"lo_{i}"),
            F.max(F.when(on, F.col("value"))).alias(f"hi_{i}"),
            F.count(F.when(on & F.col("value").isNull(), 1)).alias(f"gap_{i}"),
        ]
    measures += [
        F.min(F.when(F.col(name).isNotNull(), F.struct("value", "sample", F.col(name).alias("kept")))).alias(name)
        for name in firsts
    ]
    return rows.groupBy("subject", *by).agg(*measures)


def roll_up(profile: DataFrame, spec: StudySpec, firsts: Sequence[str] = ()) -> DataFrame:
    """Merge a profile that was split by further keys into one row per subject."""
    measures = [F.sum("n_rows").alias("n_rows"), F.min("start").alias("start")]
    for i in range(len(spec.modalities)):
        measures += [
            F.sum(f"n_{i}").alias(f"n_{i}"),
            F.min(f"lo_{i}").alias(f"lo_{i}"),
            F.max(f"hi_{i}").alias(f"hi_{i}"),
            F.sum(f"gap_{i}").alias(f"gap_{i}"),
        ]
    return profile.groupBy("subject").agg(*measures, *(F.min(name)["kept"].alias(name) for name in firsts))


def subject_text(df: DataFrame) -> Column:
    return as_text(df, "subject")


def per_modality(profile: DataFrame, spec: StudySpec, keep: Sequence[str] = ()) -> DataFrame:
    """One row per subject and modality with at least one available sample.

    Result: ``subject``, kept columns, ``modality``, ``n_samples``, ``min_pts``, ``max_pts``
    and ``n_untimed``; times are normalised and null where no available sample has one.
    """
    kind = spec.time_kind or "numeric"
    cells = [
        F.struct(
            F.lit(m).alias("modality"),
            F.col(f"n_{i}").alias("n_samples"),
            elapsed(F.col(f"lo_{i}"), F.col("start"), kind).cast("double").alias("min_pts"),
            elapsed(F.col(f"hi_{i}"), F.col("start"), kind).cast("double").alias("max_pts"),
            F.col(f"gap_{i}").alias("n_untimed"),
        )
        for i, m in enumerate(spec.modalities)
    ]
    if not cells:
        shape = "array<struct<modality:string,n_samples:bigint,min_pts:double,max_pts:double,n_untimed:bigint>>"
        cells_column = F.array().cast(shape)
    else:
        cells_column = F.array(*cells)
    return (
        profile.select("subject", *keep, F.inline(cells_column))
        .filter("n_samples > 0")
        .withColumn("subject", subject_text(profile))
    )
