"""Counts, ranges and timepoint statistics."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.functions.flags import is_available
from cohortlane.functions.values import named, percent_text
from cohortlane.operators.profile import per_modality, points, subject_profile, subject_text
from cohortlane.operators.timing import settle_time_kind
from cohortlane.session import written
from cohortlane.spec import StudySpec

LANE_SPREAD = 0.3


def untimed(spec: StudySpec) -> StudySpec:
    """For results that need no times, so that the time column is not even read."""
    return replace(spec, time_kind=None)


def modality_ranges(df: DataFrame, spec: StudySpec) -> DataFrame:
    """First and last time per subject and modality; null where no available sample has one.

    The start of a subject and the ranges come out of the same aggregation, so the samples
    are never joined with their start.
    """
    spec = settle_time_kind(df, spec.on(df))
    return per_modality(subject_profile(df, spec), spec).select("subject", "modality", "min_pts", "max_pts")


def samples_per_subject(df: DataFrame, spec: StudySpec) -> DataFrame:
    spec = untimed(spec.on(df))
    return per_modality(subject_profile(df, spec), spec).select("modality", "subject", "n_samples")


def timepoint_stats(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Per modality the fewest and most samples of a subject, and how many subjects have them.

    The counts per subject shrink to a histogram before the last step, which so sees one row
    per modality and distinct count.
    """
    histogram = samples_per_subject(df, spec).groupBy("modality", "n_samples").agg(F.count("*").alias("subjects"))
    return histogram.groupBy("modality").agg(
        F.min("n_samples").alias("min_samples"),
        F.max("n_samples").alias("max_samples"),
        F.min_by("subjects", "n_samples").alias("n_min"),
        F.max_by("subjects", "n_samples").alias("n_max"),
        F.sum("subjects").alias("total_subjects"),
    )


def timepoint_stats_text(df: DataFrame, spec: StudySpec) -> DataFrame:
    """The same as text, such as ``1 (6 | 21.4%)``."""

    def told(samples, subjects):
        share = percent_text(F.col(subjects), F.col("total_subjects"))
        return F.concat(F.col(samples), F.lit(" ("), F.col(subjects), F.lit(" | "), share, F.lit(")"))

    return timepoint_stats(df, spec).select(
        F.col("modality").alias("Omics_Name"),
        told("min_samples", "n_min").alias("Min_Samples_Per_Individual"),
        told("max_samples", "n_max").alias("Max_Samples_Per_Individual"),
    )


def subject_totals(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Per subject its samples and, alongside each, the total of the modality it is in."""
    counts = written(samples_per_subject(df, spec), "counts")
    totals = counts.groupBy("modality").agg(F.count("*").alias("total_subjects"))
    # One row per modality of the spec, so the broadcast side is bounded by its length.
    return counts.join(F.broadcast(totals), "modality")


def points_per_subject(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Available cells per subject, for subjects that have any."""
    spec = untimed(spec.on(df))
    profile = subject_profile(df, spec)
    return profile.select(subject_text(profile).alias("subject"), points(spec.modalities).alias("n_points")).filter("n_points > 0")


def cohort_sizes(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Subjects with at least one available cell, and all subjects."""
    spec = untimed(spec.on(df))
    held = subject_profile(df, spec).select(points(spec.modalities).alias("n_points"))
    return held.agg(F.count_if(F.col("n_points") > 0).alias("subjects_with_data"), F.count("*").alias("subjects"))


def time_limits(profile: DataFrame, spec: StudySpec) -> DataFrame:
    """Time range over all available cells and axis limits padded by a tenth of it."""
    ranges = per_modality(profile, spec).agg(F.min("min_pts").alias("min_time"), F.max("max_pts").alias("max_time"))
    padding = (F.col("max_time") - F.col("min_time")) * 0.1
    return ranges.select(
        "min_time",
        "max_time",
        padding.alias("padding"),
        (F.col("min_time") - padding).alias("x_min"),
        (F.col("max_time") + padding).alias("x_max"),
    )


def strip_geometry(profile: DataFrame, spec: StudySpec) -> DataFrame:
    """Where the group strip and the anchors stand: left of the first modality by name.

    One row; no row without an available cell. An available sample without a time makes the
    positions null.
    """
    modality = F.col("modality")
    per_name = per_modality(profile, spec).groupBy(modality).agg(
        F.min("min_pts").alias("low"), F.max("max_pts").alias("high"), F.sum("n_untimed").alias("untimed")
    )
    first = per_name.agg(F.min(F.struct("modality", "low", "high", "untimed")).alias("first")).select("first.*")
    timed = F.col("untimed") == 0
    low = F.when(timed, F.col("low"))
    span = F.when(timed, F.col("high") - F.col("low"))
    measured = first.filter("modality IS NOT NULL").select(modality, low.alias("min_time"), span.alias("time_range"))
    # greatest() skips nulls, so an unknown range has to be passed on by hand.
    known = F.col("time_range").isNotNull()
    offset = F.when(known, F.greatest(F.lit(1.0), F.col("time_range") * 0.05))
    width = F.when(known, F.greatest(F.lit(0.35), F.col("time_range") * 0.05))
    placed = measured.withColumns({"strip_offset": offset, "strip_width": width})
    placed = placed.withColumn("strip_x", F.col("min_time") - F.col("strip_offset"))
    return placed.withColumn("anchor_x", F.col("strip_x") - F.col("strip_width") * 2)


def modality_lanes(df: DataFrame, spec: StudySpec) -> DataFrame:
    """Modalities by first appearance with evenly spaced offsets from -0.3 to 0.3.

    First appearance is the smallest sample key with the modality available, ties by the
    place in the modality list. One aggregation gives one row, so the ranking is bounded by
    the number of modalities.
    """
    spec = spec.on(df)
    sample = named(spec.sample)
    firsts = df.agg(*(F.min(F.when(is_available(df, m), sample)).alias(f"f_{i}") for i, m in enumerate(spec.modalities)))
    lanes = firsts.select(
        F.inline(F.array(*(
            F.struct(F.lit(m).alias("modality"), F.lit(i).alias("place"), F.col(f"f_{i}").alias("first_sample"))
            for i, m in enumerate(spec.modalities)
        )))
    ).filter("first_sample IS NOT NULL")
    order = Window.partitionBy().orderBy("first_sample", "place")
    count = F.count("*").over(Window.partitionBy())
    ranked = lanes.select("modality", F.row_number().over(order).alias("lane"), count.alias("lanes"))
    step = F.when(F.col("lanes") > 1, 2 * LANE_SPREAD / (F.col("lanes") - 1)).otherwise(0.0)
    return ranked.select("modality", "lane", (F.lit(-LANE_SPREAD) + (F.col("lane") - 1) * step).alias("lane_offset"))
