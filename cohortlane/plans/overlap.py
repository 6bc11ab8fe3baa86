"""Frames behind the overlap chart: one lane per modality around each subject."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.times import TIME, elapsed, with_time_value
from cohortlane.functions.values import as_text, column, number_text
from cohortlane.operators.aggregates import modality_lanes, time_limits
from cohortlane.operators.attach import attach
from cohortlane.operators.profile import per_modality, points, subject_profile
from cohortlane.operators.ranking import dense_order
from cohortlane.operators.reshape import flag_texts, unpivot_texts, with_any
from cohortlane.operators.timing import settle_time_kind
from cohortlane.session import written
from cohortlane.spec import StudySpec


# Words of the texts of points and ranges.
SUBJECT_TOLD = "Subject ID:"
MODALITY_TOLD = "Omics Type:"
TIME_TOLD = "Timepoint:"
FLAG_TOLD = "Available:"
RANGE_TOLD = "Time Range:"
RANGE_TO = "to"


class Overlap:
    """Overlap of the modalities of a study over time."""

    def __init__(self, df: DataFrame, spec: StudySpec):
        self.spec = settle_time_kind(df, spec.on(df))
        if not self.spec.modalities:
            raise ValueError("none of the modalities is a column of the sample table")
        self.df = df

    @cached_property
    def subjects(self) -> DataFrame:
        """Subjects with data, most available cells first."""
        profile = subject_profile(self.df, self.spec)
        facts = profile.withColumns({"n_points": points(self.spec.modalities), "subject_text": as_text(profile, "subject")})
        with_data = facts.filter("n_points > 0")
        return dense_order(with_data, [F.desc("n_points"), F.asc("subject_text")], "subject_rank")

    @cached_property
    def lanes(self) -> DataFrame:
        """At most one row per modality of the study."""
        return written(modality_lanes(self.df, self.spec), "lanes")

    def _in_lanes(self, rows: DataFrame) -> DataFrame:
        # Bounded by the modality list of the study.
        laned = rows.join(F.broadcast(self.lanes.select("modality", "lane_offset")), "modality")
        return laned.withColumn("y_offset", F.col("subject_rank") + F.col("lane_offset")).drop("lane_offset")

    @staticmethod
    def _told(value):
        return F.coalesce(number_text(value), F.lit("NA"))

    def points(self) -> DataFrame:
        df, spec = self.df, self.spec
        rows = with_time_value(df, spec.time, spec.time_kind, spec.date_order).select(
            column(df, spec.subject).alias("subject"),
            as_text(df, spec.sample).alias("sample_id"),
            F.col(TIME).alias("value"),
            *flag_texts(df, spec),
        )
        facts = self.subjects.select("subject", "subject_text", "n_rows", "start", "subject_rank")
        joined = attach(with_any(rows, spec), facts, ["subject"], "n_rows", [F.col("sample_id")])
        kept = {
            "sample_id": F.col("sample_id"),
            "subject": F.col("subject_text"),
            "time": elapsed(F.col("value"), F.col("start"), spec.time_kind),
            "subject_rank": F.col("subject_rank"),
        }
        cells = self._in_lanes(unpivot_texts(joined, spec, kept))
        return cells.withColumn("tooltip", F.concat_ws(
            " ", F.lit(SUBJECT_TOLD), "subject", F.lit("\n"), F.lit(MODALITY_TOLD), "modality", F.lit("\n"),
            F.lit(TIME_TOLD), self._told(F.col("time")), F.lit("\n"), F.lit(FLAG_TOLD), "available",
        ))

    def segments(self) -> DataFrame:
        ranges = per_modality(self.subjects, self.spec, ["subject_rank"]).drop("n_samples", "n_untimed")
        return self._in_lanes(ranges).withColumn("tooltip", F.concat_ws(
            " ", F.lit(SUBJECT_TOLD), "subject", F.lit("\n"), F.lit(MODALITY_TOLD), "modality", F.lit("\n"),
            F.lit(RANGE_TOLD), self._told(F.col("min_pts")), F.lit(RANGE_TO), self._told(F.col("max_pts")),
        ))

    def limits(self) -> DataFrame:
        return time_limits(subject_profile(self.df, self.spec), self.spec)
