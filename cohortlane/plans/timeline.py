"""Frames behind the timeline chart: points, segments, strip and anchors."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlane.functions.times import TIME, elapsed, with_time_value
from cohortlane.functions.values import as_text, column, none_label, number_text
from cohortlane.operators.aggregates import strip_geometry
from cohortlane.operators.attach import attach
from cohortlane.operators.binning import MANY_VALUES, quartile_bins
from cohortlane.operators.covariates import with_first_label
from cohortlane.operators.profile import per_modality, points, roll_up, subject_profile
from cohortlane.operators.ranking import dense_order, place_order, subject_places
from cohortlane.operators.reshape import flag_texts, unpivot_texts, with_any
from cohortlane.operators.timing import settle_time_kind
from cohortlane.session import written
from cohortlane.spec import StudySpec


# Words of a point's text.
BREAK = "<br>"
MODALITY_TOLD = "Omics Type:"


class Timeline:
    """Timeline of a study, coloured by a primary and a secondary covariate.

    The samples are folded once, to one row per subject and primary value. That table is
    written and everything about subjects comes from it; only the points go back to the
    samples, joined with one table of subject facts.
    """

    def __init__(self, df: DataFrame, spec: StudySpec, primary: str | None = None, secondary: str | None = None, many: int = MANY_VALUES):
        self.spec = settle_time_kind(df, spec.on(df))
        if not self.spec.modalities:
            raise ValueError("none of the modalities is a column of the sample table")
        self.primary, self.secondary = primary, secondary
        if secondary is not None:
            df = quartile_bins(df, secondary, many=many)
            self._secondary_column = f"{secondary}_quartile"
        self.df = df

    @cached_property
    def folded(self) -> DataFrame:
        by, firsts = {}, {}
        if self.primary is not None:
            by["primary"] = as_text(self.df, self.primary)
            firsts["color"] = by["primary"]
        if self.secondary is not None:
            firsts["point"] = as_text(self.df, self._secondary_column)
        return written(subject_profile(self.df, self.spec, by, firsts), "timeline")

    def _measures(self) -> DataFrame:
        """One row per subject without its rank, for what needs no order."""
        firsts = [name for name, used in (("color", self.primary), ("point", self.secondary)) if used is not None]
        measures = roll_up(self.folded, self.spec, firsts)
        return measures.withColumn("subject_text", as_text(measures, "subject"))

    @cached_property
    def subjects(self) -> DataFrame:
        """One row per subject: measures, ``color_group``, ``point_group``, ``subject_rank``."""
        firsts = [name for name, used in (("color", self.primary), ("point", self.secondary)) if used is not None]
        per_subject = roll_up(self.folded, self.spec, firsts)
        color = F.col("color") if self.primary is not None else F.lit("None")
        point = none_label(F.col("point")) if self.secondary is not None else F.lit("None")
        facts = per_subject.withColumns({
            "color_group": color,
            "point_group": point,
            "n_points": points(self.spec.modalities),
            "subject_text": as_text(per_subject, "subject"),
        }).drop(*firsts)
        name = F.asc("subject_text")
        if self.primary is None and self.secondary is None:
            return dense_order(facts.filter("n_points > 0"), [F.desc("n_points"), name], "subject_rank")
        both = self.primary is not None and self.secondary is not None
        places = subject_places(self._pairs(), both).withColumnRenamed("subject", "placed_subject")
        placed = facts.join(places, facts["subject"].eqNullSafe(places["placed_subject"])).drop("placed_subject")
        return dense_order(placed, [*place_order(both), name], "subject_rank").drop("place")

    def _pairs(self) -> DataFrame:
        """Subjects with their primary labels and, if used too, their secondary label."""
        label = none_label(F.col("primary")) if self.primary is not None else None
        if self.secondary is None:
            return self.folded.select("subject", label.alias("primary")).distinct()
        if self.primary is None:
            return self.folded.select("subject", none_label(F.col("point.kept")).alias("primary"))
        first = F.when(F.col("point").isNotNull(), F.struct(F.col("point.value").alias("time"), "point.sample", F.col("point.kept").alias("value")))
        pairs = self.folded.groupBy("subject", label.alias("primary")).agg(F.min(first).alias("first"))
        return with_first_label(written(pairs, "pairs"))

    @cached_property
    def geometry(self) -> DataFrame:
        """One row: first modality, strip and anchor positions."""
        return written(strip_geometry(self._measures(), self.spec), "strip")

    def _tooltip(self, subject: Column, time: Column, modality: Column, color: Column) -> Column:
        def told(value):
            return F.coalesce(value, F.lit("NA"))

        parts = [subject, F.lit(BREAK), F.lit(self.spec.time), F.lit(":"), told(number_text(time)), F.lit(BREAK), F.lit(MODALITY_TOLD), modality]
        if self.primary is not None:
            parts += [F.lit(BREAK), F.lit(self.primary), F.lit(":"), told(color)]
        return F.concat_ws(" ", *parts)

    def points(self, modality: str | None = None) -> DataFrame:
        """One row per available cell, of one modality or of all, with its groups, rank and tooltip."""
        df, spec = self.df, self.spec
        if modality is not None:
            spec = replace(spec, modalities=tuple(m for m in spec.modalities if m == modality))
        rows = with_time_value(df, spec.time, spec.time_kind, spec.date_order).select(
            column(df, spec.subject).alias("subject"),
            as_text(df, spec.sample).alias("sample_id"),
            F.col(TIME).alias("value"),
            *flag_texts(df, spec),
        )
        facts = self.subjects.select("subject", "subject_text", "n_rows", "start", "color_group", "point_group", "subject_rank")
        joined = attach(with_any(rows, spec), facts, ["subject"], "n_rows", [F.col("sample_id")])
        kept = {
            "sample_id": F.col("sample_id"),
            "subject": F.col("subject_text"),
            "time": elapsed(F.col("value"), F.col("start"), spec.time_kind),
            "color_group": F.col("color_group"),
            "point_group": F.col("point_group"),
            "subject_rank": F.col("subject_rank"),
        }
        cells = unpivot_texts(joined, spec, kept)
        return cells.withColumn("tooltip", self._tooltip(*(F.col(c) for c in ("subject", "time", "modality", "color_group"))))

    def ranges(self) -> DataFrame:
        """First and last time per subject and modality, with the subject's rank."""
        return per_modality(self.subjects, self.spec, ["subject_rank"]).drop("n_samples", "n_untimed")

    def segments(self) -> DataFrame:
        """The ranges that have points. They come from available cells only, so all have."""
        return self.ranges()

    def strip(self) -> DataFrame:
        """One tile per subject beside the first modality."""
        tiles = self.subjects.select(F.col("subject_text").alias("subject"), "color_group", "subject_rank")
        return self._beside(tiles, {"modality": "modality", "strip_x": "strip_x", "strip_width": "strip_width"})

    def _beside(self, rows: DataFrame, wanted: dict[str, str]) -> DataFrame:
        place = self.geometry.select(F.struct("*")).scalar()
        return rows.withColumns({name: place[field] for name, field in wanted.items()}).filter("modality IS NOT NULL")

    def anchors(self) -> DataFrame:
        """One invisible point per subject with data, left of the strip."""
        rows = self.subjects.filter("n_points > 0").select(
            F.col("subject_text").alias("subject"), "color_group", "point_group", "subject_rank"
        )
        placed = self._beside(rows, {"modality": "modality", "time": "anchor_x"})
        anchors = placed.withColumns({
            "available": F.lit("Anchor"),
            "min_pts": F.lit(None).cast("double"),
            "max_pts": F.lit(None).cast("double"),
        })
        return anchors.withColumn("tooltip", self._tooltip(*(F.col(c) for c in ("subject", "time", "modality", "color_group"))))

    def anchored(self) -> DataFrame:
        """Points and anchors together; columns one side lacks are null there."""
        return self.points().unionByName(self.anchors(), allowMissingColumns=True)

    def facet(self, modality: str, anchors: bool = False) -> DataFrame:
        """One modality only."""
        cells = self.points(modality)
        if not anchors:
            return cells
        return cells.unionByName(self.anchors().filter(F.col("modality") == modality), allowMissingColumns=True)

    def axis_labels(self) -> DataFrame:
        """The strip group of each subject in display order."""
        return self.subjects.select(F.col("subject_text").alias("subject"), "color_group", "subject_rank")

    def modality_levels(self) -> DataFrame:
        """Modalities with data by name; at most as many as the study names."""
        held = per_modality(self._measures(), self.spec).select("modality").distinct()
        return held.withColumn("modality_index", F.dense_rank().over(Window.partitionBy().orderBy("modality")))


def ranges_with_points(ranges: DataFrame, cells: DataFrame) -> DataFrame:
    """Keep the ranges whose subject and modality occur among ``cells``."""
    return ranges.join(cells.select("subject", "modality").distinct(), ["subject", "modality"], "left_semi")
