"""All results of a study from one place."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortlane.functions.names import resolved
from cohortlane.functions.values import named
from cohortlane.operators import aggregates, contingency, covariates, ranking, reshape, search, timing
from cohortlane.operators.binning import MANY_VALUES, quartile_bins
from cohortlane.operators.constraints import KeyViolation, check_key
from cohortlane.plans.overlap import Overlap
from cohortlane.plans.timeline import Timeline
from cohortlane.spec import StudySpec


class Study:
    """A sample table with its roles. Every method gives a new DataFrame.

    Groups and covariates may be asked for by the names of their columns or by the cleaned form of these.
    """

    def __init__(self, df: DataFrame, spec: StudySpec):
        self.df = df
        self.spec = timing.settle_time_kind(df, spec.on(df))

    def check(self) -> Study:
        """Raise when the sample key has duplicates or nulls, or a subject is null.

        Without this check null subjects are one subject of their own.
        """
        check_key(self.df, self.spec.sample)
        if not self.df.filter(named(self.spec.subject).isNull()).isEmpty():
            raise KeyViolation("Subject ID column contains missing values.")
        return self

    def column(self, name: str | None) -> str | None:
        """The column that a name stands for."""
        found = None if name is None else resolved(self.df.columns, name)
        if name is not None and found is None:
            raise ValueError(f"no such column in the sample table: {name}")
        return found

    def long(self, *covariate_names: str) -> DataFrame:
        return reshape.long_availability(self.df, self.spec, [self.column(name) for name in covariate_names])

    def times(self) -> DataFrame:
        return timing.days_since_start(self.df, self.spec)

    def ranges(self) -> DataFrame:
        return aggregates.modality_ranges(self.df, self.spec)

    def samples_per_subject(self) -> DataFrame:
        return aggregates.samples_per_subject(self.df, self.spec)

    def timepoint_stats(self, text: bool = True) -> DataFrame:
        return (aggregates.timepoint_stats_text if text else aggregates.timepoint_stats)(self.df, self.spec)

    def sizes(self) -> DataFrame:
        return aggregates.cohort_sizes(self.df, self.spec)

    def covariates(self) -> DataFrame:
        return covariates.eligible_covariates(self.df, self.spec)

    def contingency(self, group: str) -> DataFrame:
        return contingency.contingency(self.df, self.spec, self.column(group))

    def subject_order(self, primary: str | None = None, secondary: str | None = None, many: int = MANY_VALUES) -> DataFrame:
        """The ranks that the timeline has: a numeric secondary goes by its quartile bins."""
        primary, secondary = self.column(primary), self.column(secondary)
        if secondary:
            binned, bins = quartile_bins(self.df, secondary, many=many), f"{secondary}_quartile"
        if primary and secondary:
            return ranking.subject_order_primary_secondary(binned, self.spec, primary, bins)
        if primary:
            return ranking.subject_order_primary(self.df, self.spec, primary)
        if secondary:
            return ranking.subject_order_secondary(binned, self.spec, bins)
        return ranking.subject_order_by_points(self.df, self.spec)

    def timeline(self, primary: str | None = None, secondary: str | None = None, many: int = MANY_VALUES) -> Timeline:
        return Timeline(self.df, self.spec, self.column(primary), self.column(secondary), many)

    def overlap(self) -> Overlap:
        return Overlap(self.df, self.spec)

    def search(self, query: str) -> DataFrame:
        return search.table_search(self.df, query)

    def preview(self, rows: int = 5) -> DataFrame:
        return search.preview(self.df, [self.spec.sample], rows)
