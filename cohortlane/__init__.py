"""Longitudinal cohort sample-availability analytics on PySpark."""

from cohortlane.spec import StudySpec

__all__ = ["StudySpec"]
