"""Subject-level covariates: which columns qualify, their values and group sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlane.functions.times import TIME, with_time_value
from cohortlane.functions.values import as_text, column, none_label
from cohortlane.operators.attach import attach
from cohortlane.operators.profile import subject_text
from cohortlane.operators.timing import settle_time_kind
from cohortlane.session import written
from cohortlane.spec import StudySpec


def _orderable(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def covariate_facts(df: DataFrame, spec: StudySpec, candidates: Sequence[str] | None = None) -> DataFrame:
    """Per candidate column: constant per subject, and at least two values overall.

    One aggregation serves all columns: a column is constant for a subject when its smallest
    and largest non-null value agree, which holds when there is none.
    """
    spec = spec.on(df)
    names = list(candidates) if candidates is not None else spec.candidate_covariates(df)
    names = [c for c in names if _orderable(df.schema[c].dataType)]
    if not names:
        return df.sparkSession.createDataFrame([], "position int, covariate string, constant boolean, varied boolean")
    rows = df.select(column(df, spec.subject).alias("subject"), *(column(df, c).alias(f"c_{i}") for i, c in enumerate(names)))
    span = [e for i in range(len(names)) for e in (F.min(f"c_{i}").alias(f"lo_{i}"), F.max(f"c_{i}").alias(f"hi_{i}"))]
    per_subject = rows.groupBy("subject").agg(*span)
    overall = per_subject.agg(*(
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(c).alias("covariate"),
            F.coalesce(F.bool_and(F.col(f"lo_{i}") == F.col(f"hi_{i}")), F.lit(True)).alias("constant"),
            F.coalesce(F.min(f"lo_{i}") != F.max(f"hi_{i}"), F.lit(False)).alias("varied"),
        ).alias(f"facts_{i}")
        for i, c in enumerate(names)
    ))
    return overall.select(F.inline(F.array(*(F.col(f"facts_{i}") for i in range(len(names))))))


def eligible_covariates(df: DataFrame, spec: StudySpec) -> DataFrame:
    """The columns that can group subjects, in table order, after the choice ``None``."""
    none = df.sparkSession.range(1).select(F.lit(0).alias("position"), F.lit("None").alias("covariate"))
    return none.unionByName(covariate_facts(df, spec).filter("constant AND varied").select("position", "covariate"))


def first_value(df: DataFrame, spec: StudySpec, covariate: str) -> DataFrame:
    """The first non-null value per subject by time, then sample key; null if there is none."""
    spec = settle_time_kind(df, spec.on(df))
    rows = with_time_value(df, spec.time, spec.time_kind, spec.date_order).select(
        column(df, spec.subject).alias("subject"),
        F.struct(F.col(TIME).alias("time"), column(df, spec.sample).alias("sample")).alias("at"),
        as_text(df, covariate).alias("value"),
    )
    firsts = rows.groupBy("subject").agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("at"))).alias("value"))
    return firsts.select(subject_text(firsts).alias("subject"), "value")


def group_sizes(df: DataFrame, spec: StudySpec, covariate: str) -> DataFrame:
    """Distinct subjects per label, missing labels together as ``None``."""
    spec = spec.on(df)
    pairs = df.select(column(df, spec.subject).alias("subject"), none_label(as_text(df, covariate)).alias("label")).distinct()
    return pairs.groupBy("label").agg(F.count("*").alias("n_subjects"))


def subject_label_sizes(df: DataFrame, spec: StudySpec, covariate: str) -> DataFrame:
    """The same over the one first label of each subject."""
    firsts = first_value(df, spec, covariate)
    return firsts.groupBy(none_label(F.col("value")).alias("label")).agg(F.count("*").alias("n_subjects"))


def subject_pairs(df: DataFrame, spec: StudySpec, primary: str, secondary: str) -> DataFrame:
    """Distinct subject and primary label, with the subject's first secondary label.

    Samples fold to one row per subject and label, which are written; the first labels are
    found from these and joined back, whatever number of labels a subject has.
    """
    spec = settle_time_kind(df, spec.on(df))
    value = as_text(df, secondary)
    rows = with_time_value(df, spec.time, spec.time_kind, spec.date_order).select(
        column(df, spec.subject).alias("subject"),
        none_label(as_text(df, primary)).alias("primary"),
        F.when(
            value.isNotNull(),
            F.struct(
                F.col(TIME).alias("time"),
                column(df, spec.sample).alias("sample"),
                value.alias("value"),
            ),
        ).alias("first"),
    )
    return with_first_label(written(rows.groupBy("subject", "primary").agg(F.min("first").alias("first")), "pairs"))


def with_first_label(pairs: DataFrame) -> DataFrame:
    """Give all rows of a subject the label in the smallest ``first`` struct among them."""
    firsts = pairs.groupBy("subject").agg(F.min("first")["value"].alias("secondary"), F.count("*").alias("n_labels"))
    joined = attach(pairs, written(firsts, "firsts"), ["subject"], "n_labels", [F.col("primary")])
    return joined.select("subject", "primary", none_label(F.col("secondary")).alias("secondary"))


def local_counts(df: DataFrame, spec: StudySpec, primary: str, secondary: str) -> DataFrame:
    """Distinct subjects per primary and secondary label."""
    return subject_pairs(df, spec, primary, secondary).groupBy("primary", "secondary").agg(F.count("*").alias("n_subjects"))
