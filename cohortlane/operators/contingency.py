"""Group by modality tables of distinct subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.flags import is_available, is_available_exact
from cohortlane.functions.times import TIME, with_time_value
from cohortlane.functions.values import as_text, column, missing_label, named
from cohortlane.operators.attach import attach
from cohortlane.operators.grid import grid_join
from cohortlane.operators.timing import settle_time_kind
from cohortlane.session import written
from cohortlane.spec import StudySpec

TOTAL = "Total_Subjects_with_Omics"


def _any_flag(n: int):
    return F.greatest(F.lit(False), F.lit(False), *(F.col(f"on_{i}") for i in range(n)))


def _flags_up(n: int):
    return [F.max(f"on_{i}").alias(f"on_{i}") for i in range(n)]


def _counts(spec: StudySpec, pairs: DataFrame) -> DataFrame:
    """One row per group from one row per subject and group."""
    counts = [F.count_if(F.col(f"on_{i}")).alias(f"c_{i}") for i in range(len(spec.modalities))]
    return pairs.groupBy("Group").agg(*counts, F.count("*").alias(TOTAL))


def _named_counts(spec: StudySpec, counts: DataFrame, places: list[int]) -> DataFrame:
    return counts.select("Group", *(F.col(f"c_{i}").cast("int").alias(spec.modalities[i]) for i in places), F.col(TOTAL).cast("int"))


def subject_group_flags(df: DataFrame, spec: StudySpec, group: str) -> DataFrame:
    """Subjects with data, per group, and the modalities seen there.

    A sample counts for all groups that its subject has at that time among samples with data.
    Nearly always that is one group, so the samples are folded to subject and group first and
    written; only if there are subjects in several groups, their samples are read again and
    looked at time by time.
    """
    spec = settle_time_kind(df, spec.on(df))
    n = len(spec.modalities)
    rows = with_time_value(df, spec.time, spec.time_kind, spec.date_order).select(
        column(df, spec.subject).alias("subject"),
        as_text(df, group).alias("Group"),
        F.col(TIME).alias("time"),
        *(is_available(df, m).alias(f"on_{i}") for i, m in enumerate(spec.modalities)),
    ).filter(_any_flag(n))
    direct = written(rows.groupBy("subject", "Group").agg(*_flags_up(n)), "direct")
    several = direct.groupBy("subject").agg(F.count("*").alias("groups")).filter("groups > 1").select(F.col("subject").alias("mixed"))
    if several.isEmpty():
        return direct
    # Unknown times of a subject count as one time.
    at = ["subject", "time", "timed"]
    timed = rows.withColumns({"timed": F.col("time").isNotNull(), "time": F.coalesce("time", F.lit(0))})
    # Folded before the join, so that a subject's samples do not meet in one task.
    folded = timed.groupBy(*at, "Group").agg(*_flags_up(n))
    meetings = written(folded.join(several, folded["subject"].eqNullSafe(several["mixed"]), "left_semi"), "meetings")
    seen = written(meetings.groupBy(*at).agg(*_flags_up(n), F.count("*").alias("n_groups")), "seen")
    shared = attach(meetings.select(*at, "Group"), seen, at, "n_groups", [F.col("Group")]).drop("time", "timed")
    return direct.unionByName(shared).groupBy("subject", "Group").agg(*_flags_up(n))


def contingency(df: DataFrame, spec: StudySpec, group: str) -> DataFrame:
    """Distinct subjects with data per group and modality, with a row of column sums.

    A null group is a group of its own. Modalities without any available cell are left out;
    which those are is read off the counts, one row per group, once these are written.
    ``Total_Subjects_with_Omics`` counts the subjects of a group with any modality.
    """
    spec = spec.on(df)
    n = len(spec.modalities)
    counts = written(_counts(spec, subject_group_flags(df, spec, group)), "contingency")
    sums = [F.sum(f"c_{i}").alias(f"c_{i}") for i in range(n)]
    total = counts.agg(F.count("*").alias("groups"), *sums, F.sum(TOTAL).alias(TOTAL)).filter("groups > 0")
    total = total.withColumn("Group", F.lit("Total")).drop("groups")
    seen = total.first()
    places = [i for i in range(n) if seen is not None and seen[f"c_{i}"]]
    return _named_counts(spec, counts.unionByName(total), places)


def contingency_with_missing(df: DataFrame, spec: StudySpec, group: str) -> DataFrame:
    """The variant with case-sensitive flags where the totals count all subjects of a group.

    Null groups are called ``Missing``. The last row has column sums for the modalities and
    the distinct subjects overall for the total.
    """
    spec = spec.on(df)
    n = len(spec.modalities)
    rows = df.select(
        column(df, spec.subject).alias("subject"),
        missing_label(as_text(df, group)).alias("Group"),
        *(is_available_exact(df, m).alias(f"on_{i}") for i, m in enumerate(spec.modalities)),
    )
    pairs = rows.groupBy("subject", "Group").agg(*_flags_up(n))
    counts = _counts(spec, pairs).filter(_shown(n))
    subjects = pairs.groupBy("subject").agg(F.lit(1)).agg(F.count("*").alias("n")).scalar()
    total = counts.agg(*(F.coalesce(F.sum(f"c_{i}"), F.lit(0)).alias(f"c_{i}") for i in range(n)))
    total = total.select(F.lit("Total").alias("Group"), "*", subjects.alias(TOTAL))
    return _named_counts(spec, counts.unionByName(total), list(range(n)))


def _shown(n: int):
    """Groups come from the per-modality counts, so a group without any does not appear."""
    return F.greatest(F.lit(0), F.lit(0), *(F.col(f"c_{i}") for i in range(n))) > 0


def contingency_by_joins(df: DataFrame, spec: StudySpec, group: str) -> DataFrame:
    """``contingency_with_missing`` without the last row, from one count per modality.

    The samples are folded once to subject and group. The counts from that have one row per
    group and are joined in full, then totals from the left. Kept for parity; the single
    aggregation above does the same in one pass.
    """
    spec = spec.on(df)
    rows = df.select(
        column(df, spec.subject).alias("subject"),
        missing_label(as_text(df, group)).alias("Group"),
        *(is_available_exact(df, m).alias(f"on_{i}") for i, m in enumerate(spec.modalities)),
    )

    pairs = written(rows.groupBy("subject", "Group").agg(*_flags_up(len(spec.modalities))), "pairs")

    def distinct_subjects(part: DataFrame, name: str) -> DataFrame:
        return part.groupBy("Group").agg(F.count("*").alias(name))

    table = None
    for i in range(len(spec.modalities)):
        one = distinct_subjects(pairs.filter(f"on_{i}"), f"c_{i}")
        table = one if table is None else table.join(one, "Group", "full_outer")
    table = table.join(distinct_subjects(pairs, TOTAL), "Group", "left")
    named_counts = [F.coalesce(f"c_{i}", F.lit(0)).cast("int").alias(m) for i, m in enumerate(spec.modalities)]
    return table.select("Group", *named_counts, F.col(TOTAL).cast("int"))


def long_with_groups(long: DataFrame, group_rows: DataFrame) -> DataFrame:
    """Attach every group a subject has at a time to its available cells.

    Nulls match nulls. A group column that ``long`` already has gives way to the right side. A
    subject and time with many cells and many groups is cut on both sides.
    """
    right = group_rows.select("subject", "time", F.col("Group")).distinct()
    left = long.select(*(named(c) for c in long.columns if c != "Group"))
    joined = grid_join(left, right, ["subject", "time"], [named(c) for c in left.columns], [F.col("Group")])
    return joined.select(*(named(c) for c in left.columns), "Group")
