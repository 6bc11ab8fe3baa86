"""Wide sample tables to long availability tables and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.flags import available_text, cell_available
from cohortlane.functions.times import TIME, with_time_value
from cohortlane.functions.values import as_text, column, named
from cohortlane.operators.timing import settle_time_kind, since_start
from cohortlane.spec import StudySpec


def unpivot_available(df: DataFrame, spec: StudySpec, kept: dict[str, Column], flag: Callable[[DataFrame, str], Column] = available_text) -> DataFrame:
    """One row per available cell with the ``kept`` expressions, ``modality`` and ``available``.

    The flags turn into text or null first, so modalities of different types can be mixed;
    the unpivot is a projection per modality and does not shuffle.
    """
    if not spec.modalities:
        return df.select(
            *(e.alias(n) for n, e in kept.items()), F.lit("").alias("modality"), F.lit("").alias("available")
        ).filter(F.lit(False))
    places = [f"_kept_{i}" for i in range(len(kept))]
    wide = df.select(*(e.alias(p) for p, e in zip(places, kept.values())), *(flag(df, m).alias(m) for m in spec.modalities))
    cells = wide.unpivot(places, [named(m) for m in spec.modalities], "modality", "available").filter("available IS NOT NULL")
    return cells.toDF(*kept, "modality", "available")


def flag_texts(df: DataFrame, spec: StudySpec) -> list[Column]:
    """Every flag as text or null, under names that no other column has."""
    return [available_text(df, m).alias(f"_on_{i}") for i, m in enumerate(spec.modalities)]


def with_any(rows: DataFrame, spec: StudySpec) -> DataFrame:
    """Samples with an available cell, from rows with ``flag_texts``."""
    return rows.filter(F.coalesce(*(f"_on_{i}" for i in range(len(spec.modalities))), F.lit(None).cast("string")).isNotNull())


def unpivot_texts(rows: DataFrame, spec: StudySpec, kept: dict[str, Column]) -> DataFrame:
    """The available cells of rows with ``flag_texts``."""
    return unpivot_available(rows, spec, kept, lambda _, m: F.col(f"_on_{spec.modalities.index(m)}"))


def availability_cells(df: DataFrame, spec: StudySpec, flag=available_text) -> DataFrame:
    """Available cells without times: ``sample_id``, ``subject``, ``modality``, ``available``."""
    spec = spec.on(df)
    kept = {"sample_id": as_text(df, spec.sample), "subject": as_text(df, spec.subject)}
    return unpivot_available(df, spec, kept, flag)


def long_availability(df: DataFrame, spec: StudySpec, covariates: Sequence[str] = ()) -> DataFrame:
    """The long availability table with normalised times.

    Result: ``sample_id``, ``subject``, ``time_raw``, ``time``, the covariates, ``modality``
    and ``available``, one row per available cell.
    """
    spec = settle_time_kind(df, spec.on(df))
    rows = with_time_value(df, spec.time, spec.time_kind, spec.date_order).select(
        as_text(df, spec.sample).alias("sample_id"),
        column(df, spec.subject).alias("subject"),
        named(spec.time).cast("string").alias("time_raw"),
        F.col(TIME).alias("time"),
        *(named(c) for c in covariates),
        *flag_texts(df, spec),
    )
    if spec.time_kind == "date":
        rows = since_start(with_any(rows, spec), rows)
    kept = {c: named(c) for c in ("sample_id", "subject", "time_raw", "time", *covariates)}
    kept["subject"] = as_text(rows, "subject")
    return unpivot_texts(rows, spec, kept)


def availability_wide(df: DataFrame, spec: StudySpec, group: str) -> DataFrame:
    """One row per subject and group, one list cell of distinct flag texts per modality.

    The modality list is given to the pivot, which saves the job that would look for it. A
    cell holds at most the few spellings of "yes".
    """
    spec = spec.on(df)
    kept = {"subject": as_text(df, spec.subject), "group": as_text(df, group)}
    cells = unpivot_available(df, spec, kept).distinct()
    return cells.groupBy("subject", "group").pivot("modality", list(spec.modalities)).agg(F.sort_array(F.collect_list("available")))


def wide_to_indicators(wide: DataFrame, modalities: Sequence[str], prefix: str = "") -> DataFrame:
    """List cells to 0/1; with a ``prefix`` beside the lists, which stay."""
    return wide.withColumns({prefix + m: cell_available(named(m)) for m in modalities})
