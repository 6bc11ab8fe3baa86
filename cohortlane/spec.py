"""Roles of the columns of a wide sample table."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from cohortlane.functions.names import resolved
from cohortlane.functions.values import named


@dataclass(frozen=True)
class StudySpec:
    """Which columns hold the sample key, the subject, the time and the modality flags.

    ``time_kind`` is ``"numeric"`` or ``"date"``; left at ``None`` it is taken from the
    column type, and for text columns from one pass over that column. The same pass learns the
    ``date_order`` of date texts, ``"mdy"`` or ``"dmy"``: the one that fits more of the column.
    With a given kind the order is ``"mdy"`` unless it is given too.
    """

    sample: str
    subject: str
    time: str
    modalities: tuple[str, ...]
    time_kind: str | None = None
    date_order: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "modalities", tuple(dict.fromkeys(self.modalities)))
        if self.time_kind not in (None, "numeric", "date"):
            raise ValueError(f"time_kind must be 'numeric' or 'date', not {self.time_kind!r}")
        if self.date_order not in (None, "mdy", "dmy"):
            raise ValueError(f"date_order must be 'mdy' or 'dmy', not {self.date_order!r}")

    @classmethod
    def from_positions(cls, df: DataFrame, modalities: Iterable[str], time_kind: str | None = None) -> StudySpec:
        """Columns 1, 2 and 3 are sample, subject and time."""
        if len(df.columns) < 3:
            raise ValueError("a sample table needs at least a sample, a subject and a time column")
        sample, subject, time = df.columns[:3]
        return cls(sample, subject, time, tuple(modalities), time_kind).on(df)

    def on(self, df: DataFrame) -> StudySpec:
        """Check the roles against ``df`` and keep the modalities it has.

        Columns may be asked for by their names or by the cleaned form of them. A table of fewer
        than two columns is no sample table.
        """
        if len(df.columns) < 2:
            raise ValueError("a sample table needs at least a subject and a time column")
        roles = {role: resolved(df.columns, name) for role, name in (("sample", self.sample), ("subject", self.subject), ("time", self.time))}
        missing = [getattr(self, role) for role, column in roles.items() if column is None]
        if missing:
            raise ValueError(f"role columns not in the sample table: {', '.join(missing)}")
        found = []
        for name in self.modalities:
            column = resolved(df.columns, name)
            if column is not None and column not in found:
                found.append(column)
        return replace(self, modalities=tuple(found), **roles)

    def without_key(self, df: DataFrame) -> DataFrame:
        """The table without its sample key, so that subject and time come first."""
        kept = [c for c in df.columns if c not in (self.sample, self.subject, self.time)]
        return df.select(*(named(c) for c in (self.subject, self.time, *kept)))

    def candidate_covariates(self, df: DataFrame) -> list[str]:
        """Columns without a role."""
        taken = {self.sample, self.subject, self.time, *self.modalities}
        return [c for c in df.columns if c not in taken]
