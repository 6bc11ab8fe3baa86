"""Key checks on a sample table or a set of feature matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.values import named

# What a failed check says.
MESSAGES = {
    "metadata": "Sample ID column contains duplicate values.",
    "omics": "Omics data file primary key (Sample ID) column contains duplicate values.",
}


class KeyViolation(ValueError):
    """A key column has duplicates or nulls."""


def key_violations(df: DataFrame, key: str, within: Sequence[str] = ()) -> DataFrame:
    """Keys that occur more than once, or are null, per ``within``."""
    counts = df.groupBy(*(named(w) for w in within), named(key)).agg(F.count("*").alias("n_rows"))
    return counts.filter((F.col("n_rows") > 1) | named(key).isNull())


def check_key(df: DataFrame, key: str, kind: str = "metadata", within: Sequence[str] = ()) -> DataFrame:
    """Return ``df`` or raise. Looks for one violation only, so nothing large comes back."""
    if not key_violations(df, key, within).isEmpty():
        raise KeyViolation(MESSAGES.get(kind, MESSAGES["omics"]))
    return df
