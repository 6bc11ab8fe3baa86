"""Availability predicates over boolean, numeric and text flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlane.functions.values import as_text, column, type_of

# Texts that say "available".
YES_WORDS = ("yes", "1", "true")
YES_WORDS_EXACT = ("1", "TRUE", "Yes", "yes")


def _typed(df: DataFrame, name: str, on_text) -> Column:
    kind, value = type_of(df, name), column(df, name)
    if isinstance(kind, T.BooleanType):
        hit = value
    elif isinstance(kind, T.NumericType):
        hit = value == 1
    else:
        hit = on_text(value.cast("string"))
    return F.coalesce(hit, F.lit(False))


def is_available(df: DataFrame, name: str) -> Column:
    """True for yes, 1 and true in any case; null is false and nothing is trimmed."""
    return _typed(df, name, lambda text: F.lower(text).isin(*YES_WORDS))


def is_available_exact(df: DataFrame, name: str) -> Column:
    """The case-sensitive set: ``true``, ``True`` and ``YES`` do not count."""
    return _typed(df, name, lambda text: text.isin(*YES_WORDS_EXACT))


def available_text(df: DataFrame, name: str) -> Column:
    """The flag as text where it is available, else null."""
    return F.when(is_available(df, name), as_text(df, name))


def cell_available(cell: Column) -> Column:
    """1 when a list cell holds a yes word or any non-empty text, else 0."""
    hit = F.exists(cell, lambda x: F.lower(x).isin(*YES_WORDS) | (F.length(x) > 0))
    return F.coalesce(hit, F.lit(False)).cast("int")
