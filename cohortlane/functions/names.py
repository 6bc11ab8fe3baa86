"""Cleaning of column and dataset names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

# Words that may not stand alone as a name.
RESERVED_WORDS = (
    "if", "else", "repeat", "while", "function", "for", "next", "break", "TRUE", "FALSE", "NULL", "Inf", "NaN", "NA",
    "NA_integer_", "NA_real_", "NA_complex_", "NA_character_", "in",
)


def syntactic_name(name: str | None) -> str:
    """A valid dotted name: illegal characters become ``.``, bad starts get an ``X``."""
    if name is None:
        return "NA."
    text = re.sub(r"[^\w.]", ".", name)
    if not re.match(r"[^\W\d_]|\.(?!\d)", text):
        text = "X" + text
    return text + "." if text in RESERVED_WORDS else text


def column_names(names: Iterable[str]) -> dict[str, str]:
    """Map unique Spark-friendly names (no dots) to the dotted display names."""
    shown: dict[str, str] = {}
    for name in names:
        display = syntactic_name(name)
        base = candidate = display.replace(".", "_")
        n = 1
        while candidate in shown:
            n += 1
            candidate = f"{base}_{n}"
        shown[candidate] = display
    return shown


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*column_names(df.columns))


def resolved(columns: Iterable[str], name: str) -> str | None:
    """The column called ``name``, or else the first whose cleaned form is the same, dots and underscores alike."""
    columns = list(columns)
    if name in columns:
        return name
    wanted = syntactic_name(name).replace(".", "_")
    return next((c for c in columns if syntactic_name(c).replace(".", "_") == wanted), None)
