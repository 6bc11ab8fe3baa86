"""Small text helpers: trimming, name lists, delimiters and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Candidate delimiters, the earlier one winning a tie.
DELIMITERS = (",", "\t", ";", " ")


def trim_blank(text: Column) -> Column:
    """Strip spaces, tabs and line ends."""
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def split_names(text: Column) -> Column:
    """Comma-separated names, trimmed, empty ones dropped; null text gives no names."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), trim_blank)
    return F.filter(parts, lambda name: name != "")


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"^[^\r\n]*", 0)


def likely_delimiter(line: Column) -> Column:
    """The most frequent candidate in a line; a comma when there is none."""
    counts = [F.regexp_count(line, F.lit(d)) for d in DELIMITERS]
    most = F.greatest(*counts)
    choice = F.when(line.isNull(), F.lit(None).cast("string"))
    for delimiter, count in zip(DELIMITERS, counts):
        choice = choice.when(count == most, F.lit(delimiter))
    return choice


def simple_delimiter(line: Column) -> Column:
    """A tab if there is one, else a comma if there is one, else blank for any whitespace."""
    return F.when(F.contains(line, F.lit("\t")), "\t").when(F.contains(line, F.lit(",")), ",").otherwise("")


def file_base_name(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"[^/]*$", 0), r"(.)\.[A-Za-z0-9]+$", "$1")


def file_extension(path: Column) -> Column:
    """Last extension in lower case, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
