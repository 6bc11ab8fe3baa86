"""Typed casts, number texts and missing labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

# Labels that count as missing, in lower case.
MISSING_WORDS = ("none", "unknown", "missing", "na")

# Fixed value: what a label loses at its end.
LABEL_TAIL = r",\d+(\)?)$"


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def column(df: DataFrame, name: str) -> Column:
    """The column called exactly ``name``, dots and all, with NaN read as missing."""
    return without_nan(type_of(df, name), named(name))


def without_nan(kind: T.DataType, value: Column) -> Column:
    return F.when(~F.isnan(value), value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def number_text(number: Column) -> Column:
    """A double as people write it: ``1`` for 1.0, at most 15 significant digits."""
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(1e15))
    digits = F.format_string("%.15g", number)
    return (
        F.when(number.isNull(), F.lit(None).cast("string"))
        .when(whole, number.cast("bigint").cast("string"))
        .otherwise(F.regexp_replace(F.regexp_replace(digits, r"(\.\d*?)0+(?=$|e)", "$1"), r"\.(?=$|e)", ""))
    )


def as_text(df: DataFrame, name: str) -> Column:
    """A value as text; doubles without a trailing ``.0``, booleans in capitals."""
    return as_text_of(df, name, named(name))


def as_text_of(df: DataFrame, name: str, value: Column) -> Column:
    """``as_text`` of a value that stands elsewhere and has the type of ``name``."""
    kind = type_of(df, name)
    value = without_nan(kind, value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return number_text(value.cast("double"))
    if isinstance(kind, T.BooleanType):
        return F.upper(value.cast("string"))
    return value.cast("string")


def is_number_text(text: Column) -> Column:
    return text.rlike(NUMBER)


def to_number(text: Column) -> Column:
    """Text to double; anything that is not wholly a number gives null."""
    return F.when(is_number_text(text), F.trim(text).try_cast("double"))


def is_missing_label(text: Column) -> Column:
    return text.isNull() | (text == "") | F.lower(text).isin(*MISSING_WORDS)


def none_label(text: Column) -> Column:
    """Missing labels of any spelling become ``None``."""
    return F.when(is_missing_label(text), F.lit("None")).otherwise(text)


def missing_label(text: Column) -> Column:
    """Only nulls become ``Missing``."""
    return F.coalesce(text, F.lit("Missing"))


def legacy_label(label: Column) -> Column:
    """Drop a trailing ``,digits`` of a label, keeping a closing round bracket."""
    return F.regexp_replace(label, LABEL_TAIL, "$1")


def percent_text(part: Column, whole: Column) -> Column:
    """A share as a percentage with one decimal, halves to even."""
    return F.format_string("%.1f%%", F.bround(part / whole * 1000, 0) / 10)
