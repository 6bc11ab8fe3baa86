"""Looking into tables: search, preview and profile."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.values import as_text, as_text_of, named


def shown_text(df: DataFrame, within: str | None = None) -> Column:
    """All shown cells of a row of ``df`` in lower case; ``within`` names the struct that holds its columns."""
    cells = [as_text(df, c) if within is None else as_text_of(df, c, F.col(within).getField(c)) for c in df.columns]
    return F.lower(F.concat_ws(" ", *cells))


def table_search(df: DataFrame, query: str) -> DataFrame:
    """Rows whose shown cells contain every word of ``query`` in any case."""
    text = shown_text(df)
    return reduce(lambda found, word: found.filter(F.contains(text, F.lit(word))), query.lower().split(), df)


def preview(df: DataFrame, order_by: list[str], rows: int = 5, columns: int | None = None) -> DataFrame:
    """The first rows in a given order; Spark keeps only that many per task."""
    shown = df.columns[:columns] if columns else df.columns
    return df.orderBy(*(named(c) for c in order_by)).limit(rows).select(*(named(c) for c in shown))


def dataset_profile(df: DataFrame) -> DataFrame:
    """Number of rows and columns."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))
