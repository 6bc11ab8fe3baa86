"""Delimited files of one layout or of several."""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlane.functions.text import DELIMITERS, likely_delimiter, simple_delimiter, trim_blank
from cohortlane.functions.values import named
from cohortlane.session import written
from cohortlane.sources.heads import file_heads

# Separators by extension; text files are looked into.
SEPARATORS = {"csv": ",", "tsv": "\t", "txt": None}


def first_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The first line of every file: ``path``, ``line``. Only the beginnings of the files are read."""
    return file_heads(spark, paths).select("path", "line")


def sniff_delimiters(spark: SparkSession, paths: str | list[str], simple: bool = False) -> DataFrame:
    """One row per file: ``path``, ``line`` and its ``delimiter``."""
    guess = simple_delimiter if simple else likely_delimiter
    return first_lines(spark, paths).withColumn("delimiter", guess(F.col("line")))


@dataclass(frozen=True)
class Layout:
    """Files with the same separator and the same first line."""

    separator: str
    header: str
    paths: tuple[str, ...]


def layouts(spark: SparkSession, paths: str | list[str], separator: str | None = None, simple: bool = False) -> list[Layout]:
    """The layouts among files; without a ``separator`` each file's first line is looked into.

    ``simple`` takes a tab if there is one, else a comma, else a blank. The file list passes the
    driver, as it does for any file scan.
    """
    heads = first_lines(spark, paths)
    guess = F.lit(separator) if separator is not None else (simple_delimiter if simple else likely_delimiter)(F.col("line"))
    found = heads.withColumn("separator", F.when(guess == "", " ").otherwise(guess)).groupBy("separator", "line").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return [Layout(row["separator"], row["line"], tuple(row["paths"])) for row in found.orderBy("separator", "line").collect()]


def read_delimited(spark: SparkSession, path: str | list[str], extension: str | None = None, schema: T.StructType | str | None = None, simple: bool = False) -> DataFrame:
    """A table with a header row; ``NA`` is null.

    The separator follows from the extension; text files are sniffed, by the ``simple`` rule if
    asked. A folder may mix separators, orders of columns and types: files with the same separator
    and header are read together, and the parts are united by column name. Without a schema the types
    are inferred, which is one more pass, and made common: whole numbers widen, other numbers are
    doubles, dates beside times are times, and what does not go together is text as it is written.
    A column that holds nothing in some files has the type it has in the others. With a schema its
    columns come back, null where a file has none; files of one column more or less are read too.
    """
    extension = (extension or os.path.splitext(path if isinstance(path, str) else path[0])[1].lstrip(".")).lower()
    if extension not in SEPARATORS:
        raise ValueError(f"unsupported file type: {extension}")
    kinds = layouts(spark, path, SEPARATORS[extension], simple)

    def reader(kind: Layout):
        return spark.read.option("header", True).option("sep", kind.separator).option("nullValue", "NA")

    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if not kinds:
            return spark.createDataFrame([], wanted)
        known = {f.name: f.dataType for f in wanted}
        parts = []
        for kind in kinds:
            names = reader(kind).csv(kind.paths[0]).columns
            own = T.StructType([T.StructField(name, known.get(name, T.StringType())) for name in names])
            read = reader(kind).schema(own).csv(list(kind.paths))
            parts.append(read.select(*(named(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted)))
        return reduce(DataFrame.union, parts)
    if not kinds:
        return spark.createDataFrame([], T.StructType([]))
    inferred = [reader(kind).option("inferSchema", True).csv(list(kind.paths)) for kind in kinds]
    if len(kinds) == 1:
        return inferred[0]
    shared = common_types([filled(part, inferred) for part in inferred])
    parts = []
    for kind, part in zip(kinds, inferred):
        typed = T.StructType([T.StructField(f.name, shared.get(f.name, T.StringType())) for f in part.schema])
        parts.append(reader(kind).schema(typed).csv(list(kind.paths)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def filled(part: DataFrame, others: list[DataFrame]) -> T.StructType:
    """The schema of ``part`` without columns that hold nothing and have another type elsewhere."""
    elsewhere = {f.name for other in others for f in other.schema if not isinstance(f.dataType, T.StringType)}
    asked = [f.name for f in part.schema if isinstance(f.dataType, T.StringType) and f.name in elsewhere]
    if not asked:
        return part.schema
    held = part.agg(*(F.count(named(name)).alias(f"n{i}") for i, name in enumerate(asked))).first()
    empty = {name for i, name in enumerate(asked) if not held[i]}
    return T.StructType([f for f in part.schema if f.name not in empty])


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds both as they are read."""
    if a == b:
        return a
    whole = (T.IntegerType, T.LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    moments = (T.DateType, T.TimestampType)
    if isinstance(a, moments) and isinstance(b, moments):
        return T.TimestampType()
    return T.StringType()


def common_types(schemas: list[T.StructType]) -> dict[str, T.DataType]:
    """One type per column name."""
    found: dict[str, T.DataType] = {}
    for f in (f for schema in schemas for f in schema):
        found[f.name] = wider(found.get(f.name, f.dataType), f.dataType)
    return found


def safe_preview(spark: SparkSession, path: str, rows: int = 5, columns: int | None = None) -> DataFrame:
    """The first rows of a file, or one row with the error.

    Only the beginning of the file is read, and types are inferred from the lines shown alone. These
    pass the driver, where an error of any kind is met.
    """
    try:
        extension = os.path.splitext(path)[1].lstrip(".").lower()
        if extension not in SEPARATORS:
            raise ValueError(f"unsupported file type: {extension}")
        lines = [row["line"] for row in file_heads(spark, path, rows + 1).orderBy("line_no").collect()]
        first = spark.createDataFrame([(lines[0] if lines else "",)], "line string")
        separator = SEPARATORS[extension] or first.select(likely_delimiter(F.col("line"))).first()[0]
        reader = spark.read.option("sep", separator).option("nullValue", "NA")
        names = reader.option("header", True).csv(spark.sparkContext.parallelize(lines[:1], 1)).columns
        # Parsed without the header line, so that a row that repeats it is a row.
        body = spark.sparkContext.parallelize(lines[1:], 1)
        types = [f.dataType for f in reader.option("header", False).option("inferSchema", True).csv(body).schema] if lines[1:] else []
        layout = T.StructType([T.StructField(name, types[i] if i < len(types) else T.StringType()) for i, name in enumerate(names)])
        shown = reader.option("header", False).schema(layout).csv(body)
        return shown.select(*(named(c) for c in shown.columns[:columns]))
    except Exception as error:
        return spark.createDataFrame([(str(error).splitlines()[0],)], "error string")


def folder_previews(spark: SparkSession, paths: str | list[str], rows: int = 5) -> DataFrame:
    """``path``, ``row_no``, ``names`` and ``cells`` of the first rows of every file, read by its own delimiter.

    Cells are text as written; a cell that is empty or ``NA`` is null. A quoted field may hold the delimiter.
    """
    heads = file_heads(spark, paths, rows + 1)
    first = heads.filter("line_no = 1").select("path", "line", likely_delimiter(F.col("line")).alias("mark"))
    widest = first.agg(F.max(F.greatest(*(F.regexp_count("line", F.lit(d)) for d in DELIMITERS)))).first()[0]
    names = [f"c{i}" for i in range((widest or 0) + 1)]
    layout = ", ".join(f"{n} string" for n in names)

    def cells(line: Column, **options: str) -> Column:
        read = F.lit(None)
        for mark in DELIMITERS:
            parsed = F.from_csv(line, F.lit(layout), {"sep": mark, **options})
            read = F.when(F.col("mark") == mark, F.array(*(parsed[n] for n in names))).otherwise(read)
        return read

    headed = heads.join(first.select("path", "mark", F.col("line").alias("head")), "path").filter("line_no > 1")
    told = headed.withColumns({"names": cells(F.col("head")), "cells": cells(F.col("line"), nullValue="NA")})
    size = F.size(F.filter("names", lambda n: n.isNotNull()))
    return told.select("path", (F.col("line_no") - 1).alias("row_no"), F.slice("names", 1, size).alias("names"), F.slice("cells", 1, size).alias("cells"))


def read_names(spark: SparkSession, path: str, skip_header: bool = False, extension: str | None = None) -> DataFrame:
    """Modality names from a csv or tsv table (all cells) or a text file (one per line)."""
    extension = (extension or os.path.splitext(path)[1].lstrip(".")).lower()
    if extension in ("csv", "tsv"):
        table = spark.read.option("header", skip_header).option("sep", SEPARATORS[extension]).csv(path)
        return flatten_names(table)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    if skip_header:
        # Written, since the numbers would differ in a second evaluation.
        numbered = written(lines.withColumn("line_no", F.monotonically_increasing_id()), "names")
        heads = numbered.filter("at = 0").groupBy("path").agg(F.min("line_no").alias("line_no"))
        lines = numbered.join(heads, ["path", "line_no"], "left_anti")
    return flatten_names(lines.select("value"))


def flatten_names(table: DataFrame) -> DataFrame:
    """All cells of a table as trimmed names, empty ones dropped."""
    cells = F.array(*(F.col(f"`{c}`").cast("string") for c in table.columns))
    return table.select(F.explode(cells).alias("name")).select(trim_blank(F.col("name")).alias("name")).filter("name <> ''")

