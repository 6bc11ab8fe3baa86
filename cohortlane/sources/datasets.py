"""Feature matrices and stored datasets."""

from __future__ import annotations

import csv
import json
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.functions.names import syntactic_name
from cohortlane.functions.text import file_base_name, file_extension
from cohortlane.functions.values import named, to_number
from cohortlane.operators.constraints import KeyViolation, check_key, key_violations
from cohortlane.sources.delimited import SEPARATORS, layouts

LONG_KEY = ["dataset", "sample_id", "feature"]
#: Blocks of features that a stored dataset has; the number is part of what is stored.
BLOCKS = 64


def header_names(header: str, sep: str) -> list[str]:
    """The fields of a header line, as many as it has; an empty one is named by its place, ``V1`` for the first."""
    fields = next(csv.reader([header], delimiter=sep), [])
    return [name.strip() or f"V{place}" for place, name in enumerate(fields, 1)]


def matrix_rows(spark: SparkSession, paths: str | list[str], sep: str = ",", sample_column: str | None = None) -> DataFrame:
    """Rows of files with samples in rows and features in columns.

    Result: ``dataset``, ``sample_id``, ``features`` and ``cells``, the last two side by side. Files
    with the same header are read together, each header's names lying beside its own cells by place.
    Names are as written, ``NA`` among them; empty ones go by place, and a name that one header has
    twice raises. The header is the first line of each file, so a row that repeats it is a row.
    Everything stays text, so ids are as written; cells that are empty or ``NA`` are null, and so are
    those that a short row lacks. Quoted fields may hold separators, but no field may hold a line
    break. The sample column is the first of each file unless named; a file without that name has no
    sample ids. The headers pass the driver, as the file list does.
    """
    parts = []
    for kind in layouts(spark, paths, sep):
        names = header_names(kind.header, sep)
        place = 0 if sample_column is None else names.index(sample_column) if sample_column in names else None
        others = [i for i in range(len(names)) if i != place]
        features = [names[i] for i in others]
        repeated = [name for name, n in Counter(features).items() if n > 1]
        if repeated:
            raise KeyViolation(f"feature names that stand twice in a header: {', '.join(repeated[:5])}")
        columns = [f"c{i}" for i in range(len(names))]
        reader = spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).option("enforceSchema", True)
        reader = reader.option("sep", sep).option("nullValue", "NA").option("maxColumns", len(names) + 1)
        parts.append(reader.csv(list(kind.paths)).select(
            file_base_name(F.col("_metadata.file_path")).alias("dataset"),
            (F.lit(None).cast("string") if place is None else F.col(columns[place])).alias("sample_id"),
            F.from_json(F.lit(json.dumps(features)), "array<string>").alias("features"),
            F.array(*(F.col(columns[i]) for i in others)).cast("array<string>").alias("cells"),
        ))
    if not parts:
        return spark.createDataFrame([], "dataset string, sample_id string, features array<string>, cells array<string>")
    return reduce(DataFrame.unionByName, parts)


def read_matrices(spark: SparkSession, paths: str | list[str], sep: str = ",", sample_column: str | None = None, check: bool = True) -> DataFrame:
    """``matrix_rows`` in long form: ``dataset``, ``sample_id``, ``feature``, ``value``, ``value_text``.

    ``value`` is null where the text is not a number. A sample that a dataset holds more than once,
    or without a key, raises before any cell is made, unless ``check`` is off.
    """
    wide = matrix_rows(spark, paths, sep, sample_column)
    if check:
        check_key(wide, "sample_id", "omics", ["dataset"])
    pairs = F.arrays_zip(F.col("features").alias("feature"), F.col("cells").alias("value_text"))
    cells = wide.select("dataset", "sample_id", F.inline(pairs).alias("feature", "value_text"))
    return cells.select("dataset", "sample_id", "feature", to_number(F.col("value_text")).alias("value"), "value_text")


def unpivot_features(df: DataFrame, sample: str, features: list[str], dataset: str) -> DataFrame:
    """A wide matrix to ``dataset``, ``sample_id``, ``feature``, ``value``."""
    wide = df.select(F.lit(dataset).alias("dataset"), named(sample).cast("string").alias("sample_id"), *(
        named(f).cast("double").alias(f) for f in features
    ))
    return wide.unpivot(["dataset", "sample_id"], [named(f) for f in features], "feature", "value")


def array_features(df: DataFrame, sample: str, values: str, dataset: str, prefix: str = "f") -> DataFrame:
    """An array column to ``dataset``, ``sample_id``, ``feature``, ``value``."""
    cells = df.select(named(sample).cast("string").alias("sample_id"), F.posexplode(named(values)).alias("place", "value"))
    return cells.select(
        F.lit(dataset).alias("dataset"), "sample_id", F.concat(F.lit(prefix), "place").alias("feature"), F.col("value").cast("double").alias("value")
    )


def matrix_key_violations(rows: DataFrame) -> DataFrame:
    """Samples a dataset holds more than once, or without a key, of matrices with one row per sample."""
    return key_violations(rows, "sample_id", ["dataset"]).select("dataset", "sample_id")


def stored_name(prefix: str, base: str) -> str:
    return f"{syntactic_name(prefix)}_{syntactic_name(base)}"


def save_dataset(df: DataFrame, root: str, prefix: str, base: str, key: str | None = None, mode: str = "overwrite") -> str:
    """Check the key, write as parquet under a safe name and return the path."""
    if key is not None:
        check_key(df, key, prefix)
    path = f"{root.rstrip('/')}/{stored_name(prefix, base)}"
    df.write.mode(mode).parquet(path)
    return path


def feature_block(feature: Column) -> Column:
    """The block of a dataset that holds a feature: one of ``BLOCKS``, from its name alone."""
    return F.pmod(F.xxhash64(feature), F.lit(BLOCKS)).cast("int")


def save_matrices(long: DataFrame, root: str, prefix: str = "omics", mode: str = "append") -> str:
    """Write long matrices by dataset and block of features, so that reading one feature opens one block.

    Ranges of dataset, block, feature and sample spread a large dataset over many tasks and keep the
    small ones together, so that no task writes a file for every dataset. Within a file the cells lie
    by feature, so row groups of other features are passed over as well.
    """
    path = f"{root.rstrip('/')}/{syntactic_name(prefix)}"
    order = ["dataset", "block", "feature", "sample_id"]
    placed = long.withColumn("block", feature_block(F.col("feature")))
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("dataset", "block").parquet(path)
    return path


def load_feature(spark: SparkSession, path: str, feature: str, dataset: str | None = None) -> DataFrame:
    """The cells of one feature of stored matrices, of one dataset or of all; other blocks are not opened."""
    cells = spark.read.parquet(path).filter((F.col("block") == feature_block(F.lit(feature))) & (F.col("feature") == feature))
    return (cells if dataset is None else cells.filter(F.col("dataset") == dataset)).drop("block")


def ingest_matrices(spark: SparkSession, paths: str | list[str], root: str, sep: str = ",", sample_column: str | None = None, prefix: str = "omics", mode: str = "append") -> str:
    """Read matrix files, check each dataset's samples once per row, store the cells and return the path.

    A failed check raises before anything is written.
    """
    return save_matrices(read_matrices(spark, paths, sep, sample_column), root, prefix, mode)


def load_dataset(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A stored dataset; of a list, the first one."""
    return spark.read.parquet(paths if isinstance(paths, str) else paths[0])


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def new_files_only(arrivals: DataFrame, registry: DataFrame, name: str = "name", path: str = "path") -> DataFrame:
    """One arrival per name that the registry does not have yet; the smallest path wins."""
    fresh = arrivals.groupBy(name).agg(F.min(path).alias(path))
    return fresh.join(registry.select(name).distinct(), name, "left_anti")


def supported_files(listing: DataFrame, path: str = "path") -> DataFrame:
    """Files whose extension, in any case, can be read."""
    return listing.filter(file_extension(F.col(path)).isin(*SEPARATORS))
