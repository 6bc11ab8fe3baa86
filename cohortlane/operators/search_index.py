"""Search by an index of letter triples per block of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.operators.search import shown_text, table_search
from cohortlane.functions.values import named

#: Rows of a block; a search reads blocks whole.
BLOCK_ROWS = 100_000
LETTERS = 3


def triples(text: Column) -> Column:
    """The distinct runs of three characters of a text; shorter texts have none."""
    places = F.when(F.char_length(text) >= LETTERS, F.sequence(F.lit(1), F.char_length(text) - (LETTERS - 1)))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.substr(text, i, F.lit(LETTERS))))


def write_search_index(df: DataFrame, root: str, order_by: list[str], block_rows: int = BLOCK_ROWS) -> str:
    """Write ``df`` in blocks of about ``block_rows`` rows, and which triples each block has; return ``root``.

    Blocks are ranges of ``order_by``, so rows that look alike lie together. The triples of a row's
    shown cells are folded to one row per block and triple before they are shuffled, and lie sorted
    by triple, so that a search opens only the row groups of its own triples.
    """
    blocks = max(1, -(-df.count() // block_rows))
    placed = df.repartitionByRange(blocks, *(named(c) for c in order_by)).sortWithinPartitions(*(named(c) for c in order_by))
    boxed = placed.select(F.struct("*").alias("row"), F.spark_partition_id().alias("block"))
    boxed.write.partitionBy("block").parquet(f"{root}/rows")
    boxed.limit(0).coalesce(1).write.parquet(f"{root}/layout")  # an index of no rows has columns too
    rows = df.sparkSession.read.schema(boxed.schema).parquet(f"{root}/rows")
    text = shown_text(rows.select("row.*"), "row")
    held = rows.select("block", F.explode(triples(text)).alias("triple")).distinct()
    held.repartitionByRange("triple", "block").sortWithinPartitions("triple", "block").write.parquet(f"{root}/triples")
    return root


def searched_blocks(spark: SparkSession, root: str, query: str) -> list[int] | None:
    """The blocks that have all triples of the words of ``query``; None if no word has three characters.

    One number per block passes the driver, as in a listing of files.
    """
    wanted = sorted({word[i : i + LETTERS] for word in query.lower().split() for i in range(len(word) - LETTERS + 1)})
    if not wanted:
        return None
    found = spark.read.parquet(f"{root}/triples").filter(F.col("triple").isin(wanted)).groupBy("block").agg(F.count_distinct("triple").alias("n"))
    return [row["block"] for row in found.filter(F.col("n") == len(wanted)).orderBy("block").collect()]


def indexed_search(spark: SparkSession, root: str, query: str) -> DataFrame:
    """The rows of ``table_search`` from the blocks that can have them; other blocks are not opened."""
    blocks = searched_blocks(spark, root, query)
    layout = spark.read.parquet(f"{root}/layout")
    if blocks is None:
        stored = spark.read.schema(layout.schema).parquet(f"{root}/rows")
    else:
        reader = spark.read.schema(layout.drop("block").schema)
        stored = reader.parquet(*(f"{root}/rows/block={b}" for b in blocks)) if blocks else layout.filter("false")
    return table_search(stored.select("row.*"), query)
