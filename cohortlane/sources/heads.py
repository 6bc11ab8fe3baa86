"""The first lines of files, without reading on."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.session import table_folder

#: Bytes read of a file at a time.
PORTION = 1 << 16
HEAD = "path string, line_no int, line string"
LINE_END = re.compile(rb"\r\n|\n|\r")
MARK = b"\xef\xbb\xbf"


def opened(path: str):
    """A stream over a file of any store that Arrow reaches, decompressed by its extension."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        local = "/" + (rest if rest else path).lstrip("/")
        return fs.LocalFileSystem().open_input_stream(local, compression="detect", buffer_size=0)
    store, inside = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1).replace("s3n:", "s3:", 1))
    return store.open_input_stream(inside, compression="detect", buffer_size=0)


def first_lines_of(path: str, lines: int) -> list[str]:
    """At most ``lines`` lines from the beginning of a file; portions are read until these are whole."""
    held = b""
    with opened(path) as stream:
        while True:
            portion = stream.read(PORTION)
            held += portion
            ends = [m.end() for m in LINE_END.finditer(held)]
            # A carriage return at the end of what is read may be half of a line's end.
            whole = ends[:-1] if portion and ends and held.endswith(b"\r") and ends[-1] == len(held) else ends
            if len(whole) >= lines or not portion:
                break
    found, begin = [], len(MARK) if held.startswith(MARK) else 0
    for end in whole[:lines]:
        found.append(LINE_END.sub(b"", held[begin:end]))
        begin = end
    if len(found) < lines and begin < len(held):
        found.append(held[begin:])
    return [line.decode("utf-8", "replace") for line in found]


def reachable(path: str) -> bool:
    try:
        first_lines_of(path, 1)
        return True
    except Exception:
        return False


def file_heads(spark: SparkSession, paths: str | list[str], lines: int = 1) -> DataFrame:
    """``path``, ``line_no`` from 1 and ``line`` of the first ``lines`` lines of every file.

    Files are listed by Spark, spread over tasks, and each is opened and read portion by portion until
    its lines are whole, whatever its length. In a store that Spark reads and Arrow does not, the
    files are scanned, with the same result. Empty files have no lines. The heads are written once
    and read back.
    """
    # Folders are looked through as they are; names like key=value in paths make no columns.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path")
    one = files.first()
    if one is not None and not reachable(one["path"]):
        heads = scanned_heads(spark, paths, lines)
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(path, number, line) for path in batch.column("path").to_pylist() for number, line in enumerate(first_lines_of(path, lines), 1)]
                columns = list(zip(*found)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], names=["path", "line_no", "line"])

        heads = files.repartition(F.col("path")).mapInArrow(run, HEAD)
    folder = f"{table_folder(spark)}/heads-{uuid.uuid4().hex}"
    heads.write.parquet(folder)
    return spark.read.schema(HEAD).parquet(folder)


def scanned_heads(spark: SparkSession, paths: str | list[str], lines: int) -> DataFrame:
    """The same from a scan of the whole files; of the first split of each, a task keeps the first lines it meets."""
    text = spark.read.option("recursiveFileLookup", True).text(paths)
    plain = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            kept, numbers = [], []
            for i, path in enumerate(batch.column("path").to_pylist()):
                seen[path] += 1
                if seen[path] <= lines:
                    kept.append(i)
                    numbers.append(seen[path])
            chosen = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column("path"), pa.array(numbers, pa.int32()), chosen.column("line")], names=["path", "line_no", "line"])

    return plain.filter("at = 0").mapInArrow(run, HEAD)
