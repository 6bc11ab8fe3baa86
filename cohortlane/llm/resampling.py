"""Importance resampling towards a target, with features counted once per distinct line.

Newlines cut texts into lines. Equal lines fold to one row with the number of their occurrences, and
the features (runs of words, hashed to buckets) of a distinct line are found once: times its
occurrences they give the corpus counts, times the buckets' gains they give the line's weight, which
goes back to the documents by the line's 128-bit hash. Runs of words that cross a line break are found
per document and added separately. A line that very many documents hold is one row of facts, joined
in even slices.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from cohortlane.llm.frames import ascii_lower
from cohortlane.operators.attach import attach
from cohortlane.operators.ranking import dense_order
from cohortlane.session import written

BUCKETS = 10_000
RUNS_HELD = 500_000
#: Word bytes stay, A-Z are lower-cased, all other ASCII separates; bytes of other characters are word bytes.
WORD_BYTES = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


class Buckets(dict):
    """Buckets by run of words, kept up to a bound."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, run: bytes) -> int:
        if len(self) >= RUNS_HELD:
            self.clear()
        found = self[run] = zlib.crc32(run) % self.buckets
        return found


def words_of(line: bytes) -> list[bytes]:
    return line.translate(WORD_BYTES).split()


def runs_within(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words."""
    found = list(words)
    for n in range(2, longest + 1):
        found += map(b" ".join, zip(*(words[i:] for i in range(n))))
    return found


def runs_across(lines: list[list[bytes]], longest: int) -> list[bytes]:
    """The runs of up to ``longest`` words that begin in one line and end in another."""
    words = [word for line in lines for word in line]
    at = [number for number, line in enumerate(lines) for _ in line]
    return [b" ".join(words[i : i + n]) for n in range(2, longest + 1) for i in range(len(words) - n + 1) if at[i] != at[i + n - 1]]


def lines_of(text: Column) -> Column:
    return F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), "\n", -1)


def line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def distinct_lines(df: DataFrame, text: str, longest: int, buckets: int) -> DataFrame:
    """``h1``, ``h2``, ``times``, ``n_words`` and the packed ``buckets`` of the features of every distinct line."""
    lines = df.select(F.explode(lines_of(F.col(f"`{text}`"))).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    plain = lines.select(*line_hashes(F.col("line")), "times", F.col("line").cast("binary").alias("line"))
    schema = StructType([StructField(n, LongType()) for n in ("h1", "h2", "times", "n_words")] + [StructField("buckets", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            counts, packed = [], []
            for line in batch.column("line").to_pylist():
                words = words_of(line)
                found = runs_within(words, longest)
                counts.append(len(words))
                packed.append(np.fromiter(map(known.__getitem__, found), "<u4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "times")), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=schema.names)

    return written(plain.mapInArrow(run, schema), "lines")


def document_lines(df: DataFrame, key: str, text: str, longest: int, buckets: int) -> DataFrame:
    """``row``, ``key``, the ``hashes`` of the lines and the packed buckets of the features ``across`` lines of every row."""
    own = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{key}`").alias("key"),
        F.transform(lines_of(F.col(f"`{text}`")), lambda line: F.struct(*line_hashes(line))).alias("hashes"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"),
    )
    if longest == 1:  # no feature crosses a line
        return written(own.select("row", "key", "hashes", F.lit(b"").alias("across")), "documents")
    schema = StructType([*own.drop("body").schema, StructField("across", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            packed = []
            for body in batch.column("body").cast(pa.binary()).to_pylist():
                found = runs_across([words_of(line) for line in body.split(b"\n")], longest)
                packed.append(np.fromiter(map(known.__getitem__, found), "<u4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "key", "hashes")), pa.array(packed, pa.binary())], names=schema.names)

    return written(own.mapInArrow(run, schema), "documents")


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in rows of packed ``buckets`` that stand ``times`` times."""
    schema = StructType([StructField("bucket", IntegerType()), StructField("n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            packed, times = batch.column("buckets").to_pylist(), batch.column("times").to_numpy()
            once = b"".join(p for p, n in zip(packed, times) if n == 1)
            held += np.bincount(np.frombuffer(once, "<u4"), minlength=buckets)
            for p, n in zip(packed, times):
                if n > 1:
                    held += n * np.bincount(np.frombuffer(p, "<u4"), minlength=buckets)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], names=schema.names)

    found = np.zeros(buckets, object)
    for row in rows.select("buckets", "times").mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[row.bucket] = row.n
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of its share in the target over its share in the corpus), one added to every count."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    found = [
        math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + buckets) / ((float(s) + 1) * (float(t_all) + buckets)))) for s, t in zip(corpus, target)
    ]
    return np.asarray(found, np.int64)


def weighed(rows: DataFrame, keep: list[str], gain: np.ndarray) -> DataFrame:
    """``keep``, ``n_features`` and ``weight`` of rows of packed ``buckets``."""
    schema = StructType([*(rows.schema[k] for k in keep), StructField("n_features", LongType()), StructField("weight", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(p, "<u4") for p in batch.column("buckets").to_pylist()]
            sizes, weights = [len(f) for f in found], [int(gain[f].sum()) for f in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=schema.names)

    return rows.select(*keep, "buckets").mapInArrow(run, schema)


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(``seed:key``); a null key is the text ``null``."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance_resample(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """``key``, ``n_features``, ``weight``, ``score``, ``rank`` of every row of ``df``; undrawn rows have no rank.

    Words are runs of digits, letters a-z (A-Z are lower-cased) and characters beyond ASCII;
    features are runs of 1 to ``longest`` words, repeats counted, hashed to ``buckets``. A row's
    weight is the sum of its features' gains and its score adds seeded Gumbel noise. Of the rows
    with ``least_words`` words or more, ``percent`` of a hundred with the highest scores are drawn,
    the smaller key first among equal scores. Null and empty texts have no features and weight 0.
    Rows with equal keys are rows of their own with the same noise, null keys have that of the text
    ``null`` and come last among equals. An empty table gives no rows, an empty target counts
    nothing. Other columns are not read.
    """
    lines = distinct_lines(df, text, longest, buckets)
    docs = document_lines(df, key, text, longest, buckets)
    across = docs.select("row", "key", F.col("across").alias("buckets"), F.lit(1).cast("long").alias("times"))
    corpus, wanted = bucket_counts(lines, buckets), bucket_counts(distinct_lines(target, target_text, longest, buckets), buckets)
    if longest > 1:
        corpus = corpus + bucket_counts(across, buckets)
        wanted = wanted + bucket_counts(document_lines(target, target_text, target_text, longest, buckets).select(F.col("across").alias("buckets"), F.lit(1).cast("long").alias("times")), buckets)
    gain = gains(corpus, wanted)
    facts = written(weighed(lines, ["h1", "h2", "times", "n_words"], gain), "weights")
    places = docs.select("row", "key", F.posexplode("hashes").alias("place", "line")).select("row", "key", "place", "line.*")
    parts = attach(places, facts, ["h1", "h2"], "times", [F.col("row"), F.col("place")], "inner").select("row", "key", "n_words", "n_features", "weight")
    if longest > 1:
        parts = parts.unionByName(weighed(across, ["row", "key"], gain).withColumn("n_words", F.lit(0).cast("long")))
    sums = parts.groupBy("row", "key").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")))
    scored = written(sums.withColumns({"score": F.col("weight") + noise(F.col("key"), seed), "able": F.col("n_words") >= least_words}), "scored")
    drawn = scored.filter("able").count() * percent // 100
    order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("key"), F.asc("row")]
    placed = dense_order(scored, order, "at")
    rank = F.when(F.col("able") & (F.col("at") <= drawn), F.col("at")).alias("rank")
    return placed.select(F.col("key").alias(key), "n_features", "weight", "score", rank)
