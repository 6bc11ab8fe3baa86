"""Quality scores by a regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics (logs of sizes, log odds of shares).
Counts, sums and products of these vectors are folded per label: one small matrix per task and
label, added by Spark, is all that training needs of the corpus. Each label gets a mean and a
covariance that is shrunk towards a multiple of the identity, and its Cholesky factor is inverted
once and kept. A score is the logistic of the difference of the two log-densities: Mahalanobis
distances through the kept factors, log-determinants and the labels' shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from cohortlane.llm.frames import per_text
from cohortlane.llm.language_id import fold
from cohortlane.session import written

SHRINK = 0.05
THRESHOLD = 0.7
#: Variance below which a statistic counts as constant.
LEAST = 1e-6
KINDS = ("wide", "small", "capital", "digit", "blank", "newline", "stop", "call", "mark", "sign")
STATISTICS = (
    "bytes", "words", "word_length", "letters", "capitals", "digits", "stops", "calls", "marks", "signs", "wide",
    "distinct_words", "repeated_words", "distinct_lines", "entropy", "length_spread", "longest_word", "capital_words",
)


def byte_kinds() -> np.ndarray:
    """One row per byte with a one in the column of its kind; bytes of multi-byte characters are ``wide``."""
    table = np.zeros((256, len(KINDS)))
    for byte in range(256):
        char = chr(byte)
        if byte > 127:
            kind = "wide"
        elif char.islower():
            kind = "small"
        elif char.isupper():
            kind = "capital"
        elif char.isdigit():
            kind = "digit"
        elif char == "\n":
            kind = "newline"
        elif char.isspace():
            kind = "blank"
        elif char in ".,":
            kind = "stop"
        elif char in "!?":
            kind = "call"
        elif char in "'\"-:;()":
            kind = "mark"
        else:
            kind = "sign"
        table[byte, KINDS.index(kind)] = 1
    return table


def log_odds(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (whole - part + 0.5)))


class Statistics:
    """The transformed statistics of whole texts; null is the empty text."""

    def __init__(self) -> None:
        self.kinds = byte_kinds()

    def of(self, text: str | None) -> list[float]:
        data = (text or "").encode("utf-8")
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        wide, small, capital, digit, blank, newline, stop, call, mark, sign = (counts @ self.kinds).tolist()
        words, lines, size = data.split(), [line for line in data.split(b"\n") if line], len(data)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        shares = counts[counts > 0] / max(size, 1)
        letters = wide + small + capital
        return [
            float(np.log1p(size)),
            float(np.log1p(len(words))),
            float(np.log((size - blank - newline + 1) / (len(words) + 1))),
            log_odds(letters, size),
            log_odds(capital, letters),
            log_odds(digit, size),
            log_odds(stop, size),
            log_odds(call, size),
            log_odds(mark, size),
            log_odds(sign, size),
            log_odds(wide, size),
            log_odds(len(set(words)), len(words)),
            log_odds(sum(map(eq, words, words[1:])), max(len(words) - 1, 0)),
            log_odds(len(set(lines)), len(lines)),
            float(-(shares * np.log(shares)).sum()),
            float(np.log1p(lengths.std())) if words else 0.0,
            float(np.log1p(lengths.max())) if words else 0.0,
            log_odds(sum(word[:1].isupper() for word in words), len(words)),
        ]


def statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``features`` of every row."""
    add = StructType([StructField("features", ArrayType(DoubleType(), False))])

    def factory():
        found = Statistics().of
        return lambda texts: {"features": [found(t) for t in texts]}

    return per_text(df, [key], text, add, factory)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def label_moments(rows: DataFrame) -> dict[int, np.ndarray]:
    """Per label the sum of (1, x)(1, x)' over rows of ``features``, each as often as ``n0`` and ``n1`` say."""
    schema = StructType([StructField("label", IntegerType()), StructField("place", IntegerType()), StructField("total", DoubleType())])
    width = len(STATISTICS) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, width, width))
        for batch in batches:
            if len(batch):
                found = np.concatenate([np.ones((len(batch), 1)), matrix(batch.column("features"))], axis=1)
                for label in (0, 1):
                    held[label] += (found * batch.column(f"n{label}").to_numpy(zero_copy_only=False)[:, None]).T @ found
        for label in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(width * width, label, np.int32)), pa.array(np.arange(width * width, dtype=np.int32)), pa.array(held[label].ravel())], names=schema.names
            )

    found = {label: np.zeros(width * width) for label in (0, 1)}
    for row in rows.select("features", "n0", "n1").mapInArrow(run, schema).groupBy("label", "place").agg(F.sum("total").alias("total")).collect():
        found[row.label][row.place] = row.total
    return {label: total.reshape(width, width) for label, total in found.items()}


@dataclass
class Discriminant:
    """Two normal densities with cached inverse Cholesky factors; without a label to tell apart, a constant."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    constant: float | None = None

    @classmethod
    def learn(cls, moments: dict[int, np.ndarray], shrink: float = SHRINK) -> Discriminant:
        held = [moments[label][0, 0] for label in (0, 1)]
        width = len(moments[0]) - 1
        if not all(held):
            return cls(np.zeros(width), np.ones(width), np.zeros((2, width)), np.zeros((2, width, width)), np.zeros(2), (held[1] + 0.5) / (sum(held) + 1))
        whole = moments[0] + moments[1]
        centre = whole[0, 1:] / whole[0, 0]
        scale = np.sqrt(np.maximum(np.diag(whole)[1:] / whole[0, 0] - centre**2, LEAST))
        means, factors, offsets = [], [], []
        for label in (0, 1):
            n, sums = moments[label][0, 0], moments[label][0, 1:]
            mean = sums / n
            covariance = (moments[label][1:, 1:] / n - np.outer(mean, mean)) / np.outer(scale, scale)
            share = max(shrink, width / (n + width))  # few documents tell little about a covariance
            spread = max(np.trace(covariance) / width, LEAST)
            lower = np.linalg.cholesky((1 - share) * covariance + share * spread * np.eye(width))
            means.append((mean - centre) / scale)
            factors.append(np.linalg.inv(lower))
            offsets.append(np.log(n / whole[0, 0]) - np.log(np.diag(lower)).sum())
        return cls(centre, scale, np.stack(means), np.stack(factors), np.asarray(offsets))

    def scores(self, found: np.ndarray) -> np.ndarray:
        """The probability of label 1 of every row."""
        if self.constant is not None:
            return np.full(len(found), self.constant)
        placed = (found - self.centre) / self.scale
        logs = [self.offsets[label] - 0.5 * (((placed - self.means[label]) @ self.factors[label].T) ** 2).sum(axis=1) for label in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def quality_scores(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, shrink: float = SHRINK) -> DataFrame:
    """``key``, ``held_out``, ``score``, ``predicted`` of every row of ``df``.

    Learned from rows whose key has a label 0 or 1 and lies outside the held-out fold (crc32 of the
    key as text); a key with several labels counts with each, repeated rows count as often as they
    stand there, null keys are never learned from and not held out. Only the text decides a score.
    Null and empty texts are scored like any other, with the statistics of no bytes. Without labels
    of both kinds every score is the share of label 1, half a document added to either side. An
    empty table gives no rows; other columns are not read.
    """
    own = F.col(f"`{key}`")
    found = written(statistics(df, key, text), "statistics")
    known = labels.select(own.alias("__labelled"), F.col(f"`{label}`").alias("label")).filter(F.col("__labelled").isNotNull() & (fold(F.col("__labelled"), folds) != held_out))
    told = known.groupBy("__labelled").agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"))
    taught = found.join(told, own == F.col("__labelled"))
    model = Discriminant.learn(label_moments(taught), shrink)
    schema = StructType([found.schema[key], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    out = F.coalesce(fold(own, folds) == held_out, F.lit(False)).alias("held_out")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(matrix(batch.column("features"))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=schema.names)

    return found.select(own, out, "features").mapInArrow(run, schema)
