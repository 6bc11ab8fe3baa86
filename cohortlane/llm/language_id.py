"""Language identification by error-correcting output codes.

Every language has a codeword. For every bit, a binary classifier over character n-grams tells the
languages with the bit set from the others: its weights are log odds of n-gram shares. Counts come
from all training documents, one row per task, language and n-gram bucket. A text's bits are
decoded by loss: each codeword's losses are weighted by how well that bit's classifier separates
the language, and the nearest codeword wins. A text about as near to a second one is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from cohortlane.llm.frames import per_text

BUCKETS = 1 << 14
#: Odd multipliers for the characters of an n-gram.
FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
UNKNOWN = "und"
SMOOTH = 0.5
#: How much nearer the nearest codeword must be, as a share of the distance to the second.
AMBIGUOUS = 0.02
#: How many times farther than any training text of its size a text may be from its codeword.
BEYOND = 1.25
#: Size classes: texts by the number of bits of their number of n-grams. Up to class ``SHORT`` none is rejected.
SIZES = 48
SHORT = 7


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters; one table per Python worker."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Buckets of the n-grams of one to three characters; runs of other characters count as one space."""

    def __init__(self) -> None:
        self.letters = letters()

    def of(self, text: str | None) -> np.ndarray | None:
        """Counts by bucket, or None without any letter."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = self.letters[codes]
        if not letter.any():
            return None
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first other character after a letter stands for the whole run
        line = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint32)
        line = np.concatenate([[np.uint32(32)], line]).astype(np.uint32)
        found = []
        mixed = np.zeros(len(line), np.uint32)
        for n in range(3):
            if n < len(line):
                mixed = mixed[: len(line) - n] * FACTORS[0] + line[n:] * FACTORS[n]
                mixed ^= mixed >> np.uint32(15)
                found.append((mixed * FACTORS[1] >> np.uint32(18)).astype(np.int64))
        return np.bincount(np.concatenate(found), minlength=BUCKETS)


def codewords(n: int) -> np.ndarray:
    """One row of +1 and -1 per language. All ways to split up to seven languages in two; beyond, a seeded random code."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 1 << n - 1)
        bits = splits[None, :] >> np.arange(n)[:, None] & 1
    else:
        rng = np.random.default_rng(n)
        bits = rng.integers(0, 2, (n, int(15 * np.ceil(np.log2(n)))))
        bits = bits[:, (bits.min(0) == 0) & (bits.max(0) == 1)]
    return bits * 2.0 - 1


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    importance: np.ndarray
    scale: np.ndarray
    evidence: np.ndarray

    @classmethod
    def learn(cls, counts: dict[str, np.ndarray]) -> CodeModel:
        languages = sorted(counts)
        code = codewords(len(languages))
        shares = np.stack([(counts[name] + SMOOTH) / (counts[name].sum() + SMOOTH * BUCKETS) for name in languages]) if languages else np.zeros((0, BUCKETS))
        weights = np.zeros((BUCKETS, code.shape[1]))
        for bit in range(code.shape[1]):
            sides = [shares[code[:, bit] == side] for side in (1, -1)]
            if all(len(side) for side in sides):
                weights[:, bit] = np.log(sides[0].mean(0)) - np.log(sides[1].mean(0))
        margins = shares @ weights * code if languages else np.zeros((0, code.shape[1]))
        scale = np.maximum(np.abs(margins).mean(0), 1e-9) if languages else np.ones(code.shape[1])
        importance = np.maximum(margins, 1e-9)
        importance /= np.maximum(importance.sum(1, keepdims=True), 1e-9)
        evidence = shares @ weights / scale if languages else np.zeros((0, code.shape[1]))
        return cls(languages, code, weights.astype(np.float32), importance, scale, evidence)

    def decode(self, counts: np.ndarray | None) -> tuple[str, float, bool, float, int]:
        """Language, score, whether another one is about as near, the distance to its codeword and the size class of the text."""
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True, 0.0, 0
        size = int(counts.sum()).bit_length()
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False, 0.0, size
        at = np.flatnonzero(counts)
        bits = counts[at] @ self.weights[at] / counts.sum() / self.scale
        losses = np.exp(-np.clip(self.code * bits, -20, 20))
        distances = (self.importance * losses).sum(1)
        order = np.argsort(distances, kind="stable")
        nearest, second = distances[order[0]], distances[order[1]]
        near = np.exp(-4 * (distances - nearest) / max(nearest, 1e-9))
        return self.languages[order[0]], float(1 / near.sum()), bool(second - nearest <= AMBIGUOUS * second), float(nearest), size


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


def gram_counts(df: DataFrame, text: str, label: str) -> dict[str, np.ndarray]:
    """Counts by language: every task folds its documents to one row per language and bucket met."""
    schema = StructType([StructField("lang", StringType()), StructField("bucket", IntegerType()), StructField("n", LongType())])
    plain = df.filter(F.col(f"`{label}`").isNotNull()).select(F.col(f"`{label}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held = Grams(), {}
        for batch in batches:
            for lang, value in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                counts = grams.of(value)
                if counts is not None:
                    held[lang] = held[lang] + counts if lang in held else counts
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=schema.names)

    folded = plain.mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for row in folded.toLocalIterator():
        found.setdefault(row.lang, np.zeros(BUCKETS))[row.bucket] = row.n
    return found


def identify(df: DataFrame, model: CodeModel, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, ``lang_pred``, ``score``, ``ambiguous``, ``distance``, ``size`` of every row; only the text is looked at."""
    add = StructType([
        StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("ambiguous", BooleanType()),
        StructField("distance", DoubleType()), StructField("size", IntegerType()),
    ])

    def factory():
        grams = Grams()

        def compute(texts: list) -> dict:
            found = [model.decode(grams.of(t)) for t in texts]
            return {name: [f[i] for f in found] for i, name in enumerate(add.names)}

        return compute

    return per_text(df, keep, text, add, factory)


def language_id(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", folds: int = 4, held_out: int = 2) -> DataFrame:
    """``key``, ``held_out``, ``lang_pred``, ``score``, ``ambiguous`` of every row.

    Learned from the texts and labels of all labelled rows outside the held-out fold (crc32 of the
    key as text). Texts that are null or have no letter are ``und`` with score 0, as is everything
    when nothing can be learned; they count as ambiguous. With one language learned it is always
    that one. Repeated rows count as often as they stand there. Rows with a null key are not held
    out. An empty table gives no rows.
    """
    out = F.coalesce(fold(F.col(f"`{key}`"), folds) == held_out, F.lit(False))
    model = CodeModel.learn(gram_counts(df.filter(~out), text, label))
    return identify(df, model, [key], text).select(F.col(f"`{key}`"), out.alias("held_out"), "lang_pred", "score", "ambiguous")


def mixed_distance(model: CodeModel) -> float:
    """How far from the nearest codeword an even mixture of two languages can be."""
    found = [0.0]
    for i, one in enumerate(model.evidence):
        for other in model.evidence[i + 1 :]:
            losses = np.exp(-np.clip(model.code * (one + other) / 2, -20, 20))
            found.append(float((model.importance * losses).sum(1).min()))
    return max(found)


def reaches(df: DataFrame, model: CodeModel, text: str, label: str) -> dict[str, np.ndarray]:
    """Per language and size class the largest distance to its codeword among all training texts of that size or larger that decode to it.

    A class beyond the largest text of a language has the reach of that one.
    """
    told = df.filter(F.col(f"`{label}`").isNotNull()).select(F.lit(0).alias("one"), F.col(f"`{text}`").alias("body"))
    found = {name: np.zeros(SIZES) for name in model.languages}
    seen_texts = identify(told, model, ["one"], "body").filter(F.col("lang_pred") != UNKNOWN)
    for row in seen_texts.groupBy("lang_pred", "size").agg(F.max("distance").alias("reach")).collect():
        found[row.lang_pred][min(row.size, SIZES - 1)] = row.reach
    for name, seen in found.items():
        largest = int(np.flatnonzero(seen).max(initial=0))
        seen[largest:] = seen[largest]
        found[name] = np.maximum.accumulate(seen[::-1])[::-1]
    return found


def drop_unidentified(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The rows of ``docs`` in one of the languages learned, with all their columns; all rows when nothing can be learned.

    A text goes when it has no letter, or when even the nearest codeword is farther away, by more than
    ``BEYOND`` times, than from any training text of its size or larger that decodes to that language,
    and farther than from an even mixture of two languages: text in no language learned. Documents in
    two of them stay, and so do texts of fewer than ``2 ** SHORT`` n-grams, which tell too little.
    Columns of ``docs`` may have any names.
    """
    out = F.coalesce(fold(F.col(f"`{key}`"), 4) == 2, F.lit(False))
    taught = docs.filter(~out)
    model = CodeModel.learn(gram_counts(taught, text, label))
    if not model.languages:
        return docs
    limits = reaches(taught, model, text, label)
    least = mixed_distance(model)
    limit = F.coalesce(*(
        F.when(F.col("lang_pred") == name, F.get(F.array(*map(F.lit, np.maximum(BEYOND * reach, least).tolist())), F.least("size", F.lit(SIZES - 1))))
        for name, reach in limits.items()
    ))
    others = [c for c in docs.columns if c != text]  # boxed, so that their names are free; the text goes beside them, once
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("body"))
    stays = (F.col("lang_pred") != UNKNOWN) & ((F.col("size") <= SHORT) | (F.col("distance") <= limit))
    kept = identify(boxed, model, ["row", "body"], "body").filter(stays)
    return kept.select(*[F.col("body" if c == text else f"row.`{c}`").alias(c) for c in docs.columns])
