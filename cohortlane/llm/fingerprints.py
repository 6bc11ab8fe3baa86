"""Document fingerprints from prefix polynomial hashes.

The hash of the first i code points is kept for every i, modulo two primes. The hash of any span is
then a difference of two prefixes, so any two spans are compared in constant time, and the longest
common extension of two places is found by binary search. The edited text is never hashed: its
prefixes are those of its two parts, shifted.

A fingerprint holds the length, the hash of the whole text, samples of the prefix hashes at
multiples of a power of two from the front and from the back, and the hash and length of every block
of the text. Blocks begin where the hash of the next ``WINDOW`` characters is one of ``BLOCK``, so
their places move with the text and their number grows with it. The likeness of two fingerprints is
the share of the longer text that common blocks cover, as multisets, or that their longest common
prefix and suffix and equal aligned samples between them cover, whichever is more.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: Two primes under 2**31, so that products fit 64 bits, and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
SAMPLES = 64
#: Characters that decide whether a block begins, and one place in how many does.
WINDOW = 8
BLOCK = 32
RANGE_BYTES = 32 << 20
#: Stands for a null key, below all others.
NO_KEY = -(1 << 63)


class Powers:
    """Powers of the bases, grown by doubling up to the longest text met."""

    def __init__(self, bases: tuple[int, int]) -> None:
        self.bases = bases
        self.table = np.ones((2, 1), np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while self.table.shape[1] <= n:
            factor = [int(self.table[k, -1]) * self.bases[k] % PRIMES[k] for k in (0, 1)]
            self.table = np.concatenate([self.table, np.stack([self.table[k] * np.uint64(factor[k]) % np.uint64(PRIMES[k]) for k in (0, 1)])], 1)
        return self.table


POWERS = Powers(BASES)
INVERSES = Powers(tuple(pow(b, -1, p) for b, p in zip(BASES, PRIMES)))


@dataclass
class Prefixes:
    """Prefix hashes of one text: ``sums[k, i]`` is the sum of c[j] * base**j over j < i, modulo prime k."""

    sums: np.ndarray

    @property
    def n(self) -> int:
        return self.sums.shape[1] - 1

    @classmethod
    def of(cls, text: str) -> Prefixes:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        powers = POWERS.upto(len(codes))
        sums = np.zeros((2, len(codes) + 1), np.uint64)
        for k in (0, 1):
            terms = codes * powers[k, : len(codes)] % np.uint64(PRIMES[k])
            sums[k, 1:] = np.cumsum(terms) % np.uint64(PRIMES[k])
        return cls(sums)

    def span(self, begin: int, end: int, at: int) -> tuple[int, int]:
        """Hash of a span as if it began at place ``at``, which is ``begin`` or later."""
        powers = POWERS.upto(at)
        return tuple(int((int(self.sums[k, end]) - int(self.sums[k, begin])) % PRIMES[k] * int(powers[k, at - begin]) % PRIMES[k]) for k in (0, 1))

    def joined(self, keep: int, other: Prefixes, take: int) -> Prefixes:
        """Prefixes of this text's first ``keep`` characters and the other's first ``take``."""
        powers = POWERS.upto(keep)
        sums = np.empty((2, keep + take + 1), np.uint64)
        sums[:, : keep + 1] = self.sums[:, : keep + 1]
        for k in (0, 1):
            shifted = other.sums[k, 1 : take + 1] * powers[k, keep] % np.uint64(PRIMES[k])
            sums[k, keep + 1 :] = (shifted + self.sums[k, keep]) % np.uint64(PRIMES[k])
        return Prefixes(sums)

    def common(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest common extension of place ``i`` here and ``j`` there."""
        low, high = 0, min(self.n - i, other.n - j)
        at = max(i, j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(i, i + middle, at) == other.span(j, j + middle, at):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, begins: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        """Hashes modulo prime k of many spans as if each began at place 0."""
        prime = np.uint64(PRIMES[k])
        apart = (self.sums[k, ends] + prime - self.sums[k, begins]) % prime
        return apart * INVERSES.upto(self.n)[k, begins] % prime

    def blocks(self) -> np.ndarray:
        """Hash and length of every block, in order; a block's hash takes in the window that ends it."""
        if not self.n:
            return np.zeros((0, 2), "<u4")
        places = np.arange(max(0, self.n - WINDOW + 1))
        windows = self.spans(places, places + WINDOW, 0)
        chosen = (windows * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(BLOCK) == 0
        chosen[1:] &= windows[1:] != windows[:-1]  # a run of one character begins a block once
        begins = np.concatenate([[0], np.flatnonzero(chosen[1:]) + 1])
        ends = np.append(begins[1:], self.n)
        reach = np.minimum(ends + WINDOW, self.n)
        mixed = self.spans(begins, reach, 0) << np.uint64(31) | self.spans(begins, reach, 1)
        return np.stack([mixed * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32), (ends - begins).astype(np.uint64)], 1).astype("<u4")

    def fingerprint(self) -> str:
        step = 1
        while step * SAMPLES < self.n:
            step *= 2
        places = np.arange(step, self.n + 1, step)
        front = self.sums[:, places]
        ends = self.n - places
        # The last characters, as if the text's end were always the same place: told apart by a power of the base only.
        inverse = [pow(BASES[k], -1, PRIMES[k]) for k in (0, 1)]
        back = np.empty_like(front)
        for k in (0, 1):
            spans = (self.sums[k, self.n] + np.uint64(PRIMES[k]) - self.sums[k, ends]) % np.uint64(PRIMES[k])
            back[k] = spans * np.uint64(pow(inverse[k], self.n, PRIMES[k])) % np.uint64(PRIMES[k])
        whole = self.sums[:, self.n]
        numbers = np.concatenate([whole, front.T.ravel(), back.T.ravel()]).astype("<u4")
        coded = [base64.b64encode(part.tobytes()).decode("ascii") for part in (numbers, self.blocks())]
        return f"{self.n:x}-{step:x}-{coded[0]}-{coded[1]}"


@dataclass
class Fingerprint:
    n: int
    step: int
    whole: tuple[int, int]
    front: np.ndarray
    back: np.ndarray
    blocks: np.ndarray

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        n, step, numbers, blocks = text.split("-", 3)
        values = np.frombuffer(base64.b64decode(numbers), "<u4")
        half = (len(values) - 2) // 2
        front, back = values[2 : 2 + half].reshape(-1, 2), values[2 + half :].reshape(-1, 2)
        return cls(int(n, 16), int(step, 16), (int(values[0]), int(values[1])), front, back, np.frombuffer(base64.b64decode(blocks), "<u8"))

    def at(self, side: str, step: int) -> np.ndarray:
        skip = step // self.step
        return getattr(self, side)[skip - 1 :: skip]


def shared_samples(a: np.ndarray, b: np.ndarray) -> int:
    """How many samples agree from the start on, by binary search: longer prefixes agree only if shorter do."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if (a[middle - 1] == b[middle - 1]).all():
            low = middle
        else:
            high = middle - 1
    return low


def equal_blocks(a: np.ndarray, b: np.ndarray, begin: int) -> int:
    """Blocks after sample ``begin`` whose own hashes agree; both sides stand at the same places."""
    n = min(len(a), len(b))
    if n - begin < 2:
        return 0
    own = [np.diff(side[begin:n].astype(np.int64), axis=0) % np.asarray(PRIMES) for side in (a, b)]
    return int((own[0] == own[1]).all(1).sum())


def common_blocks(a: np.ndarray, b: np.ndarray) -> int:
    """Characters of the blocks that both have, each as often as the one that has it less often."""
    kinds, rows = np.unique(np.concatenate([a, b]), return_inverse=True)
    times = [np.bincount(part, minlength=len(kinds)) for part in (rows[: len(a)], rows[len(a) :])]
    return int((np.minimum(*times) * (kinds >> np.uint64(32)).astype(np.int64)).sum())


def likeness(first: str, second: str) -> float:
    """0 to 1: what share of the longer text is common to both, as far as blocks and samples tell."""
    if first == second:
        return 1.0
    a, b = Fingerprint.read(first), Fingerprint.read(second)
    longer = max(a.n, b.n)
    if not min(a.n, b.n):
        return 0.0
    step = max(a.step, b.step)
    fronts, backs = (a.at("front", step), b.at("front", step)), (a.at("back", step), b.at("back", step))
    prefix, suffix = shared_samples(*fronts), shared_samples(*backs)
    more = max(equal_blocks(*fronts, prefix), equal_blocks(*backs, suffix))
    covered = max((prefix + suffix) * step, (prefix + equal_blocks(*fronts, prefix)) * step, (suffix + more) * step if more else 0)
    covered = max(covered, common_blocks(a.blocks, b.blocks))
    return min(1.0, covered / longer, min(a.n, b.n) / longer)


def neighbours(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows in ranges of the key, largest first, each range with the first row of the next as its guard.

    The ranges begin at keys of the table: the largest key of each part of a range partitioning of
    the keys alone, about one per ``RANGE_BYTES`` of text, which is all that comes to the driver. The rows that begin a range go twice, to
    their own and, as guard, to the range before; the text is shuffled once.
    """
    number = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY))
    plain = df.select(number.alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    size = plain.select(F.sum(F.octet_length("body"))).first()[0] or 0
    parts = plain.select("id").repartitionByRange(max(1, -(-size // RANGE_BYTES)), F.desc("id"))
    tops = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.max("id").alias("top"))
    starts = np.sort(np.asarray([row.top for row in tops.collect()] or [0], np.int64))
    count = len(starts)

    @F.pandas_udf(StructType([StructField("own", IntegerType()), StructField("guard", IntegerType())]))
    def ranges(keys: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(starts, keys.to_numpy(np.int64), "left")
        own = count - 1 - at
        return pd.DataFrame({"own": own, "guard": np.where(starts[at] == keys, (own - 1) % count, -1)})

    found = plain.withColumn("home", ranges("id"))
    homes = F.array(F.struct(F.col("home.own").alias("range"), F.lit(False).alias("guard")), F.struct(F.col("home.guard").alias("range"), F.lit(True).alias("guard")))
    spread = found.select("id", "body", F.inline(F.filter(homes, lambda h: h["range"] >= 0)))
    return spread.repartitionById(count, F.col("range")).sortWithinPartitions("guard", F.desc("id"), "body")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to the neighbours.

    The edited text is the text with its last ``n_chars // 2`` code points replaced by the first as
    many, or all, of the next document in descending key; after the last comes the first. Null is
    empty, and a single document is its own neighbour. Rows with equal keys stand side by side, in
    the order of their texts; null keys are last. An empty table gives no rows; other columns are
    not read. Result: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    schema = StructType(
        [
            StructField(key, df.schema[key].dataType),
            StructField("n_chars", LongType()),
            StructField("edited_sha256", StringType()),
            StructField("fingerprint", StringType()),
            StructField("edited_fingerprint", StringType()),
            StructField("near_edited", DoubleType()),
            StructField("near_next", DoubleType()),
        ]
    )
    ordered = neighbours(df, key, text)

    def pair(one: tuple, after: tuple) -> dict:
        body, following = one[1], after[1]
        n = len(body)
        keep = n - n // 2
        take = min(n // 2, len(following))
        edited = one[2].joined(keep, after[2], take)
        mine, changed, theirs = one[3], edited.fingerprint(), after[3]
        return {
            key: None if one[0] == NO_KEY else one[0],
            "n_chars": n,
            "edited_sha256": hashlib.sha256((body[:keep] + following[:take]).encode("utf-8")).hexdigest(),
            "fingerprint": mine,
            "edited_fingerprint": changed,
            "near_edited": likeness(mine, changed),
            "near_next": likeness(mine, theirs),
        }

    def prepared(number, body: str) -> tuple:
        prefixes = Prefixes.of(body)
        return number, body, prefixes, prefixes.fingerprint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        last, guarded = None, False
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("id", "body", "guard")]
            for number, body, guard in zip(*columns):
                if guard and guarded:
                    continue  # equal keys: only the first of the next range follows this one
                if guard and last is None:
                    continue
                current = prepared(number, body)
                if last is not None:
                    rows.append(pair(last, current))
                last, guarded = current, guard
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return ordered.mapInArrow(run, schema)
