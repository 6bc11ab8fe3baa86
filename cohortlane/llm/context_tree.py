"""Language-model scores by context-tree weighting over bytes.

A text is read as its lower-cased words joined by one space and one end byte. Each byte is split
into eight binary decisions. For every decision the last bytes are its context, and every context
of every depth up to ``DEPTH`` keeps a Krichevsky-Trofimov estimate from the training counts. The
tree mixes, at each node, its own estimate with what its children say, with the weights that the
training counts give. Every context counted is a node.

A gram is a byte with its context of full depth. Grams are counted over all documents, with count 0
where only held-out documents have one, so that each gram that is scored has its place in the tree.
They are dealt by the last ``LOCAL`` bytes of the context: all nodes below such a context lie in one
task, which mixes them bottom-up. Only sums per shorter context and decision come to the driver, whose
number depends on the alphabet and not on the texts. With the mixed upper levels a second pass gives
the log probability of every gram. Documents look the most frequent grams up themselves; the others
are joined.

The base score needs the count of every token. Tokens are counted by 64-bit hash. Documents look the
most frequent ones up themselves, which takes the heavy keys out; the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, ShortType, StructField, StructType

from cohortlane.llm.jaccard_join import shingler
from cohortlane.llm.language_id import fold
from cohortlane.session import written

END = 10
DEPTH = 5
#: Contexts of this many bytes and all longer ones that end in them are mixed in one task.
LOCAL = 3
FREQUENT = 1 << 18
#: Grams that documents look up themselves, at most; the others are joined.
FREQUENT_GRAMS = 1 << 20
MIXED = 100_000
PORTION = 4 << 20
TOKEN, GRAM = 0, 1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x of 0.5 or more: Stirling's series after six steps up."""
    up = x + 6
    inverse = 1 / up
    series = inverse * (1 / 12 - inverse**2 * (1 / 360 - inverse**2 / 1260))
    product = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    return (up - 0.5) * np.log(up) - up + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 binary decisions of every context; decision 2**k - 1 + j is that of bit k after prefix j."""
    zeros, ones = [], []
    for bit in range(8):
        halves = counts.reshape(len(counts), 1 << bit, 2, -1).sum(3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, 1), np.concatenate(ones, 1)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the estimator gives all decisions made."""
    out = np.zeros(zeros.shape)
    met = (zeros + ones) > 0
    a, b = zeros[met].astype(np.float64), ones[met].astype(np.float64)
    out[met] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - np.log(np.pi)
    return out


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def byte_logs(ones: np.ndarray) -> np.ndarray:
    """Log10 probability of each byte from the probability of a one at each decision."""
    total = np.zeros((len(ones), 1))
    for bit in range(8):
        here = ones[:, (1 << bit) - 1 : (2 << bit) - 1]
        total = np.stack([total + np.log10(1 - here), total + np.log10(here)], 2).reshape(len(ones), -1)
    return total


@dataclass
class Level:
    """Contexts of one depth: ``rows`` sorted, and counts of the 256 bytes after each."""

    contexts: np.ndarray
    counts: np.ndarray


@dataclass
class ContextTree:
    """The mix of contexts held in one place, with what is no node as one child more; tests compare ``gram_logs`` with it.

    ``logs``: a row of log10 probabilities per context of any depth, from row ``offsets[d]`` on for depth d.

    ``steps``: from a context and a byte to the context one byte longer, 0 if that is no node.
    """

    depth: int
    logs: np.ndarray
    offsets: list[int]
    steps: list[np.ndarray]

    @classmethod
    def mix(cls, levels: list[Level]) -> ContextTree:
        parents = [np.zeros(1, np.int64)]
        for d in range(1, len(levels)):
            parents.append(np.searchsorted(levels[d - 1].contexts, levels[d].contexts & ((1 << 8 * (d - 1)) - 1)))
        rest = [level.counts.astype(np.int64) for level in levels]
        for d in range(1, len(levels)):
            np.subtract.at(rest[d - 1], parents[d], levels[d].counts.astype(np.int64))
        weights: list[np.ndarray] = [np.zeros(0)] * len(levels)
        below = None
        for d in reversed(range(len(levels))):
            own = log_kt(*decisions(levels[d].counts))
            if d == len(levels) - 1:
                weights[d], mixed = np.ones(own.shape, np.float32), own
            else:
                children = log_kt(*decisions(rest[d]))
                if below is not None:
                    np.add.at(children, parents[d + 1], below)
                mixed = np.logaddexp(own, children) - np.log(2)
                weights[d] = np.exp(own - np.log(2) - mixed).astype(np.float32)
            below = mixed
        logs, offsets, before, left = [], [0], np.zeros((1, 255), np.float32), np.ones((1, 255), np.float32)
        for d, level in enumerate(levels):
            before, left = before[parents[d]], left[parents[d]]
            before = before + left * weights[d] * estimate(*decisions(level.counts)).astype(np.float32)
            left = left * (1 - weights[d])
            total = before + left * estimate(*decisions(rest[d])).astype(np.float32)
            logs.append(byte_logs(np.clip(total, 1e-6, 1 - 1e-6).astype(np.float64)).astype(np.float32))
            offsets.append(offsets[-1] + len(level.contexts))
        steps = []
        for d in range(1, len(levels) - 1):
            step = np.zeros((len(levels[d].contexts) + 1, 256), np.uint16)
            longer = levels[d + 1].contexts
            at = np.searchsorted(levels[d].contexts, longer >> 8)
            step[at + 1, longer & 255] = np.arange(1, len(longer) + 1)
            steps.append(step.ravel())
        if len(levels) > 1:
            steps = [first_step(levels[1]), *steps]
        return cls(max(1, len(levels) - 1), np.concatenate(logs).ravel(), offsets, steps)

    def scores(self, line: np.ndarray) -> np.ndarray:
        """Log10 probability of every byte but the first ``depth``, which are context only."""
        data = line.astype(np.int32)
        rows = np.zeros(len(data) - 1, np.int32)
        at = None
        for d, step in enumerate(self.steps, 1):
            # at[i]: the context of depth d that ends at byte i, 0 if it is no node
            at = step[data] if d == 1 else np.concatenate([[0], step[at[:-1].astype(np.int32) * 256 + data[1:]]]).astype(np.int32)
            known = at[:-1]
            rows = np.where(known > 0, known.astype(np.int32) + np.int32(self.offsets[d] - 1), rows)
        return self.logs[rows * 256 + data[1:]][self.depth - 1 :]


def first_step(level: Level) -> np.ndarray:
    step = np.zeros(256, np.uint16)
    step[level.contexts] = np.arange(1, len(level.contexts) + 1)
    return step


def byte_line(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts as bytes, each after ``depth`` end bytes as its first context, and where each ends."""
    pad = bytes([END]) * depth
    parts = [pad + b" ".join((t or "").encode("utf-8").lower().split()) + bytes([END]) for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts])


def grams(line: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Every byte with its context of full depth as one number, the byte lowest; padding is left out."""
    wide = line.astype(np.int64)
    codes = wide[depth:].copy()
    for k in range(1, depth + 1):
        codes |= wide[depth - k : len(wide) - k] << (8 * k)
    starts = np.concatenate([[0], ends[:-1]])[1:]
    keep = np.ones(len(codes), bool)
    for k in range(depth):
        keep[starts - depth + k] = False  # the padding of the later texts
    return codes[keep]


def statistics(df: DataFrame, text: str, out: str, depth: int) -> DataFrame:
    """``kind``, ``code``, ``n``: how often each token (by hash) and each gram occurs in rows that are not ``out``.

    Grams of ``out`` rows only are there with count 0.
    """
    schema = StructType([StructField("kind", ShortType()), StructField("code", LongType()), StructField("n", LongType())])
    plain = df.select(F.col(f"`{out}`").alias("out"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = shingler(1)
        held: dict[int, list] = {TOKEN: [], GRAM: []}
        size = {TOKEN: 0, GRAM: 0}

        def fold_held(kind: int) -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([c for c, _ in held[kind]])
            order = np.argsort(codes, kind="stable")
            codes, counts = codes[order], np.concatenate([n for _, n in held[kind]])[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            return codes[first], np.add.reduceat(counts, first)

        def add(kind: int, codes: np.ndarray, weight: int = 1) -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(codes, return_counts=True)
            counts = counts * weight
            held[kind].append((values, counts))
            size[kind] += len(values)
            if size[kind] > 4_000_000:
                values, counts = fold_held(kind)
                held[kind], size[kind] = [(values, counts)], len(values)
                if len(values) > 2_000_000:
                    yield from out(kind)

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind]:
                values, counts = fold_held(kind)
                held[kind], size[kind] = [], 0
                for i in range(0, len(values), 50_000):
                    part = values[i : i + 50_000]
                    kinds = pa.array(np.full(len(part), kind, np.int16))
                    yield pa.RecordBatch.from_arrays([kinds, pa.array(part.astype(np.int64)), pa.array(counts[i : i + 50_000].astype(np.int64))], names=schema.names)

        for rows in portions(batches):
            values = [text for held_out, text in rows if not held_out]
            if values:
                tokens = np.concatenate([make.words(t or "") for t in values]).view(np.int64)
                yield from add(TOKEN, np.concatenate([tokens, np.full(len(values), end_token(), np.int64)]))
                yield from add(GRAM, grams(*byte_line(values, depth), depth))
            others = [text for held_out, text in rows if held_out]
            if others:
                yield from add(GRAM, grams(*byte_line(others, depth), depth), 0)
        yield from out(TOKEN)
        yield from out(GRAM)

    return plain.mapInArrow(run, schema).groupBy("kind", "code").agg(F.sum("n").alias("n"))


def repeats(who: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, and how often it stands there."""
    order = np.lexsort((codes, who))
    who, codes = who[order], codes[order]
    first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (codes[1:] != codes[:-1])])) if len(who) else np.zeros(0, np.int64)
    return who[first], codes[first], np.diff(np.append(first, len(who)))


def end_token() -> int:
    """The hash of the end; no word is empty."""
    import xxhash

    return int(np.asarray(xxhash.xxh64_intdigest(b""), np.uint64).view(np.int64))


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (first column, text) of about ``PORTION`` characters at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            held.append(row)
            size += len(row[-1] or "")
            if size >= PORTION:
                yield held
                held, size = [], 0
    if held:
        yield held


@dataclass
class Nodes:
    """Decisions of the contexts of one depth: ``keys`` sorted, the context above the decision's number in the lowest byte.

    ``logs`` are the mixed log probabilities, ``weights`` the shares of the own estimates, and
    ``parents`` the rows of the next shorter contexts.
    """

    keys: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    logs: np.ndarray
    weights: np.ndarray
    parents: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None) -> Nodes:
        own = log_kt(zeros, ones)
        if below is None:
            return cls(keys, zeros, ones, own, np.ones(len(own)), np.zeros(0, np.int64))
        logs = np.logaddexp(own, below) - np.log(2)
        return cls(keys, zeros, ones, logs, np.exp(own - np.log(2) - logs), np.zeros(0, np.int64))

    def shorter(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, zeros, ones and children's logs of the contexts of ``depth``, one byte less."""
        keys, self.parents = np.unique(shortened(self.keys, depth), return_inverse=True)
        return keys, summed(self.parents, self.zeros, len(keys)), summed(self.parents, self.ones, len(keys)), np.bincount(self.parents, self.logs, len(keys))

    def down(self, before: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the nodes up to these say for a one, and the share left to longer contexts, from the same of the parents."""
        return before + left * self.weights * estimate(self.zeros, self.ones), left * (1 - self.weights)


def shortened(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys & np.int64((1 << 8 * (depth + 1)) - 1)


def summed(rows: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of whole numbers by row."""
    out = np.zeros(n, np.int64)
    np.add.at(out, rows, counts)
    return out


def local_nodes(codes: np.ndarray, n: np.ndarray, depth: int, top: int) -> tuple[list[Nodes], np.ndarray, np.ndarray]:
    """Mixed nodes of depth ``top`` to ``depth``, and for bit and gram the row at full depth and the bit."""
    value = codes & 255
    numbers = np.stack([(1 << k) - 1 + (value >> 8 - k) for k in range(8)])
    bits = np.stack([value >> 7 - k & 1 for k in range(8)])
    keys, rows = np.unique(((codes >> 8 << 8)[None, :] | numbers).ravel(), return_inverse=True)
    times = np.broadcast_to(n, bits.shape).ravel()
    ones = summed(rows, times * bits.ravel(), len(keys))
    found = [Nodes.of(keys, summed(rows, times, len(keys)) - ones, ones, None)]
    for d in range(depth - 1, top - 1, -1):
        found.insert(0, Nodes.of(*found[0].shorter(d)))
    return found, rows.reshape(bits.shape), bits


def whole_contexts(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts, at least ``MIXED`` at a time, never with a context of ``top`` bytes cut in two; they come sorted by it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, wanted = 0, MIXED

    def joined() -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([c for c, _ in held]), np.concatenate([n for _, n in held])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n")))
        size += batch.num_rows
        if size >= wanted:
            codes, n = joined()
            context = codes >> 8 & ((1 << 8 * top) - 1)
            cut = int(np.searchsorted(context, context[-1]))
            if cut:
                yield codes[:cut], n[:cut]
            held, size = [(codes[cut:], n[cut:])], len(codes) - cut
            wanted = max(MIXED, 2 * size)
    if size:
        yield joined()


def upper_levels(sums: DataFrame, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of depth ``top - 1`` with what the nodes up to them say and what they leave."""
    table = sums.toArrow()
    keys, zeros, ones, logs = (table.column(c).to_numpy() for c in ("key", "zeros", "ones", "logs"))
    order = np.argsort(keys)
    levels = [Nodes.of(keys[order], zeros[order], ones[order], logs[order])]
    for d in range(top - 2, -1, -1):
        levels.insert(0, Nodes.of(*levels[0].shorter(d)))
    before, left = levels[0].down(np.zeros(len(levels[0].keys)), np.ones(len(levels[0].keys)))
    for upper, level in zip(levels, levels[1:]):
        before, left = level.down(before[level.parents], left[level.parents])
    return levels[-1].keys, before, left


def gram_logs(counted: DataFrame, depth: int) -> DataFrame:
    """``code``, ``n`` and ``log``, the log10 probability of the byte in its context, for each gram of ``code`` and ``n``."""
    top = min(LOCAL, depth)
    context = F.shiftright("code", 8).bitwiseAND(F.lit((1 << 8 * top) - 1))
    dealt = counted.select("code", "n", context.alias("context")).repartition("context").sortWithinPartitions("context")

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, n in whole_contexts(batches, top):
            found, _, _ = local_nodes(codes, n, depth, top)
            columns = found[0].shorter(top - 1)
            for i in range(0, len(columns[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in columns], names=["key", "zeros", "ones", "logs"])

    sums = dealt.mapInArrow(up, "key long, zeros long, ones long, logs double")
    totals = sums.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "logs")))
    shared = counted.sparkSession.sparkContext.broadcast(upper_levels(totals, top))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, before_top, left_top = shared.value
        for codes, n in whole_contexts(batches, top):
            levels, rows, bits = local_nodes(codes, n, depth, top)
            at = np.searchsorted(keys, shortened(levels[0].keys, top - 1))
            before, left = levels[0].down(before_top[at], left_top[at])
            for level in levels[1:]:
                before, left = level.down(before[level.parents], left[level.parents])
            one = np.clip(before, 1e-6, 1 - 1e-6)[rows]
            logs = np.log10(np.where(bits == 1, one, 1 - one)).sum(0)
            for i in range(0, len(codes), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000]) for c in (codes, n, logs)], names=["code", "n", "log"])

    return dealt.mapInArrow(down, "code long, n long, log double")


@dataclass
class Lookup:
    """Log probabilities of frequent grams by slot; of grams with the same slot the most frequent one has it."""

    codes: np.ndarray
    logs: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, n: np.ndarray, logs: np.ndarray) -> Lookup:
        size = 16
        while size < 2 * len(codes):
            size *= 2
        found = cls(np.full(size, -1, np.int64), np.zeros(size))
        order = np.argsort(n, kind="stable")
        at = found.slots(codes[order])
        _, last = np.unique(at[::-1], return_index=True)
        pick = order[len(order) - 1 - last]
        at = found.slots(codes[pick])
        found.codes[at], found.logs[at] = codes[pick], logs[pick]
        return found

    def slots(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(65 - len(self.codes).bit_length())).astype(np.int64)

    def ask(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which codes are there, and their logs, 0 for the others."""
        at = self.slots(codes)
        hit = self.codes[at] == codes
        return hit, np.where(hit, self.logs[at], 0.0)


def frequent_lookup(logs: DataFrame, most: int) -> Lookup:
    """The grams of the highest counts, ``most`` at most; which ones they are changes the work and not the result."""
    table = logs.filter("n > 0").groupBy("n").agg(F.count("*").alias("held")).toArrow()
    n, held = (table.column(c).to_numpy() for c in ("n", "held"))
    order = np.argsort(-n)
    fit = np.flatnonzero(np.cumsum(held[order]) <= most)
    least = int(n[order][fit[-1]]) if len(fit) else None
    picked = logs.filter(F.lit(False) if least is None else F.col("n") >= least).toArrow()
    return Lookup.of(*(picked.column(c).to_numpy() for c in ("code", "n", "log")))


def context_tree_scores(
    df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1, depth: int = DEPTH, frequent: int = FREQUENT, frequent_grams: int = FREQUENT_GRAMS
) -> DataFrame:
    """``key``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``bits_per_byte``.

    Learned from all rows outside the held-out fold (crc32 of the key as text). Null and empty
    texts are the end alone. Every row is scored by itself and counts as often as it stands there;
    rows with a null key are not held out. Without any training row every token has count 0 and
    every byte the same probability. An empty table gives no rows; other columns are not read.
    """
    spark = df.sparkSession
    plain = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False))
    stats = written(statistics(plain.select(out.alias("out"), "text"), "text", "out", depth), "statistics")
    logs = written(gram_logs(stats.filter(F.col("kind") == GRAM), depth), "logs")
    tokens = stats.filter(F.col("kind") == TOKEN)
    total, distinct = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = tokens.orderBy(F.desc("n"), "code").limit(frequent).select("code", "n").toArrow()
    codes, n = (top.column(c).to_numpy().astype(np.int64) for c in ("code", "n"))
    by_code = np.argsort(codes)
    shared = spark.sparkContext.broadcast((frequent_lookup(logs, frequent_grams), codes[by_code], n[by_code]))

    schema = StructType(
        [StructField("uid", LongType()), plain.schema["id"]]
        + [StructField(c, LongType()) for c in ("n_tokens", "n_known", "n_bytes")]
        + [StructField(c, DoubleType()) for c in ("known_logs", "score")]
        + [StructField("kind", ShortType()), StructField("code", LongType()), StructField("times", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often, counts = shared.value
        make, last, uid = shingler(1), end_token(), TaskContext.get().partitionId() << 33
        for rows in portions(batches):
            values = [r[1] for r in rows]
            line, ends = byte_line(values, depth)
            sizes = np.diff(ends, prepend=0) - depth
            owners = np.repeat(np.arange(len(rows)), sizes)
            met = grams(line, ends, depth)
            there, found_logs = known.ask(met)
            scores = np.bincount(owners, found_logs, len(rows))
            first = {name: [] for name in ("n_tokens", "n_known", "known_logs")}
            rest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, value in enumerate(values):
                words = np.concatenate([make.words(value or "").view(np.int64), [last]])
                own, times = np.unique(words, return_counts=True)
                at = np.minimum(np.searchsorted(often, own), max(len(often) - 1, 0))
                hit = often[at] == own if len(often) else np.zeros(len(own), bool)
                first["n_tokens"].append(len(words))
                first["n_known"].append(int(times[hit].sum()))
                first["known_logs"].append(float((times[hit] * np.log10(counts[at[hit]] + 0.5)).sum()) if len(often) else 0.0)
                rest.append((np.full(len(own) - int(hit.sum()), uid + i), own[~hit], times[~hit]))
            uids = np.arange(uid, uid + len(rows))
            uid += len(rows)
            size = len(rows)
            blank = [pa.nulls(size, t) for t in (pa.int16(), pa.int64(), pa.int64())]
            columns = [pa.array(uids), pa.array([r[0] for r in rows], batch_type), *(pa.array(first[c]) for c in ("n_tokens", "n_known")), pa.array(sizes.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first["known_logs"], pa.float64()), pa.array(scores), *blank], names=schema.names)
            who, own, times = (np.concatenate([r[k] for r in rest]) for k in range(3))
            yield from lookups(TOKEN, who, own, times)
            yield from lookups(GRAM, *repeats(uids[owners[~there]], met[~there]))

    def lookups(kind: int, who: np.ndarray, own: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(who), 50_000):
            part = slice(i, i + 50_000)
            size = len(who[part])
            empty = [pa.nulls(size, t) for t in (batch_type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            kinds = pa.array(np.full(size, kind, np.int16))
            yield pa.RecordBatch.from_arrays([pa.array(who[part]), *empty, kinds, pa.array(own[part]), pa.array(times[part].astype(np.int64))], names=schema.names)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(plain.schema["id"].dataType)
    found = written(plain.mapInArrow(run, schema), "scored")
    rare = found.filter("code IS NOT NULL").select("uid", "kind", "code", "times")
    counted = rare.filter(F.col("kind") == TOKEN).join(tokens.select("code", "n"), "code", "left")
    count = F.coalesce("n", F.lit(0))
    by_token = counted.select("uid", (F.col("times") * F.log10(count + 0.5)).alias("log"), F.when(count > 0, F.col("times")).otherwise(0).alias("known"), F.lit(0.0).alias("gram"))
    by_gram = rare.filter(F.col("kind") == GRAM).join(logs.select("code", "log"), "code").select("uid", F.lit(0.0).alias("log"), F.lit(0).alias("known"), (F.col("times") * F.col("log")).alias("gram"))
    sums = by_token.unionByName(by_gram).groupBy("uid").agg(F.sum("log").alias("rare_logs"), F.sum("known").alias("rare_known"), F.sum("gram").alias("rare_score"))
    docs = found.filter("code IS NULL").drop("kind", "code", "times").join(sums, "uid", "left")
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    return docs.select(
        F.col("id").alias(key),
        F.coalesce(fold(F.col("id"), folds) == held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("known_logs") + F.coalesce("rare_logs", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        score.alias("score"),
        (-score / np.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )
