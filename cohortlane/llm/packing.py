"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

Linear grouping: large lengths are sorted and cut into groups of equal cardinality, and every
length of a group is rounded up to the group's largest. With few sizes left, whole configurations
(which sizes share a sequence) are chosen by an exact knapsack and used as often as the groups
last. Then the actual documents take the places of the rounded ones, which frees room, and the
small ones are put, longest first, where they fit best.

Planning sees counts by length only: at most one number per length up to the capacity, whatever
the number of documents. Documents find their sequence by their rank within their length, so no
task holds a group, and the plan's few thousand intervals are all that is broadcast.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from cohortlane.llm.bpe import WHITE, encoder, load_ranks
from cohortlane.llm.frames import ROWS, arrow_types, ranked_within
from cohortlane.session import written

CAPACITY = 1024
GROUPS = 512
SMALL = 256
#: Characters that go through the library at once.
PORTION = 100_000
BORDER = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")


class Ids:
    """Token ids of whole texts by the library, special strings in the text included.

    A long text goes through it in portions cut where white space follows another character, which
    no match of the pattern spans. A run without such a place that is longer than a portion goes
    through the transducer, whose time and memory do not depend on a run's length.
    """

    def __init__(self, ranks: str, pattern: str, specials: dict[str, int]):
        self.library = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=load_ranks(ranks), special_tokens=specials)
        self.specials, self.slow = specials, (ranks, pattern)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")").split if specials else lambda text: [text]

    def of(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if len(text) <= PORTION:
            return self.library.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        found = []
        for part in self.split(text):
            if part in self.specials:
                found.append(np.asarray([self.specials[part]], np.uint32))
                continue
            for portion in portions(part):
                if len(portion) <= PORTION:
                    found.append(self.library.encode_to_numpy(portion, allowed_special=set(), disallowed_special=()))
                else:
                    found.append(np.frombuffer(encoder(*self.slow).packed(portion), np.uint32))
        return np.concatenate(found)


def portions(text: str) -> Iterator[str]:
    """Parts of a text of at most ``PORTION`` characters where it can be cut, longer ones where not."""
    begin = 0
    for place in (m.start() for m in BORDER.finditer(text)):
        if place - begin >= PORTION // 2:
            yield text[begin:place]
            begin = place
    if begin < len(text):
        yield text[begin:]


@lru_cache(maxsize=2)
def library_ids(ranks: str, pattern: str, specials: tuple[tuple[str, int], ...]) -> Ids:
    """One per Python worker, used by all its tasks."""
    return Ids(ranks, pattern, dict(specials))


def cut_pieces(df: DataFrame, ranks: str, pattern: str, specials: dict[str, int], end: int, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece of every document.

    A document is its ids, special strings in the text included, and the id ``end``. Longer ones
    are cut so that all pieces but the first are full. Null and empty texts are the id ``end`` alone.
    """
    schema = StructType([df.schema[key], *(StructField(n, LongType()) for n in ("piece", "start", "length", "ids_crc32"))])
    plain = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    told = tuple(sorted(specials.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = library_ids(ranks, pattern, told).of
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, len(whole), ROWS)):
            rows, cuts = [], []
            for row, value in enumerate(batch.column("__text").to_pylist()):
                ids = np.append(ids_of(value), np.uint32(end)).astype("<u4")
                length = len(ids) % capacity or capacity
                starts = [0, *range(length, len(ids), capacity)]
                rows += [row] * len(starts)
                cuts += [(n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
            columns = np.asarray(cuts, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), *(pa.array(columns[:, i]) for i in range(4))], names=schema.names)

    return plain.mapInArrow(run, schema)


def linear_groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths, longest first, in runs of about equal numbers of documents."""
    share = sum(counts.values()) / groups
    cut, held, current = [], 0, []
    for length in sorted(counts, reverse=True):
        current.append(length)
        held += counts[length]
        if held >= share * (len(cut) + 1):
            cut.append(current)
            current = []
    return [*cut, current] if current else cut


def fullest(first: int, sizes: list[int], left: dict[int, int], capacity: int) -> list[int]:
    """The sizes, ``first`` among them, that fill a sequence best: a bounded knapsack on bit sets."""
    room = capacity - first
    reach, layers = 1, []
    mask = (1 << room + 1) - 1
    for size in sizes:
        times = min(left[size] - (size == first), room // size)
        for _ in range(times):
            grown = reach | reach << size & mask
            if grown == reach:
                break
            layers.append((size, reach))
            reach = grown
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, [first]
    for size, before in reversed(layers):
        if not before >> fill & 1:
            chosen.append(size)
            fill -= size
    return chosen


def configurations(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, sizes) until no size is left; each step uses up a size, so there are few."""
    left, used = dict(counts), []
    while left:
        sizes = sorted(left, reverse=True)
        chosen = fullest(sizes[0], sizes, left, capacity)
        each: dict[int, int] = defaultdict(int)
        for size in chosen:
            each[size] += 1
        times = min(left[size] // n for size, n in each.items())
        used.append((times, chosen))
        for size, n in each.items():
            left[size] -= n * times
            if not left[size]:
                del left[size]
    return used


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple], int]:
    """Intervals (length, from, to, first sequence, slot) of ranks within a length, and the number of sequences."""
    cut = linear_groups(counts, groups)
    rounded = {members[0]: members for members in cut}
    sizes = {top: sum(counts[m] for m in members) for top, members in rounded.items()}
    taken: dict[int, int] = defaultdict(int)
    plan, sequence = [], 0
    for times, chosen in configurations(sizes, capacity):
        for slot, top in enumerate(chosen):
            begin, end = taken[top], taken[top] + times
            taken[top] = end
            at = 0
            for length in rounded[top]:  # the group's places, in the order of its actual lengths
                low, high = max(begin, at), min(end, at + counts[length])
                if low < high:
                    plan.append((length, low - at, high - at, sequence + low - begin, slot))
                at += counts[length]
        sequence += times
    return plan, sequence


def plan_small(counts: dict[int, int], rooms: dict[int, int], capacity: int) -> list[tuple]:
    """Intervals (length, from, to, room, rank of the first sequence with that room, slot).

    Longest first, each into the least room that holds it. Sequences of one room go in cohorts,
    as intervals of their rank within that room. Room -1 stands for new sequences.
    """
    cohorts: dict[int, list[tuple]] = {room: [(room, 0, n, 0)] for room, n in rooms.items() if n and room}
    order = sorted(cohorts)
    plan, opened = [], 0
    for length in sorted(counts, reverse=True):
        done = 0
        while done < counts[length]:
            at = bisect_left(order, length)
            if at == len(order):
                new = -(-(counts[length] - done) // (capacity // length))
                cohorts[capacity] = [(-1, opened, opened + new, 0)]
                opened += new
                insort(order, capacity)
                continue
            room = order[at]
            origin, begin, end, slot = cohorts[room].pop()
            n = min(end - begin, counts[length] - done)
            plan.append((length, done, done + n, origin, begin, slot))
            rest = [(room, (origin, begin + n, end, slot))] if begin + n < end else []
            for into, cohort in [*rest, (room - length, (origin, begin, begin + n, slot + 1))]:
                if into:
                    if not cohorts.setdefault(into, []) and into not in order:
                        insort(order, into)
                    cohorts[into].append(cohort)
            if not cohorts[room]:
                del cohorts[room]
                order.remove(room)
            done += n
    return plan


def histogram(df: DataFrame, column: str) -> dict[int, int]:
    """Rows by value, for a column of at most ``capacity`` values."""
    return {row[0]: row[1] for row in df.groupBy(column).agg(F.count("*")).collect()}


def placed(df: DataFrame, on: str, plan: Iterable[tuple], fields: str) -> DataFrame:
    """Join intervals of ranks within ``on`` to rows with their ``rank``.

    The plan is handed over as an Arrow table: from a list, Spark would make the rows by Python
    workers of another kind, which then stay in the executors' memory.
    """
    schema = StructType.fromDDL(f"__on long, __from long, __to long, {fields}")
    types, rows = arrow_types(schema), list(plan)
    columns = [pa.array([row[i] for row in rows], types[name]) for i, name in enumerate(schema.names)]
    intervals = df.sparkSession.createDataFrame(pa.table(columns, names=schema.names), schema)
    inside = (F.col(on) == F.col("__on")) & (F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__to"))
    return df.join(F.broadcast(intervals), inside)


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every row has a ``length`` of 1 to ``capacity``.

    Sequences hold at most ``capacity``, offsets go on without gaps from 0. Rows may repeat: each is
    packed. An empty table gives no rows. Other columns pass through; ``rank``, ``sequence_id``,
    ``offset`` and names beginning with ``__`` are taken.
    """
    ranked = written(ranked_within(pieces, "length", "rank"), "ranked")
    counts = histogram(ranked, "length")
    full = counts.pop(capacity, 0)
    plan, sequences = plan_large({n: c for n, c in counts.items() if n > small}, capacity, groups)
    large = placed(ranked, "length", plan, "__first long, __slot int")
    first = large.select(*ranked.columns, (F.col("__first") + F.col("rank") - F.col("__from")).alias("sequence_id"), "__slot")
    alone = ranked.filter(F.col("length") == capacity).select(*ranked.columns, (F.col("rank") + sequences).alias("sequence_id"), F.lit(0).alias("__slot"))
    sequences += full
    everything = first.unionByName(alone)
    little = {n: c for n, c in counts.items() if n <= small}
    if little:
        held = written(first, "substituted")
        rooms = held.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("__room"))
        open_rooms = written(ranked_within(rooms.filter("__room > 0"), "__room", "__nth"), "rooms")
        plan = plan_small(little, histogram(open_rooms, "__room"), capacity)
        intervals = "__origin long, __first long, __slot int"
        fitted = placed(ranked, "length", plan, intervals).withColumns(
            {"__nth": F.col("__first") + F.col("rank") - F.col("__from"), "__slot": F.col("__slot") + capacity}
        )
        into = fitted.join(open_rooms.withColumnRenamed("__room", "__origin"), ["__origin", "__nth"], "left")
        sequence = F.coalesce("sequence_id", F.col("__nth") + sequences)
        everything = held.unionByName(alone).unionByName(into.select(*ranked.columns, sequence.alias("sequence_id"), "__slot"))
    before = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    return everything.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")).drop("__slot", "rank")


def pack_documents(df: DataFrame, ranks: str, pattern: str, specials: dict[str, int], end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of all documents in as few sequences as the plan finds.

    Equal keys and equal texts are packed row by row; see ``cut_pieces`` and ``pack`` for nulls,
    empty texts and tables.
    """
    # Written, so that a task has one Python worker at a time: packing begins with a numbering of its own.
    return pack(written(cut_pieces(df, ranks, pattern, specials, end, key=key, text=text), "pieces"))
