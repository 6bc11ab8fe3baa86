"""Exact n-gram Jaccard join and its connected components, by prefix trees.

1. Documents become sets of 64-bit shingle hashes. Equal sets fold to one representative.
2. The order of shingles is global: rare ones by hash first, frequent ones last. Any order gives
   the same links; this one keeps common passages out of the way.
3. Candidates: two sets that link differ in few shingles, at most ``k`` for their size class. The
   hash space is cut into more than ``k`` parts, so several parts are the same in both, a number
   known for each set. Parts are dealt by their hash in packed pieces. A set that shares too few of
   its parts with any others links to none and is left out; those that stay and stand side by side
   under one part are joined to candidate groups. Nothing is emitted per pair. A part has several
   shingles, so sets that share but a passage hardly meet.
4. Every candidate group's sets go, once, to tiles of bounded size. In a tile the ordered sets are
   stored in a path-compressed trie. Each set traverses it, sharing the overlap of common paths,
   and leaves a subtree when what remains of both sets can't reach the overlap needed. Sets that
   are connected already are not compared again.
5. A large group is first split. One of very many sets is split by the parts of a second hash over
   all shingles: sets that link share one of those too, so what does not meet there needs no
   comparison. What is still large is split by sketches, a byte per bucket of the hash space that
   counts a set's shingles there: counts of linking sets differ no more than the sets do.
6. What stays too large for one tile (near copies, as a rule) is cut into blocks; blocks are joined with
   themselves and the next, and what the largest component then leaves out is joined with every block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from cohortlane.functions.times import own_prefix
from cohortlane.llm.components import EDGE, connected, folded_portions
from cohortlane.session import written

#: Odd multipliers that tell the places of a shingle's words apart, and a finalizer's.
PLACES = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
WHOLE = (1 << 64) - 1
WORDS_HELD = 300_000
FREQUENT = 1 << 16
TILE_SHINGLES = 1_000_000
NODES_HELD = 500_000
MARKS = 1 << 24
#: Shingles of a window in which frequent ones are counted, and how many sets of it hold them.
WINDOW_SHINGLES, SEVERAL = 1_000_000, 3
#: Buckets of a sketch, those looked at first, sketches of a block, and the sets of a group that sketches alone split.
BUCKETS, FIRST_BUCKETS, SKETCHES_HELD, SKETCHED = 1024, 256, 4_096, 1 << 16
#: Groups of a tile's part or of sets up to these are compared as they are.
LIGHT, FEW_SETS = 16, 512
#: Frequent is what so many sets hold, and one in so many documents. Near copies by the dozen are not.
LEAST_OFTEN, ONE_IN = 16, 2_000
#: Keys that a task packs at a time and that are dealt to one shard, about; and the most bits that mark entries.
PACKED_KEYS, SHARD_KEYS, ENTRY_BITS = 1_000_000, 1_000_000, 27
#: Packed keys of parts and the entries that have them; or, with ``nodes``, what set an entry is of and how many parts it shares at least if it links.
POSTED = StructType([StructField("shard", IntegerType()), *(StructField(c, BinaryType()) for c in ("low", "high", "entries", "nodes", "least"))])
#: Entries by the keys that several have, with a bit where a key begins; or entries with ``nodes``, as posted.
SHARED = StructType([StructField(c, BinaryType()) for c in ("entries", "begins", "nodes", "least")])


class Shingler:
    """Sorted distinct hashes of the shingles of ``width`` words; words lie between ASCII white space."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, text: str) -> np.ndarray:
        found = text.encode("utf-8").lower().split()  # of bytes: A-Z only, and ASCII white space only
        known = self.known
        if len(known) > WORDS_HELD:
            known.clear()
        for word in set(found).difference(known):
            known[word] = xxhash.xxh64_intdigest(word)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def shingles(self, text: str | None) -> np.ndarray:
        words = self.words(text or "")
        if not len(words):
            return words
        width = min(self.width, len(words))
        total = np.full(len(words) - width + 1, width if width < self.width else 0, np.uint64)
        for k in range(width):
            total += words[k : len(words) - width + 1 + k] * PLACES[k % 3] + np.uint64(k // 3)
            total ^= total >> np.uint64(29)
        total = (total ^ total >> np.uint64(30)) * MIX[0]
        total = (total ^ total >> np.uint64(27)) * MIX[1]
        return np.unique(total ^ total >> np.uint64(31))


@lru_cache(maxsize=4)
def shingler(width: int) -> Shingler:
    """One per Python worker, used by all its tasks."""
    return Shingler(width)


def needed(n: int, percent: int) -> int:
    """Least overlap of a set of ``n`` with any set that links to it."""
    return -(-n * percent // 100)


def often(shingles: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Which shingles are frequent ones."""
    if not len(frequent) or not len(shingles):
        return np.zeros(len(shingles), bool)
    return frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles


def ordered(shingles: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Rare shingles by hash, then frequent ones by how often they occur."""
    late = often(shingles, frequent)
    if not late.any():
        return shingles
    last = shingles[late]
    return np.concatenate([shingles[~late], last[np.argsort(ranks[np.searchsorted(frequent, last)], kind="stable")]])


def signature(shingles: np.ndarray) -> bytes:
    """128 bits of a set; none for the empty one."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else b""


def set_rows(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``id``, ``n``, ``sig``, ``node`` per document; and, with a null ``sig``, shingles (``id``) and how many distinct sets (``n``) of a window of a task hold them, if several do."""
    schema = StructType([StructField("id", LongType()), StructField("n", LongType()), StructField("sig", BinaryType()), StructField("node", LongType())])
    plain = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, window, held = shingler(width), {}, 0

        def often_met() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(list(window.values())), return_counts=True)
            several = counts >= SEVERAL
            size = int(several.sum())
            return pa.RecordBatch.from_arrays(
                [pa.array(values[several].view(np.int64)), pa.array(counts[several].astype(np.int64)), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int64())],
                names=schema.names,
            )

        for whole in batches:
            for begin in range(0, len(whole), 512):
                batch = whole.slice(begin, 512)
                sets = [make.shingles(t) for t in batch.column("text").to_pylist()]
                sigs = [signature(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), pa.array(map(node_of, sigs), pa.int64())],
                    names=schema.names,
                )
                for sig, found in zip(sigs, sets):
                    if sig not in window:
                        window[sig] = found
                        held += len(found)
                if held >= WINDOW_SHINGLES:
                    yield often_met()
                    window, held = {}, 0
        if window:
            yield often_met()

    return plain.mapInArrow(run, schema)


@lru_cache(maxsize=4)
def size_bounds(part: int, whole: int) -> list[int]:
    """Where the size classes begin: each reaches about ``part / whole`` times as far as it begins."""
    bounds = [1]
    while bounds[-1] < 1 << 40:
        bounds.append(max(bounds[-1] + 1, bounds[-1] * part // whole))
    return bounds


def part_classes(rare: np.ndarray, n: int, percent: int, strong: bool = False) -> list[tuple[int, np.ndarray, int]]:
    """Size classes with the set's keys there and how many of them it shares, at least, with any set that links.

    ``rare`` are the set's shingles without frequent ones. Two linking sets of ``n`` shingles at most
    differ in ``2 n (100 - percent) / (100 + percent)`` or fewer. A set gives the keys of every class
    that a linking set of its size or larger can be in, so both give those of the larger one's class.
    A part has a few shingles, so some are weak: empty, or of one shingle if ``strong`` parts are
    asked for, which may be that of a passage. There are ``spare`` parts more than sets can differ in,
    so more than ``spare`` are equal. A set with no more weak parts than that gives the others only,
    of which as many are shared as are left when all its weak parts are among the equal ones.
    Sets with more weak parts give all, which are shared by many, and may share but one with a set
    that gives the firm ones only, so ``spare`` is ample: weak parts are about a tenth in the smallest
    sets of a class, more where frequent shingles are gone, and a fifth of a class of strong parts,
    whose classes are narrow.
    """
    bounds, found = size_bounds(*((21, 20) if strong else (7, 5))), []
    for c in range(bisect_right(bounds, n) - 1, bisect_right(bounds, n * 100 // percent)):
        largest = bounds[c + 1] - 1
        differ = 2 * largest * (100 - percent) // (100 + percent)
        spare = 3 + ((differ + 1) * 3 // 7 if strong else (differ + 1) // 4)
        parts = differ + 1 + spare
        of = ((rare >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        sums, which = np.add.reduceat(rare * MIX[0] ^ rare >> np.uint64(7), starts) if len(of) else np.zeros(0, np.uint64), of[starts]
        firm = np.diff(starts, append=len(of)) > 1 if strong else np.ones(len(starts), bool)
        least = 1 + spare + int(firm.sum()) - parts
        if least < 1:
            empty = np.setdiff1d(np.arange(parts), which)
            sums, which, least = np.concatenate([sums, np.zeros(len(empty), np.uint64)]), np.concatenate([which, empty]), 1
        else:
            sums, which = sums[firm], which[firm]
        keys = sums + which.astype(np.uint64) * PLACES[0] + np.uint64(c * int(PLACES[1]) & WHOLE)
        keys = (keys ^ keys >> np.uint64(30)) * MIX[1]
        found.append((c, keys ^ keys >> np.uint64(31), least))
    return found


def part_keys(rare: np.ndarray, n: int, percent: int, strong: bool = False) -> np.ndarray:
    """Keys of which two linking sets share one at least."""
    return np.concatenate([keys for _, keys, _ in part_classes(rare, n, percent, strong)])


def node_of(sig: bytes) -> int:
    """A number for all equal sets; should two sets share one, both become candidates of its group."""
    return int.from_bytes(sig[:8], "little", signed=True)


def entry_of(node: int, c: int) -> int:
    """32 bits for a set in a size class. Sets may share them; such sets become candidates of each other."""
    x = node + (c + 1) * int(PLACES[0]) & WHOLE
    x = (x ^ x >> 30) * int(MIX[0]) & WHOLE
    x = (x ^ x >> 27) * int(MIX[1]) & WHOLE
    return x >> 32


def shards_for(shingles: int | None, percent: int, strong: bool = False) -> int:
    """Shards for the keys that sets of so many shingles give, about."""
    return 1 + (shingles or 0) * (100 - percent) * (16 if strong else 6) // (100 + percent) // SHARD_KEYS


def packed_postings(sets: Iterator[tuple[int, list[tuple[int, np.ndarray, int]]]], shards: int) -> Iterator[pa.RecordBatch]:
    """``POSTED`` rows of nodes with their ``part_classes``: a key's first 48 bits, in order, take little more than 32."""
    found: list[tuple] = []
    held = 0

    def packed() -> pa.RecordBatch:
        entries = np.asarray([entry_of(node, c) for node, c, _, _ in found], np.uint32)
        keys = np.concatenate([k for _, _, k, _ in found]) >> np.uint64(16)
        order = np.argsort(keys)
        keys, owners = keys[order], np.repeat(entries, [len(k) for _, _, k, _ in found])[order]
        of = ((keys >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)
        low, high = keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16)
        begins = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        rows = []
        for begin, end in zip(begins, [*begins[1:], len(of)]):
            steps = pa.compress(np.diff(high[begin:end], prepend=np.uint16(0)).tobytes(), "zstd", asbytes=True)
            rows.append((int(of[begin]), low[begin:end].tobytes(), steps, owners[begin:end].tobytes(), None, None))
        nodes, least = np.asarray([f[0] for f in found], np.int64), np.asarray([f[3] for f in found], np.int64)
        rows.append((int(entries[0]) % shards, None, None, entries.tobytes(), nodes.tobytes(), least.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], names=POSTED.names)

    for node, classes in sets:
        for c, keys, least in classes:
            if len(keys):
                found.append((node, c, keys, least))
                held += len(keys)
        if held >= PACKED_KEYS:
            yield packed()
            found, held = [], 0
    if found:
        yield packed()


def part_postings(df: DataFrame, text: str, width: int, percent: int, order, shards: int = 16) -> DataFrame:
    """Packed parts of every set. Copies met by a task one after the other give their parts once."""
    plain = df.select(F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, frequent, seen = shingler(width), order.value[0], set()

        def sets() -> Iterator[tuple[int, list]]:
            for batch in (whole.slice(i, 512) for whole in batches for i in range(0, len(whole), 512)):
                for text in batch.column("text").to_pylist():
                    found = make.shingles(text)
                    node = node_of(signature(found))
                    if not len(found) or node in seen:
                        continue
                    if len(seen) >= NODES_HELD:
                        seen.clear()
                    seen.add(node)
                    yield node, part_classes(found[~often(found, frequent)], len(found), percent)

        return packed_postings(sets(), shards)

    return plain.mapInArrow(run, POSTED)


def shared_parts(postings: DataFrame) -> DataFrame:
    """``SHARED`` rows, one per shard, of the parts that several entries have."""

    def unpacked(low, high) -> np.ndarray:
        first = np.frombuffer(low.as_buffer(), np.uint32)
        steps = np.frombuffer(pa.decompress(high.as_buffer(), 2 * len(first), "zstd"), np.uint16)
        return np.cumsum(steps, dtype=np.uint16).astype(np.uint64) << np.uint64(32) | first

    def met(keys: np.ndarray, entries: np.ndarray) -> tuple:
        order = np.argsort(keys)
        keys = keys[order]
        equal = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
        several = equal[1:] | equal[:-1]  # far fewer, as a rule
        keys, entries = keys[several], entries[order[several]]
        order = np.lexsort((entries, keys))
        keys, entries = keys[order], entries[order]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1]) | (entries[1:] != entries[:-1])])[: len(keys)]  # copies of a set are one entry
        keys, entries = keys[fresh], entries[fresh]
        equal = np.concatenate([[False], keys[1:] == keys[:-1], [False]])[: len(keys) + 1]
        several = (equal[1:] | equal[:-1])[: len(keys)]
        return entries[several].tobytes(), np.packbits(~equal[:-1][several]).tobytes(), None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []

        def row(*values) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=SHARED.names)

        def flush() -> pa.RecordBatch:
            return row(*met(np.concatenate([k for k, _ in held]), np.concatenate([e for _, e in held])))

        for batch in batches:
            for of, low, high, entries, nodes, least in zip(batch.column("shard").to_pylist(), *(batch.column(c) for c in POSTED.names[1:])):
                if held and of != shard:
                    yield flush()
                    held = []
                if nodes.is_valid:
                    yield row(entries.as_py(), None, nodes.as_py(), least.as_py())
                else:
                    shard = of
                    held.append((unpacked(low, high), np.frombuffer(entries.as_py(), np.uint32)))
        if held:
            yield flush()

    return postings.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, SHARED)


def linking_entries(shared: DataFrame) -> DataFrame:
    """``entry`` and the ``nodes`` it is of, where it shares as many parts as a set that links does; and where it is of several."""
    known = StructType([StructField(c, LongType()) for c in ("entry", "node", "least")])
    counts = StructType([StructField(c, LongType()) for c in ("entry", "met")])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entries, nodes, least in zip(*(batch.column(c) for c in ("entries", "nodes", "least"))):
                columns = [np.frombuffer(entries.as_buffer(), np.uint32).astype(np.int64), *(np.frombuffer(c.as_buffer(), np.int64) for c in (nodes, least))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=known.names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            values, met = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(met.astype(np.int64))], names=counts.names)

        for batch in batches:
            for entries in batch.column("entries"):
                held.append(np.frombuffer(entries.as_py(), np.uint32))
                size += len(held[-1])
                if size >= SHARD_KEYS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    entries = shared.filter("nodes IS NOT NULL").select("entries", "nodes", "least").mapInArrow(read, known)
    entries = entries.groupBy("entry").agg(F.min("least").alias("least"), F.collect_set("node").alias("nodes"))
    met = shared.filter("nodes IS NULL").select("entries").mapInArrow(counted, counts).groupBy("entry").agg(F.sum("met").alias("met"))
    return entries.join(met, "entry", "left").filter("met >= least OR size(nodes) > 1").select("entry", "nodes")


def neighbour_edges(postings: DataFrame) -> DataFrame:
    """Edges between sets that stand side by side under one part, a chain through all that share it, folded to stars.

    Only sets that share as many parts as they must to link stand there.
    """
    shared = written(shared_parts(postings), "parts")
    linking = written(linking_entries(shared), "entries")
    bits = min(ENTRY_BITS, max(18, (16 * linking.count()).bit_length()))
    places = linking.select(F.shiftright("entry", 32 - bits).alias("place"))
    marks = postings.sparkSession.sparkContext.broadcast(np.packbits(marked_places(places, 1 << bits)))

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        set_bits = np.unpackbits(marks.value).astype(bool)
        for batch in batches:
            for packed, begins in zip(batch.column("entries"), batch.column("begins")):
                entries = np.frombuffer(packed.as_py(), np.uint32)
                part = np.cumsum(np.unpackbits(np.frombuffer(begins.as_py(), np.uint8), count=len(entries)), dtype=np.int64)
                stay = set_bits[entries >> np.uint32(32 - bits)]
                entries, part = entries[stay].astype(np.int64), part[stay]
                linked = part[1:] == part[:-1]
                yield np.stack([entries[1:][linked], entries[:-1][linked]])

    stars = shared.filter("nodes IS NULL").select("entries", "begins").mapInArrow(lambda batches: folded_portions(chains(batches)), EDGE)
    nodes = linking.select("entry", F.explode("nodes").alias("node"))
    ends = stars.join(nodes.select(F.col("entry").alias("a"), F.col("node").alias("from")), "a").join(nodes.select(F.col("entry").alias("b"), F.col("node").alias("to")), "b")
    alike = linking.filter("size(nodes) > 1").select(F.explode("nodes").alias("from"), F.array_min("nodes").alias("to"))
    return ends.select("from", "to").unionByName(alike).select(F.greatest("from", "to").alias("a"), F.least("from", "to").alias("b")).filter("a <> b")


def finer_groups(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` of groups split by the strong parts of another hash of all shingles; sets that meet no other are left out."""
    shards = shards_for(sets.agg(F.sum("n")).first()[0], percent, strong=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parted() -> Iterator[tuple[int, list]]:
            for batch in (whole.slice(i, 512) for whole in batches for i in range(0, len(whole), 512)):
                for i, component, packed in zip(*(batch.column(c).to_pylist() for c in ("id", "component", "shingles"))):
                    found = np.frombuffer(packed, np.uint64) * MIX[1]
                    found = np.sort(found ^ found >> np.uint64(29))
                    own = np.uint64(component * int(MIX[0]) & WHOLE)
                    yield i, [(c, keys ^ own, least) for c, keys, least in part_classes(found, len(found), percent, strong=True)]

        return packed_postings(parted(), shards)

    edges = neighbour_edges(sets.select("id", "component", "shingles").mapInArrow(run, POSTED))
    return sets.drop("component").join(connected(edges, fold=False), "id").select(*sets.columns)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """How many shingles lie in each bucket of the hash space, 255 at most."""
    return np.minimum(np.bincount((shingles >> np.uint64(54)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8)


def sketch_links(sketches: np.ndarray, sizes: np.ndarray, sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links that connect what all pairs connect whose sketches allow a link; rows come by size.

    Sets that link differ in ``(100 - percent) / (100 + percent)`` of their sizes' sum at most, and
    the counts of their buckets, clipped or not, in no more. With ``sides`` only rows of different
    sides are compared. Rows that are connected already are not.
    """
    root, found = np.arange(len(sizes)), []
    begins = np.searchsorted(sizes * 100, sizes * percent)
    for i, begin in enumerate(begins.tolist()):
        asked = root[begin:i] != root[i]
        if sides is not None:
            asked &= sides[begin:i] != sides[i]
        others = begin + np.flatnonzero(asked)
        own, least = sketches[i], 0
        for upto in (FIRST_BUCKETS, BUCKETS):
            if not len(others):
                break
            counts = sketches[others, least:upto]
            part = (np.maximum(counts, own[least:upto]) - np.minimum(counts, own[least:upto])).sum(1, dtype=np.int64)
            apart = part if not least else apart + part
            near = apart * (100 + percent) <= (sizes[others] + sizes[i]) * (100 - percent)
            others, apart, least = others[near], apart[near], upto
        for at in np.unique(root[others], return_index=True)[1].tolist():
            j = int(others[at])
            found.append((i, j))
            root[root == root[j]] = root[i]
    return found


def sketched_groups(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` of groups split by what their sketches allow; sets that meet no other are left out.

    Sketches are dealt in blocks, every block with itself and every other of its group. Links are
    folded where they are found, so a task has one Python worker.
    """
    schema = StructType([StructField("id", LongType()), StructField("component", LongType()), StructField("n", LongType()), StructField("sketch", BinaryType())])

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(np.frombuffer(packed.as_buffer(), np.uint64)).tobytes() for packed in batch.column("shingles")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "component", "n")), pa.array(made, pa.binary())], names=schema.names)

    def links_of(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[tuple] = []

        def flush() -> np.ndarray:
            ids = np.asarray([r[3] for r in held], np.int64)
            sides = None if held[0][1] == held[0][2] else np.asarray([r[4] for r in held])
            rows = np.frombuffer(b"".join(r[6] for r in held), np.uint8).reshape(-1, BUCKETS)
            links = np.asarray(sketch_links(rows, np.asarray([r[5] for r in held], np.int64), sides, percent), np.int64).reshape(-1, 2)
            return ids[links.T]

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("component", "low", "high", "id", "block", "n", "sketch"))):
                if held and held[0][:3] != row[:3]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    made = written(sets.select("id", "component", "n", "shingles").mapInArrow(sketched, schema), "sketches")
    blocks = written(made.groupBy("component").agg(F.ceil(F.count("*") / SKETCHES_HELD).cast("int").alias("blocks")), "blocks")
    placed = made.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    at = ["component", "low", "high"]
    pairs = dealt.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "block", "n", "sketch")
    edges = pairs.repartition(*at).sortWithinPartitions(*at, "n", "id").mapInArrow(lambda batches: folded_portions(links_of(batches)), EDGE)
    return sets.drop("component").join(connected(edges, fold=False), "id").select(*sets.columns)


def split_groups(sets: DataFrame, percent: int, tile: int, sketched: int = SKETCHED) -> DataFrame:
    """``sets`` with large groups split: by finer parts first those of more than ``sketched`` sets, then by sketches.

    A trie of sets that share passages is slow long before it fills a tile, so groups of a small part of one count as large.
    """
    large = (F.col("load") > tile // LIGHT) | (F.col("held") > FEW_SETS)
    for much, split in ((F.col("held") > sketched, finer_groups), (large, sketched_groups)):
        heavy = written(sets.groupBy("component").agg(F.sum("n").alias("load"), F.count("*").alias("held")).filter(much).select("component"), "heavy")
        if not heavy.isEmpty():
            parts = split(sets.join(heavy, "component", "left_semi").select(*sets.columns), percent)
            sets = written(sets.join(heavy, "component", "left_anti").select(*sets.columns).unionByName(parts), "split")
    return sets


def marked_places(places: DataFrame, size: int) -> np.ndarray:
    """Which of ``size`` places are among the rows' ``place``, gathered as a bit each."""
    place = F.col("place") + 1
    maps = places.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    found = np.zeros((size // 32768, 4096), np.uint8)
    for row in maps.collect():  # a job per partition otherwise
        found[row.bucket - 1] = np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(found.ravel(), bitorder="little").astype(bool)


def marked_ids(ids: DataFrame) -> np.ndarray:
    """A bit per place that an id hashes to: ``MARKS`` bits at most, whatever the number of ids."""
    return marked_places(ids.select(F.pmod(F.xxhash64("id"), F.lit(MARKS)).alias("place")), MARKS)


def candidate_sets(df: DataFrame, key: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """``id``, ``component``, ``n`` and the packed ``shingles`` of the wanted ids.

    Texts are not shuffled: ids whose mark is not set are passed over where they lie, and what is
    made of the others is joined, which drops those that a wanted id shares its mark with.
    """
    marks = df.sparkSession.sparkContext.broadcast(np.packbits(marked_ids(wanted)))
    plain = df.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.pmod(F.xxhash64(F.col(f"`{key}`").cast("long")), F.lit(MARKS)).alias("place"), F.col(f"`{text}`").cast("string").alias("text")
    )
    schema = StructType([StructField("id", LongType()), StructField("n", LongType()), StructField("shingles", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, set_bits = shingler(width), np.unpackbits(marks.value).astype(bool)
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, len(whole), 512)):
            kept = batch.filter(pa.array(set_bits[batch.column("place").to_numpy()]))
            sets = [make.shingles(t) for t in kept.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [kept.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=schema.names
            )

    return plain.mapInArrow(run, schema).join(wanted, "id").dropDuplicates(["id", "shingles"])


class Trie:
    """Ordered sets by common beginnings, path-compressed, with the sizes of the sets below each node."""

    __slots__ = ("segment", "kids", "ends", "low", "high")

    def __init__(self, segment: np.ndarray):
        self.segment, self.kids, self.ends = segment, {}, []
        self.low, self.high = 1 << 60, 0

    def insert(self, ordered_set: np.ndarray, number: int) -> None:
        node, rest, n = self, ordered_set, len(ordered_set)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if not len(rest):
                node.ends.append(number)
                return
            kid = node.kids.get(int(rest[0]))
            if kid is None:
                kid = node.kids[int(rest[0])] = Trie(rest)
                kid.low = kid.high = n
                kid.ends.append(number)
                return
            m = min(len(kid.segment), len(rest))
            differ = np.flatnonzero(kid.segment[:m] != rest[:m])
            shared = int(differ[0]) if len(differ) else m
            if shared < len(kid.segment):  # split the path where the sets part
                upper = Trie(kid.segment[:shared])
                upper.low, upper.high = kid.low, kid.high
                kid.segment = kid.segment[shared:]
                upper.kids[int(kid.segment[0])] = kid
                node.kids[int(rest[0])] = upper
                kid = upper
            node, rest = kid, rest[shared:]


class Groups:
    """Union-find over the sets of a tile."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)
        return i != j


def overlap(segment: np.ndarray, by_value: np.ndarray) -> int:
    at = np.searchsorted(by_value, segment)
    at[at == len(by_value)] = 0
    return int((by_value[at] == segment).sum())


def trie_links(sets: list[np.ndarray], percent: int, frequent: np.ndarray, ranks: np.ndarray, old: list[bool] | None = None, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links connect; ``old`` sets are only compared with the others.

    ``known`` gives the component a set is known to be in already.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    groups, found = Groups(len(sets)), []
    olds, others = Trie(np.zeros(0, np.uint64)), Trie(np.zeros(0, np.uint64))
    firsts: dict[int, int] = {}
    for i, component in enumerate(known or []):
        groups.union(firsts.setdefault(component, i), i)
    for i in order:
        by_value, n = sets[i], len(sets[i])
        if not n:
            continue
        least = needed(n, percent)
        passed = bool(old and old[i])
        stack = [(tree, 0, 0) for tree in ((others,) if passed else (olds, others))]
        while stack:
            node, shared, depth = stack.pop()
            if node.high < least:
                continue
            smallest = max(node.low, least)
            need = -(-percent * (n + smallest) // (100 + percent))
            if len(node.segment):
                if len(node.ends) == 1 and not node.kids and groups.find(node.ends[0]) == groups.find(i):
                    continue
                for begin in range(0, len(node.segment), 256):
                    part = node.segment[begin : begin + 256]
                    shared += overlap(part, by_value)
                    depth += len(part)
                    if shared + min(n - shared, node.high - depth) < need:
                        break
                else:
                    begin = -1
                if begin >= 0:
                    continue
            for j in node.ends:
                if (100 + percent) * shared >= percent * (n + depth) and groups.union(i, j):
                    found.append((i, j))
            stack.extend((kid, shared, depth) for kid in node.kids.values())
        (olds if passed else others).insert(ordered(by_value, frequent, ranks), i)
    return found


def tile_links(tiles: DataFrame, percent: int, order) -> DataFrame:
    """Links within tiles: rows of ``tile``, ``id``, ``old``, ``known`` and the packed ``shingles``, of one tile side by side."""
    pair = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, ranks = order.value
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            sets = [np.frombuffer(r[4], np.uint64) for r in held]
            links = trie_links(sets, percent, frequent, ranks, [r[2] for r in held], [r[3] for r in held])
            ids = [(held[i][1], held[j][1]) for i, j in links]
            return pa.RecordBatch.from_arrays([pa.array([min(p) for p in ids], pa.int64()), pa.array([max(p) for p in ids], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "id", "old", "known", "shingles"))):
                if held and held[0][0] != row[0]:
                    yield flush()
                    held = []
                held.append(row)
        if held:
            yield flush()

    return tiles.select("tile", "id", "old", "known", "shingles").repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(run, pair)


def keyed_nodes(docs: DataFrame, key: str) -> tuple[DataFrame, str, int | None]:
    """``docs`` with a node of the graph per row: its key or, for null keys, a number above all keys.

    Also the name of that column, which no other has, and the largest key, or None without null keys.
    """
    own, node = F.col(f"`{key}`"), own_prefix(docs) + "node"
    if docs.filter(own.isNull()).isEmpty():
        return docs.withColumn(node, own.cast("long")), node, None
    largest = docs.agg(F.max(own.cast("long"))).first()[0]
    largest = -1 if largest is None else int(largest)
    number = F.lit(largest).cast("long") + 1 + F.monotonically_increasing_id()
    without = written(docs.filter(own.isNull()).withColumn(node, number), "nullkeys")  # pinned: the numbers are read several times
    return docs.filter(own.isNotNull()).withColumn(node, own.cast("long")).unionByName(without), node, largest


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90, frequent: int = FREQUENT, tile: int = TILE_SHINGLES) -> DataFrame:
    """``key``, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    A-Z are lower-cased and words are what ASCII white space separates. A text of fewer than
    ``width`` words is one shingle; null, empty and blank texts have none and link with nothing.
    Two sets link when their intersection is ``percent`` of their union or more. Equal sets link,
    rows with equal keys are one node of the graph. Every row with a null key is a node of its own,
    compared like the others; its component is null if no key is reachable. Keys are whole numbers.
    An empty table gives no rows; other columns are not read. ``frequent`` shingles at most are put
    last in the global order, which changes the work and not the result, and is all that is
    broadcast. ``tile`` bounds the shingles that one task holds.
    """
    plain = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("body"))
    nodes, node, largest = keyed_nodes(plain, "key")
    found = node_components(nodes, node, "body", width, percent, frequent, tile)

    def told(name: str):
        return F.col(name) if largest is None else F.when(F.col(name) <= largest, F.col(name))

    return found.select(told("node").alias(key), "n_shingles", told("component").alias("component_id"))


def node_components(df: DataFrame, key: str, text: str, width: int, percent: int, frequent: int = FREQUENT, tile: int = TILE_SHINGLES) -> DataFrame:
    """``node``, ``n_shingles`` and ``component``, the smallest node reachable, of rows whose ``key`` is never null."""
    spark = df.sparkSession
    rows = written(set_rows(df, key, text, width), "sets")
    docs = rows.filter("sig IS NOT NULL")
    held, shingles = docs.agg(F.count("*"), F.sum("n")).first()
    least = max(LEAST_OFTEN, held // ONE_IN)
    counted = rows.filter("sig IS NULL").groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "id").limit(frequent)
    listed = np.asarray([(r.id, r.n) for r in counted.collect()], np.int64).reshape(-1, 2)
    values = listed[:, 0].astype(np.int64).view(np.uint64)
    by_value = np.argsort(values)
    order = spark.sparkContext.broadcast((values[by_value], listed[by_value, 1]))

    reps = written(docs.filter("n > 0").groupBy("sig", "node").agg(F.min("id").alias("rep")), "reps")
    groups = connected(neighbour_edges(part_postings(df, text, width, percent, order, shards_for(shingles, percent))), fold=False).withColumnRenamed("id", "node")
    wanted = written(reps.select(F.col("rep").alias("id"), "node").join(groups, "node").select("id", "component").distinct(), "wanted")
    sets = written(candidate_sets(df, key, text, width, wanted), "shingles")
    sets = split_groups(sets, percent, tile)
    # Only groups of several blocks are listed, so the shingles of the others are not shuffled for it.
    loads = sets.groupBy("component").agg(F.sum("n").alias("load")).filter(F.col("load") > tile)
    several = written(loads.select("component", F.ceil(F.col("load") / tile).cast("int").alias("several")), "loads")
    cut = sets.join(several, "component", "left").withColumn("blocks", F.coalesce("several", F.lit(1))).drop("several")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    near = F.when(F.col("blocks") > 1, F.array(F.col("block"), F.pmod(F.col("block") + 1, F.col("blocks")).cast("int"))).otherwise(F.array(F.col("block")))
    first = cut.select("id", "shingles", "component", F.explode(F.array_distinct(near)).alias("block"))
    tiles = first.select(F.struct("component", "block").alias("at"), "id", "shingles")
    tiles = tiles.select(F.xxhash64("at.component", "at.block").alias("tile"), "id", F.lit(False).alias("old"), F.col("id").alias("known"), "shingles")
    links = written(tile_links(tiles, percent, order), "links")
    large = written(cut.filter("blocks > 2").select("id", "component", "block", "blocks"), "large")
    if not large.isEmpty():
        links = links.unionByName(left_over(large, sets, connected(links), percent, order))
    joined = written(connected(links), "joined")
    named = docs.select("id", "n", "sig").join(reps.select("sig", "rep"), "sig", "left")
    ends = named.join(joined.withColumnRenamed("id", "rep").withColumnRenamed("component", "reached"), "rep", "left")
    return ends.select(F.col("id").alias("node"), F.col("n").alias("n_shingles"), F.coalesce("reached", "rep", "id").alias("component"))


def left_over(large: DataFrame, sets: DataFrame, linked: DataFrame, percent: int, order) -> DataFrame:
    """Links of groups of many blocks between what the largest component leaves out and every block."""
    placed = written(large.join(linked.withColumnRenamed("component", "reached"), "id", "left").withColumn("reached", F.coalesce("reached", "id")), "placed")
    sizes = placed.groupBy("component", "reached").agg(F.count("*").alias("held"))
    main = sizes.groupBy("component").agg(F.max_by("reached", F.struct("held", "reached")).alias("main"))
    known = placed.join(main, "component")
    rest = known.filter("reached <> main").select("id", "component", "blocks", "reached", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    slices = rest.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    asked = slices.select("component", "block", "slice").distinct()
    passing = known.select("id", "component", "block", "reached").join(asked, ["component", "block"])
    both = slices.select("id", "component", "block", "slice", "reached", F.lit(False).alias("old")).unionByName(
        passing.select("id", "component", "block", "slice", "reached", F.lit(True).alias("old"))
    )
    once = both.groupBy("id", "component", "block", "slice", "reached").agg(F.min("old").alias("old"))
    tiles = once.join(sets.select("id", "shingles"), "id")
    keyed = tiles.select(F.xxhash64("component", "block", "slice").alias("tile"), "id", "old", F.col("reached").alias("known"), "shingles")
    return tile_links(keyed, percent, order)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, with all their columns.

    Every row with a null key is a document of its own, compared like the others and after all keys
    in order: it goes if a row with a key is in its component, and one row stays of a component of
    null keys only. Columns of ``docs`` may have any names.
    """
    nodes, node, _ = keyed_nodes(docs, key)
    found = node_components(nodes, node, text, width, percent)
    stay = written(found.filter("node = component").select("node").distinct(), "stay")
    return nodes.join(stay, nodes[node] == stay["node"], "left_semi").drop(node)
