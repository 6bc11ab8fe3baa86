"""Null keys, different texts under one key, clashing names, and operators against their definitions."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortlane.llm import exact_dedup, fingerprints, jaccard_join, language_id, line_dedup, packing, sharding
from cohortlane.llm.components import connected
from cohortlane.llm.queries import SPECIALS

from tests.llm.plain_language import plain_kept, plain_model
from tests.llm.test_llm import brute_components, folded


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


# 2


def test_null_keys_link_like_others(spark):
    rng = random.Random(1)
    base = words(rng, 61)
    near = lambda k: " ".join([*base[:k], "x", *base[k + 1 :]])
    other = " ".join(words(rng, 80))
    rows = [(5, near(0), "a"), (None, near(60), "b"), (7, near(60), "c"), (None, " ".join(base), "d"), (None, other, "e"), (None, other + " more", "f"), (None, None, "g"), (9, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string").repartition(3)
    found = jaccard_join.jaccard_components(df).collect()
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter({(5, 5): 1, (7, 5): 1, (None, 5): 2, (None, None): 3, (9, 9): 1})
    assert jaccard_join.jaccard_components(df.filter("doc_id IS NULL")).filter("component_id IS NULL").count() == 5


def test_columns_of_any_names(spark):
    rng = random.Random(2)
    one, two = " ".join(words(rng, 90)), " ".join(words(rng, 90))
    rows = [(1, one, 10, "p", "q", 1.0, None), (2, one, 11, "p", "q", 2.0, "t"), (3, two, 12, "r", None, 3.0, "t"), (3, two, 13, "s", "u", 4.0, "t"), (None, two, 14, "s", "u", 4.0, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, __sha string, __node string, node double, _tag string")
    for kept, ids in ((exact_dedup.drop_copies(df, keep="min"), [1, 3]), (jaccard_join.one_of_each(df), [1, 3, 3])):
        assert kept.columns == df.columns
        found = [tuple(r) for r in kept.collect()]
        assert sorted(r[0] for r in found) == ids and all(r in rows for r in found)
    assert language_id.drop_unidentified(df.withColumn("lang", F.lit("en")).withColumn("distance", F.lit("x"))).columns == [*df.columns, "lang", "distance"]


@pytest.mark.parametrize("width, percent", [(5, 80), (3, 90)])
def test_candidate_groups_stay_near_the_components(spark, width, percent):
    """What is compared with each other is little more than what links."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    order = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    groups = connected(jaccard_join.neighbour_edges(jaccard_join.part_postings(docs, "text", width, percent, order)), fold=False)
    largest = groups.groupBy("component").count().agg(F.max("count")).first()[0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {}
    for i, text in rows:
        found = folded(text).split()
        k = min(width, len(found))
        sets[i] = frozenset(tuple(found[j : j + k]) for j in range(len(found) - k + 1)) if found else frozenset()
    components = defaultdict(set)
    for i, (_, c) in brute_components(rows, width, percent).items():
        components[c].add(sets[i])
    true = max(len(distinct) for distinct in components.values())
    assert largest <= 2 * true + 10


@pytest.mark.parametrize("percent", [80, 90])
def test_finer_groups_lose_no_link(spark, percent):
    rng = random.Random(percent)
    texts = []
    for k in range(30):
        base = words(rng, rng.randrange(8, 160))
        texts.append(" ".join(base))
        for _ in range(3):
            changed = list(base)
            for _ in range(rng.randrange(1, 4)):
                changed[rng.randrange(len(changed))] = "y"
            texts.append(" ".join(changed))
    make = jaccard_join.Shingler(3)
    sets = [(i, 7, len(s), s.tobytes()) for i, s in enumerate(map(make.shingles, texts))]
    df = spark.createDataFrame(sets, "id long, component long, n long, shingles binary")
    found = {r.id: r.component for r in jaccard_join.finer_groups(df, percent).collect()}
    want = brute_components(list(enumerate(texts)), 3, percent)
    linked = Counter(c for _, c in want.values())
    for i, (_, c) in want.items():
        if linked[c] > 1:
            assert found[i] == found[c]
    assert len(set(found.values())) >= 15  # one group became about as many as there are components


@pytest.mark.parametrize("percent", [80, 90])
def test_sets_with_common_passages_part(spark, monkeypatch, percent):
    monkeypatch.setattr(jaccard_join, "SKETCHES_HELD", 30)  # several blocks
    rng = np.random.default_rng(percent)

    def fresh(n: int) -> np.ndarray:
        return rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)

    passages, rows = fresh(600).reshape(20, 30), []
    for i in range(80):
        chosen = passages[rng.permutation(20)[:14]].ravel()
        base = np.unique(np.concatenate([chosen, fresh(int(rng.integers(900, 1100)))]))
        rows.append((2 * i, base))
        if i % 4 == 0:  # the most that still links, by exchanging
            size = len(base)
            drop = next(d for d in range(size, -1, -1) if 100 * (size - d) >= percent * (size + d))
            rows.append((2 * i + 1, np.unique(np.concatenate([base[drop:], fresh(drop)]))))
    df = spark.createDataFrame([(i, 7, len(s), s.tobytes()) for i, s in rows], "id long, component long, n long, shingles binary")
    load = sum(len(s) for _, s in rows)
    found = {r.id: r.component for r in jaccard_join.split_groups(df, percent, load // 3).collect()}
    assert found == {i // 8 * 8 + k: i // 8 * 8 for i, _ in rows if i % 2 for k in (0, 1)}


@pytest.mark.parametrize("strong", [False, True])
@pytest.mark.parametrize("percent", [80, 90])
def test_linking_sets_share_a_key(percent, strong):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for drop in range(0, n):  # the most that still links, by taking away, adding and exchanging
                kept = base[drop:]
                more = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
                linked = False
                for other in (kept, more):
                    both = len(np.intersect1d(base, other))
                    if len(other) and 100 * both >= percent * (len(base) + len(other) - both):
                        linked = True
                        keys = (jaccard_join.part_keys(s, len(s), percent, strong) for s in (base, other))
                        assert len(np.intersect1d(*keys))
                if not linked:
                    break


# 3, 6, 9


def test_null_keys_elsewhere(spark):
    rows = [(None, "Same"), (None, "same"), (4, "SAME"), (None, None), (None, "x y"), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    groups = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(df).collect())
    assert groups == Counter({(None, 4, 3, False): 2, (4, 4, 3, True): 1, (None, 2, 2, False): 1, (2, 2, 2, True): 1, (None, None, 1, True): 1})
    prints = fingerprints.fingerprints(df).collect()
    assert sorted((r.n_chars for r in prints if r.doc_id is None)) == [0, 3, 4, 4] and len(prints) == 6
    shards = sharding.write_shards(df).collect()
    assert len({r["shard"] for r in shards if r.doc_id is None}) == 1 and sum(r.doc_id is None for r in shards) == 4


# 4


def test_ids_of_long_texts(monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIALS)
    monkeypatch.setattr(packing, "PORTION", 30)
    rng = random.Random(5)
    parts = ["a", "bc", "The", " ", "  ", "\n", "\t", "é", "😀", "1", "23", "'s", "!", "<|endoftext|>", "\u3000", "\xa0", "x" * 50, " " * 45]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        assert ids.of(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert "".join(packing.portions(text)) == text


# 7


def test_language_codes_against_the_definition(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 1500][:90]
    docs += [(None, docs[0][1], "fr"), (9001, None, "en"), (9002, "123 !", "en"), (9003, "ÄÖ ß été", None), (9004, "", "de")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    decode = plain_model([(t, x) for i, t, x in docs if not held(i)])
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    found = {r.doc_id: r for r in language_id.language_id(df).collect()}
    assert len(found) == len(docs)
    for i, text, _ in docs:
        lang, score, _, _ = decode(text)
        assert (found[i].lang_pred, found[i].held_out) == (lang, held(i)) and abs(found[i].score - score) < 1e-3


def test_language_stage_against_the_definition(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 2500]
    rng = random.Random(9)
    docs += [(10**6 + k, " ".join("".join(rng.choice("абвгдежзик") for _ in range(5)) for _ in range(3 * k + 1)), [None, "ru"][k == 50]) for k in range(30)]
    docs += [(None, "12 34", "en"), (None, None, None), (None, docs[0][1], None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    found = Counter(tuple(r) for r in language_id.drop_unidentified(df).collect())
    keyed = [(i if i is not None else f"null {n}", t, x) for n, (i, t, x) in enumerate(docs)]
    stays = plain_kept(keyed, [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in docs])
    want = Counter((None if isinstance(i, str) else i, t, x) for i, t, x in keyed if i in stays)
    assert found == want and 0 < len(docs) - sum(want.values()) < 40


def test_language_stage_rejects_by_distance(spark):
    source = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    by_lang = {r.lang: r.text for r in source.filter("length(text) > 800").collect()}
    rng = random.Random(6)
    greek = " ".join("".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(rng.randrange(2, 9))) for _ in range(200))
    han = "".join(rng.choice("漢字仮名交文日本語学校生先今何時間行来見食") for _ in range(900))
    added = [(10**6, greek, "x", False), (10**6 + 1, han, "x", False), (10**6 + 2, "0123 -- 45", "x", False), (10**6 + 3, "漢字", "x", True)]
    added += [(10**6 + 10 + k, text, "x", True) for k, text in enumerate(by_lang.values())]
    pairs = [f"{a} {b}" for i, a in enumerate(by_lang.values()) for b in list(by_lang.values())[i + 1 :]]
    added += [(10**6 + 20 + k, text, "x", True) for k, text in enumerate(pairs)]
    # Without a label the added rows are not learned from.
    extra = spark.createDataFrame([(i, t, None) for i, t, _, _ in added], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language_id.drop_unidentified(source.unionByName(extra)).collect()}
    assert {i: i in kept for i, _, _, _ in added} == {i: stays for i, _, _, stays in added}
    clean = {r.doc_id for r in source.collect()}
    assert not clean - kept  # what the table holds stays


# 10


def test_line_dedup_of_different_texts_under_one_key(spark):
    rows = [(i, "common\nown %d" % i) for i in range(10)] + [(100, "common\nx"), (100, "precious\ncommon\ny"), (100, "common\nx"), (None, "common\nz"), (None, "q\nr\n COMMON ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(df, min_docs=10).collect())
    want = Counter({(i, 2, 1, f"own {i}"): 1 for i in range(10)})
    want += Counter({(100, 2, 1, "x"): 2, (100, 3, 1, "precious\ny"): 1, (None, 2, 1, "z"): 1, (None, 3, 1, "q\nr"): 1})
    assert found == want
    # Twelve documents hold the line: ten keys, the key 100 and the null key.
    assert line_dedup.line_dedup(df, min_docs=13).filter("n_dropped > 0").count() == 0
    assert line_dedup.line_dedup(df, min_docs=12).filter("n_dropped > 0").count() == len(rows)
    first = Counter((r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(df, min_docs=12, keep="first").collect())
    assert first[None, 0] == 1 and first[None, 1] == 1 and sum(first.values()) == len(rows)


def test_a_line_that_most_documents_hold(spark):
    """One hash with a third of all lines: it is cut into slices, and every row loses its own."""
    rows = [(i, f"the common line\nown {i}\nmore {i % 40}") for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    found = {r.doc_id: r.kept_text for r in line_dedup.line_dedup(df, min_docs=1000).collect()}
    assert found == {i: f"own {i}\nmore {i % 40}" for i in range(1500)}


@pytest.mark.parametrize("percent", [80, 90])
def test_linking_sets_share_as_many_parts_as_both_need(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 40, 3), 100, 1000]:
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for drop in range(n):
            other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
            both = len(np.intersect1d(base, other))
            if 100 * both < percent * (len(base) + len(other) - both):
                break
            for strong in (False, True):
                ours, theirs = ({c: (keys, least) for c, keys, least in jaccard_join.part_classes(s, len(s), percent, strong)} for s in (base, other))
                assert any(len(np.intersect1d(ours[c][0], theirs[c][0])) >= max(ours[c][1], theirs[c][1], 1) for c in set(ours) & set(theirs))


def passage_texts(rng) -> list[tuple[int, str]]:
    """Texts of which the last of every ten is a near copy of the one before it; all hold three of ten passages."""
    passages = [[f"p{k}x{j}" for j in range(45)] for k in range(10)]
    rows = []
    for i in range(300):
        body = [f"w{i}x{j}" for j in range(500)]
        for k in rng.permutation(10)[:3]:
            body.extend(passages[k])
        rows.append((i, " ".join(body)))
        if i % 10 == 9:
            rows[-1] = (i, rows[-2][1].replace(f"w{i - 1}x7 ", "other "))
    return rows


def test_sets_that_share_passages_only_are_no_candidates(spark):
    rows = passage_texts(np.random.default_rng(6))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    order = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    groups = connected(jaccard_join.neighbour_edges(jaccard_join.part_postings(docs, "text", 5, 80, order)), fold=False)
    make = jaccard_join.Shingler(5)
    nodes = {jaccard_join.node_of(jaccard_join.signature(make.shingles(text))): i for i, text in rows}
    found = {nodes[r.id]: r.component for r in groups.collect()}
    assert sorted(found) == [i for i in range(300) if i % 10 > 7]
    assert all(found[i] == found[i - 1] for i in range(9, 300, 10))


def test_parts_are_dealt_packed(spark):
    rows = passage_texts(np.random.default_rng(7))[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    order = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    made = jaccard_join.part_postings(docs, "text", 5, 80, order).collect()
    size = sum(len(v) if isinstance(v, (bytes, bytearray)) else 8 for r in made for v in r if v is not None)
    keys = sum(len(jaccard_join.part_keys(s, len(s), 80)) for s in (jaccard_join.Shingler(5).shingles(text) for _, text in rows))
    assert size <= 10.5 * keys


def test_entries_of_several_sets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PACKED_KEYS", 700)
    rows = passage_texts(np.random.default_rng(8))[:40]
    make = jaccard_join.Shingler(5)
    sets = [(i, s, jaccard_join.part_classes(s, len(s), 80)) for i, s in ((i, make.shingles(text)) for i, text in rows)]
    monkeypatch.setattr(jaccard_join, "entry_of", lambda node, c: (node // 2 * 2654435761 + c) % (1 << 32))  # two sets to an entry
    batches = list(jaccard_join.packed_postings(((i, classes) for i, _, classes in sets), 3))
    made = spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], jaccard_join.POSTED)
    found = {r.id: r.component for r in connected(jaccard_join.neighbour_edges(made), fold=False).collect()}
    assert all(found[i] == found[i - 1] for i in (9, 19, 29, 39))


def test_small_groups_of_many_sets_are_split(spark, monkeypatch):
    rng = np.random.default_rng(9)
    sets = [(i, 7, 60, np.sort(rng.integers(0, 1 << 63, 60, dtype=np.uint64)).tobytes()) for i in range(40)]
    sets += [(100 + i, 7, 60, packed) for i, _, _, packed in sets[:3]]
    df = spark.createDataFrame(sets, "id long, component long, n long, shingles binary").repartition(2)
    found = {r.id: r.component for r in jaccard_join.split_groups(df, 80, 30_000).collect()}
    assert found == {k * 100 + i: i for i in range(3) for k in (0, 1)}
