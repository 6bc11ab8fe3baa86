"""The operators against brute force and the libraries they stand for, on odd and on given rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortlane.llm import bpe, components, context_tree, exact_dedup, fingerprints, jaccard_join, language_id, line_dedup, packing, sharding, token_counts
from cohortlane.llm.queries import SPECIALS

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank long, id string, hash string, n long"


def texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "straße", "été", "a", "b", "don't", "42", "<|endoftext|>", "<s>"]
    body = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 90))) for _ in range(40)]
    long = " ".join(rng.choice(words) for _ in range(6000))
    copies = [long, long.upper(), body[0], body[0], body[0] + " more"]
    odd = [None, None, "", "", " ", "\n", "\n\n", " \t\r\n ", "a", "A", "é", "😀 漢字 x", "x  y   z ", "tab\tend\n line ", "▁a ▁", "\x1c\x1f"]
    shared = "This very line is in all of these."
    lines = [f"{shared}\nown line {i}\n {shared.upper()} \n" for i in range(12)]
    return body + copies + odd + lines


@pytest.fixture(scope="module")
def rows():
    found = [(i, t) for i, t in enumerate(texts())]
    return found + found[5:7]  # two rows twice


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs = ["en", "de", None]
    return spark.createDataFrame([(i, t, langs[i % 3], "s", 1, i, "x", "y", 5) for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    """Rows by document; repeated rows must agree."""
    found = {}
    for row in df.collect():
        values = tuple(v for k, v in row.asDict().items() if k not in ("slot", "sequence_id", "offset"))
        assert found.setdefault(row["doc_id"], (values, row))[0] == values
    return {k: v[1] for k, v in found.items()}


def folded(text):
    return (text or "").encode().lower()


# 1


def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe_round_trip(docs, rows, empty):
    want = reference_encoding()
    got = by_id(bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN))
    assert bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN).count() == len(rows)
    for i, text in rows:
        ids = want.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].same
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.bpe_round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_decoder_keeps_the_decimal_ids():
    machine = bpe.decoder(RANKS)
    assert machine.decimal == {rank: str(rank) for rank in machine.tokens}


def test_bpe_frames(docs, rows):
    encoded = bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN, ["doc_id"])
    back = by_id(bpe.bpe_decode(encoded, RANKS, ["doc_id"]))
    assert all(back[i].text == (text or "") for i, text in rows)


def test_transducer_against_library():
    rng, want, own = random.Random(5), reference_encoding(), bpe.Encoder(RANKS, public_tokenizers.PATTERN, 50)
    own.transducer.max_states = 200  # tables are given up and made anew all the time
    tokens = list(bpe.load_ranks(RANKS))
    letters = "aAbB 's've\n\t\r \x1c\x85 éßñ😀漢123.,!?-_"
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert own.encode(text) == want.encode_ordinary(text)
        text = b"".join(rng.choice(tokens) for _ in range(5)).decode("utf-8", "ignore")
        assert own.encode(text) == want.encode_ordinary(text)
    for text in ("ab" * 9000, " " * 9000, "".join(rng.choice("abcdefgh") for _ in range(9000))):
        assert own.encode(text) == want.encode_ordinary(text)


def test_decoder_streams_characters():
    want, machine = reference_encoding(), bpe.decoder(RANKS)
    text = "naïve 😀漢字 ÿࠀ\U0010ffff end"
    ids = want.encode_ordinary(text)
    machine.reset()
    parts = [machine.feed([i]) for i in ids]
    machine.finish()
    assert "".join(parts) == text
    machine.reset()
    machine.feed(want.encode_ordinary("😀")[:1])
    with pytest.raises(ValueError):
        machine.finish()
    table = bpe.utf8_machine()
    for raw in (b"\xc0\x80", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xff", b"\x80"):
        state = 0
        for byte in raw:
            state = table[state][byte]
        assert state == 1


# 2


def brute_components(pairs, width, percent):
    sets = {}
    for i, text in pairs:
        words = folded(text).split()
        k = min(width, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width, percent, tile", [(3, 90, 10**6), (5, 80, 10**6), (3, 90, 300)])
def test_jaccard_components(spark, rows, width, percent, tile):
    rng = random.Random(width)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    near = []
    for k in range(60):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9)}"
        near.append((1000 + k, " ".join(words)))
    all_rows = rows + near
    df = spark.createDataFrame(all_rows, "doc_id long, text string").repartition(3)
    got = by_id(jaccard_join.jaccard_components(df, width=width, percent=percent, tile=tile, frequent=20))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(all_rows, width, percent)


def test_jaccard_edges(docs, rows, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.jaccard_components(docs).count() == len(rows)
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = brute_components(rows, 5, 80)
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_one_of_each_with_null_keys(spark):
    rng = random.Random(10)
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(200)) for _ in range(4)]
    kept = [(5, long[0], "key"), (None, long[1], "alone"), (None, None, "no text"), (None, None, "no text either"), (9, long[3], "other")]
    gone = [(None, long[0] + " more", "near a key"), (None, long[2], "one of two"), (None, long[2] + " more", "one of two")]
    df = spark.createDataFrame(kept + gone, "doc_id long, text string, name string").repartition(3)
    found = jaccard_join.one_of_each(df)
    assert found.columns == df.columns
    assert sorted(r.name for r in found.collect()) == sorted([name for _, _, name in kept] + ["one of two"])
    only = jaccard_join.one_of_each(df.filter("doc_id IS NULL"))
    assert only.count() == 5 and only.filter("doc_id IS NOT NULL").count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7), (2000, 1001)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(chain, "a long, b long").repartition(20)).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 2000: 1000}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# 3


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(docs, rows, empty, keep):
    groups = defaultdict(list)
    for i, text in rows:
        groups[folded(text)].append(i)
    got = by_id(exact_dedup.exact_groups(docs, keep=keep))
    best = max if keep == "max" else min
    for i, text in rows:
        members = groups[folded(text)]
        row = got[i]
        assert (row.keep_id, row.group_size, row.kept) == (best(members), len(members), i == best(members))
        assert row.text_sha256 == hashlib.sha256(folded(text)).hexdigest()
    kept = exact_dedup.drop_copies(docs, keep=keep)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(best(m) for m in groups.values())
    assert exact_dedup.exact_groups(empty).count() == 0


def test_exact_groups_with_colliding_hashes(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "content_hash", lambda body: F.substring(F.md5(body), 1, 1))
    test_exact_groups(docs, rows, docs.limit(0), "max")


# 4


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, RANKS, public_tokenizers.PATTERN, SPECIALS).collect()
    want = Counter()
    for i, text in rows:
        ids = np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        start, length, piece = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            want[i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
            start, length, piece = start + length, 1024, piece + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert_packed(got)
    assert packing.pack_documents(empty, RANKS, public_tokenizers.PATTERN, SPECIALS).count() == 0


def assert_packed(rows):
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        place = 0
        for offset, length in sorted(pieces):
            assert offset == place
            place += length
        assert place <= 1024
    return len(held)


def test_pack_is_near_the_bound(spark):
    rng = random.Random(1)
    lengths = [rng.randrange(1, 1025) for _ in range(6000)] + [600] * 500 + [1024] * 300
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(7)
    used = assert_packed(packing.pack(df).collect())
    assert used <= 1.01 * max(math.ceil(sum(lengths) / 1024), sum(n > 512 for n in lengths))


@pytest.mark.parametrize("lengths", [[1], [1024], [200] * 11, [700] * 3, [1] * 1025, [300, 300, 300, 300]])
def test_pack_small_cases(spark, lengths):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(df).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert_packed(rows)


# 5


def test_token_counts(docs, rows, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.token_counts(docs, path, limit=1000))
    for i, text in rows:
        n = len(library.encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1000)
    assert token_counts.token_counts(empty, path).count() == 0


def test_token_counts_with_a_small_table():
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, rng = token_counts.PieceCounter(path, 7), random.Random(2)
    found = ["".join(rng.choice("aAb \n▁<s>é😀 ") for _ in range(rng.randrange(25))) for _ in range(600)]
    for i in range(0, 600, 50):
        part = found[i : i + 50]
        assert counter.totals(part) == [len(counter.model.encode(t)) for t in part]


# 6


def test_fingerprints(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 2000)
    got = by_id(fingerprints.fingerprints(docs.dropDuplicates(["doc_id"])))
    ordered = sorted(((i, t or "") for i, t in dict(rows).items()), reverse=True)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].edited_fingerprint == fingerprints.Prefixes.of(edited).fingerprint()
        assert got[i].near_next == fingerprints.likeness(got[i].fingerprint, fingerprints.Prefixes.of(after).fingerprint())
        assert 0 <= got[i].near_edited <= 1
    twice = fingerprints.fingerprints(docs)
    assert twice.count() == len(rows)
    assert twice.filter("doc_id = 5 AND near_next = 1").count() == 1  # the first of two equal rows is followed by the other
    same = defaultdict(set)
    for i, text in rows:
        same[text or ""].add(got[i].fingerprint)
    assert all(len(found) == 1 for found in same.values()) and len({min(f) for f in same.values()}) == len(same)
    assert fingerprints.fingerprints(empty).count() == 0


def test_spans_and_extensions():
    rng = random.Random(4)
    a = "".join(rng.choice("ab") for _ in range(300))
    b = a[40:200] + "zz" + a[200:]
    x, y = fingerprints.Prefixes.of(a), fingerprints.Prefixes.of(b)
    for i, j in ((40, 0), (0, 0), (200, 162), (299, 3), (300, 5)):
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert x.common(i, y, j) == n
    assert (x.joined(100, y, 50).sums == fingerprints.Prefixes.of(a[:100] + b[:50]).sums).all()


def test_likeness():
    text = " ".join(f"word{i}" for i in range(400))
    near = text.replace("word200", "other")
    far = " ".join(f"else{i}" for i in range(400))
    mark = lambda t: fingerprints.Prefixes.of(t).fingerprint()
    assert fingerprints.likeness(mark(text), mark(text)) == 1
    assert fingerprints.likeness(mark(text), mark(near)) > 0.9
    assert fingerprints.likeness(mark(text), mark(far)) < 0.1
    assert fingerprints.likeness(mark(""), mark(text)) == 0


def test_likeness_of_long_texts_edited_in_many_places():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(2000)]
    mark = lambda found: fingerprints.Prefixes.of(" ".join(found)).fingerprint()
    inserted = words[:40] + ["extra"] + words[40:1960] + ["other"] + words[1960:]
    assert fingerprints.likeness(mark(words), mark(inserted)) > 0.97
    for share, least in ((0.025, 0.6), (0.05, 0.4)):
        edited = list(words)
        for i in rng.sample(range(2000), int(2000 * share)):
            edited[i] = "zzzzz"
        assert fingerprints.likeness(mark(words), mark(edited)) > least
    moved = words[1000:] + words[:1000]
    assert fingerprints.likeness(mark(words), mark(moved)) > 0.97
    assert fingerprints.likeness(mark(words), mark(["".join(reversed(w)) for w in words])) < 0.05


# 7


def test_language_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)
    kept = language_id.drop_unidentified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()


def test_language_id_of_odd_rows(docs, rows, empty):
    got = by_id(language_id.language_id(docs))
    for i, text in rows:
        letters = any(c.isalpha() for c in text or "")
        assert (got[i].lang_pred == "und") == (not letters) and (letters or got[i].score == 0)
    assert language_id.language_id(empty).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.language_id(unlabelled).collect()} == {"und"}
    assert language_id.drop_unidentified(unlabelled).count() == len(rows)


def test_codewords():
    for n in (2, 4, 7, 12):
        code = language_id.codewords(n)
        apart = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert apart >= (1 if n == 2 else max(1, 2 ** (n - 2) if n <= 7 else 10))


# 8


def test_context_tree_scores(docs, rows, empty):
    counts, tokens = Counter(), {i: folded(t).split() + [b"\n"] for i, t in rows}
    for i, _ in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens[i])
    total = sum(counts.values())
    got = by_id(context_tree.context_tree_scores(docs, frequent=5))
    for i, own in tokens.items():
        base = sum(math.log10((counts[t] + 0.5) / (total + 0.5 * (len(counts) + 1))) for t in own)
        row = got[i]
        assert row.base_score == pytest.approx(base) and row.train_tokens == total
        assert (row.n_tokens, row.n_known) == (len(own), sum(counts[t] > 0 for t in own))
        assert row.held_out == (zlib.crc32(str(i).encode()) % 5 == 1) and row.score < 0
    assert context_tree.context_tree_scores(empty).count() == 0
    nothing = context_tree.context_tree_scores(docs.filter("doc_id = 3"), folds=1, held_out=0).first()
    assert nothing.n_known == 0 and nothing.score == pytest.approx(-math.log10(256) * (len(b" ".join(tokens[3][:-1])) + 1))


def test_tree_against_the_recursion():
    """Mixed tables against the definition, decision by decision, for a small tree that holds every context."""
    rng = random.Random(6)
    line = [10, 10] + [rng.choice(b"abc") for _ in range(400)]
    counts = defaultdict(lambda: np.zeros(256))
    for i in range(2, len(line)):
        for d in range(3):
            counts[tuple(line[i - d : i])][line[i]] += 1
    levels = []
    for d in range(3):
        found = sorted((sum(b << 8 * k for k, b in enumerate(reversed(c))), c) for c in counts if len(c) == d)
        levels.append(context_tree.Level(np.asarray([v for v, _ in found], np.int64), np.stack([counts[c] for _, c in found]).astype(np.float32)))
    tree = context_tree.ContextTree.mix(levels)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def split(context, prefix, bit):
        size = 128 >> bit
        begin = prefix << 8 - bit
        return counts[context][begin : begin + size].sum(), counts[context][begin + size : begin + 2 * size].sum()

    def weigh(context, prefix, bit):
        own = kt(*split(context, prefix, bit))
        if len(context) == 2:
            return own
        children = sum(weigh(c, prefix, bit) for c in counts if len(c) == len(context) + 1 and c[1:] == context)
        return np.logaddexp(own, children) - math.log(2)

    def predict(context, depth, prefix, bit):
        here = context[len(context) - depth :]
        a, b = split(here, prefix, bit)
        own = (b + 0.5) / (a + b + 1)
        if depth == 2:
            return own
        share = math.exp(kt(a, b) - math.log(2) - weigh(here, prefix, bit))
        return share * own + (1 - share) * predict(context, depth + 1, prefix, bit)

    asked = np.asarray([10, 10, *b"abcab"], np.uint8)
    got = tree.scores(asked)
    for i in range(2, len(asked)):
        want, prefix = 0.0, 0
        for bit in range(8):
            one = predict(tuple(asked[i - 2 : i].tolist()), 0, prefix, bit)
            chosen = int(asked[i]) >> 7 - bit & 1
            want += math.log10(one if chosen else 1 - one)
            prefix = prefix * 2 + chosen
        assert got[i - 2] == pytest.approx(want, abs=1e-3)
    every = np.concatenate([np.repeat(np.asarray([[97, 98]]), 256, 0), np.arange(256)[:, None]], 1).astype(np.uint8)
    assert sum(10 ** float(tree.scores(row)[0]) for row in every) == pytest.approx(1, abs=1e-4)


def test_tree_of_counts_beyond_single_precision(spark):
    """What the children leave is exactly 0 above 2**24, so all scores are finite and near the shares counted."""
    rng = np.random.default_rng(5)
    grown = rng.integers(1 << 24, 1 << 33, (40, 256)) * (rng.random((40, 256)) < 0.3)
    contexts = np.arange(40, dtype=np.int64) + 80
    met = [(int(c) << 8 | b, int(grown[i, b])) for i, c in enumerate(contexts) for b in np.flatnonzero(grown[i]).tolist()]
    stats = spark.createDataFrame([(context_tree.GRAM, code, n) for code, n in met], "kind short, code long, n long")
    logs = {r.code: r.log for r in context_tree.gram_logs(stats, 1).collect()}
    assert len(logs) == len(met) and np.isfinite(list(logs.values())).all()
    for code, n in met:
        assert 10 ** logs[code] == pytest.approx(n / grown[(code >> 8) - 80].sum(), abs=1e-3)
    levels = [context_tree.Level(np.zeros(1, np.int64), grown.sum(0, keepdims=True)), context_tree.Level(contexts, grown)]
    tree = context_tree.ContextTree.mix(levels)
    for code, _ in met:
        assert tree.logs[(1 + (code >> 8) - 80) * 256 + (code & 255)] == pytest.approx(logs[code], abs=1e-3)


@pytest.mark.parametrize("frequent_grams", [100, 1 << 20])
def test_every_context_is_a_node(spark, frequent_grams):
    """More than 12,000 contexts of one depth, against a tree that holds all of them; most grams are joined with the small table."""
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    body = {i: "".join(rng.choice(letters) for _ in range(500)) for i in range(60)}
    counts = [defaultdict(lambda: np.zeros(256, np.int64)) for _ in range(4)]
    for i, text in body.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            line = b"\n\n\n" + text.encode() + b"\n"
            for at in range(3, len(line)):
                for d in range(4):
                    counts[d][sum(line[at - 1 - k] << 8 * k for k in range(d))][line[at]] += 1
    assert len(counts[3]) > 12_000
    levels = [context_tree.Level(np.asarray(sorted(c), np.int64), np.stack([c[k] for k in sorted(c)])) for c in counts]
    tree = context_tree.ContextTree.mix(levels)
    docs = spark.createDataFrame(list(body.items()), "doc_id long, text string").repartition(3)
    size = {"frequent_grams": frequent_grams} if hasattr(context_tree, "FREQUENT_GRAMS") else {}
    got = {r.doc_id: r for r in context_tree.context_tree_scores(docs, depth=3, **size).collect()}
    assert any(r.held_out for r in got.values())
    for i, text in body.items():
        line = np.frombuffer(b"\n\n\n" + text.encode() + b"\n", np.uint8)
        assert got[i].score == pytest.approx(float(tree.scores(line).sum()), rel=1e-4)


# 9


def test_sharding(docs, rows, empty, tmp_path):
    found = sharding.write_shards(docs, str(tmp_path / "shards"), shards=4, bucket_bytes=4000)
    got = found.collect()
    assert len(got) == len(rows)
    for r, text in [(r, dict(rows)[r.doc_id]) for r in got]:
        raw = (text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw)) and r.grown_shard in (r.shard, 4)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.doc_id))
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in slots.values())
    assert any([i for _, i in sorted(v)] != sorted(i for _, i in v) for v in slots.values())
    again = sharding.write_shards(docs.repartition(2), str(tmp_path / "again"), shards=4, bucket_bytes=4000)
    key = lambda r: (r.doc_id, r.shard, r.slot)
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    records = docs.sparkSession.read.parquet(str(tmp_path / "shards")).select("record.*")
    assert records.columns == docs.columns and records.count() == len(rows)
    assert sharding.write_shards(empty, str(tmp_path / "none")).count() == 0


def test_jump_hash_moves_into_the_new_shard_only():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 20000).astype(np.uint64)
    for n in range(1, 9):
        before, after = sharding.jump_hash(keys, n), sharding.jump_hash(keys, n + 1)
        assert ((before == after) | (after == n)).all()
        assert abs((after == n).mean() - 1 / (n + 1)) < 0.02


def test_fisher_yates():
    seen = Counter(tuple(sharding.fisher_yates(3, np.random.default_rng(i))) for i in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 800


# 10


def test_line_dedup(docs, rows, empty):
    def key(line):
        return line.encode().strip(b" \t\n\x0b\x0c\r").lower()

    lines = {i: (t or "").split("\n") for i, t in rows}
    holders = Counter(k for found in lines.values() for k in {key(line) for line in found} if k)
    got = by_id(line_dedup.line_dedup(docs, min_docs=10))
    for i, found in lines.items():
        kept = [line for line in found if holders[key(line)] < 10]
        assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (len(found), len(found) - len(kept), "\n".join(kept))
    assert any(r.n_dropped for r in got.values())
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_bitmaps_of_many_lines(spark):
    many = "\n".join(f"line {i % 7}" if i % 3 else "gone" for i in range(1000))
    df = spark.createDataFrame([(i, many if i == 0 else "gone\nx") for i in range(3)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df, min_docs=3).collect()}
    assert got[0].kept_text == "\n".join(x for x in many.split("\n") if x != "gone") and got[0].n_dropped == 334
    assert got[1].kept_text == "x"


def test_line_dedup_that_keeps_the_first(spark):
    held = [(7, "x\nShared\nown 7\nshared"), (3, "own 3\n shared \nSHARED\ny"), (9, "shared"), (None, "other\ny"), (4, "y")]
    df = spark.createDataFrame(held, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(df, min_docs=3, keep="first").collect()}
    assert got == {7: (2, "x\nown 7"), 3: (2, "own 3\n shared "), 9: (1, ""), None: (0, "other\ny"), 4: (1, "")}
    with pytest.raises(ValueError):
        line_dedup.line_dedup(df, keep="last")


# the pipeline


def test_pipeline(spark, folder, tmp_path):
    import corpus_pipeline
    from tests.llm.plain_language import plain_kept

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "packing"]
    source = spark.read.parquet(f"{folder}/documents.parquet")
    rng = random.Random(6)
    greek = " ".join("".join(rng.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(rng.randrange(2, 9))) for _ in range(200))
    odd = [(10**6, greek, None, "x", len(greek)), (10**6 + 1, "0123 --", "en", "x", 7)]
    source = source.unionByName(spark.createDataFrame(odd, source.schema))
    docs = f"{tmp_path}/documents.parquet"
    source.write.parquet(docs)
    found = spark.read.parquet(docs).collect()
    spoken = plain_kept([(r.doc_id, r.text, r.lang) for r in found])
    assert 10**6 + 1 not in spoken and len(spoken) >= len(found) - 2
    rows = [(r.doc_id, r.text) for r in found if r.doc_id in spoken]
    copies = {}
    for i, text in sorted(rows):
        copies.setdefault(folded(text), (i, text))
    near = brute_components(sorted(copies.values()), 5, 80)
    want = {i for i, (_, c) in near.items() if c == i}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == want
    assert_packed(packed)
