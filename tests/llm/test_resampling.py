"""Importance resampling against a plain count of whole texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from cohortlane.llm import resampling
from cohortlane.llm.queries import ORACLE

SCHEMA = "doc_id long, text string, row string, key int, weight string, rank int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def features(text, longest):
    words = WORD.findall(fold(text))
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def brute(rows, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text, longest)[0]))
    for text in target:
        t.update(map(bucket, features(text, longest)[0]))
    S, T = sum(s.values()), sum(t.values())
    found = []
    for key, text in rows:
        fs, words = features(text, longest)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, fs))
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        found.append([key, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= least])
    able = sorted((f for f in found if f[4]), key=lambda f: (-f[3], f[0] is None, f[0] or 0))
    drawn = {id(f): n for n, f in enumerate(able[: percent * len(able) // 100], 1)}
    return sorted([(*f[:4], drawn.get(id(f))) for f in found], key=repr)


def given():
    rng = random.Random(4)
    words = ["alpha", "Beta", "gamma", "straße", "été", "a", "b", "don't", "42", "x_y", "ÄÖ", "漢字", "end.", "--"]
    rows = [(i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 14))) for _ in range(rng.randrange(1, 8)))) for i in range(90)]
    shared = "one line that very many documents hold"
    rows += [(200 + i, f"{shared}\n{shared.upper()}\n\nown {i}\n" + "word " * (i % 30)) for i in range(45)]
    rows += [(300, " ".join(rng.choice(words) for _ in range(9000))), (301, None), (302, ""), (303, "\n\n\n"), (304, "!!! ..."), (305, "\x00a\x7fb\r\nc")]
    return rows


@pytest.fixture(scope="module")
def rows():
    found = given()
    return found + [(7, "another text under a key that is taken " * 3), (None, "no key " * 12), (None, None)] + found[10:13]


def frames(spark, rows, target):
    docs = spark.createDataFrame([(i, t, "r", 1, "w", 2) for i, t in rows], SCHEMA).repartition(4)
    return docs, spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 500, 50), (2, 70, 100)])
def test_importance_resample(spark, rows, longest, buckets, percent):
    target = ["alpha beta\ngamma own 3", None, "", "漢字 one line that very many", "straße " * 40]
    docs, wanted = frames(spark, rows, target)
    found = resampling.importance_resample(docs, wanted, longest=longest, buckets=buckets, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got, want = [tuple(r) for r in found.collect()], brute(rows, target, longest, buckets, percent=percent)
    assert sorted((g[:4] for g in got), key=repr) == sorted((w[:4] for w in want), key=repr)
    # Repeated rows take their ranks in any order.
    assert sorted((g[4] is None, g[4] or 0, g[3]) for g in got) == sorted((w[4] is None, w[4] or 0, w[3]) for w in want)


def test_small_and_empty_tables(spark, rows):
    docs, wanted = frames(spark, rows[:30], ["alpha"])
    assert resampling.importance_resample(docs.limit(0), wanted).collect() == []
    for target in ([], [None, ""]):
        nothing = spark.createDataFrame([(t,) for t in target], "text string")
        found = resampling.importance_resample(docs, nothing)
        assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows[:30], target)
    few, _ = frames(spark, rows[:5], [])
    assert {r.rank for r in resampling.importance_resample(few, wanted, least_words=10_000).collect()} == {None}


def test_runs_across_lines():
    lines = [b"a b".split(), [], b"c".split(), b"d e".split()]
    assert resampling.runs_across(lines, 1) == []
    assert resampling.runs_across(lines, 3) == [b"b c", b"c d", b"a b c", b"b c d", b"c d e"]
    whole = [word for line in lines for word in line]
    parts = [run for line in lines for run in resampling.runs_within(line, 3)] + resampling.runs_across(lines, 3)
    assert sorted(parts) == sorted(resampling.runs_within(whole, 3))


def test_one_line_in_all_documents(spark):
    """A third of all lines is one line; the join cuts it into slices and every row finds it."""
    rows = [(i, f"the common line\nown words {i} and more {i % 7}\n" + "filler " * 20) for i in range(400)]
    docs, wanted = frames(spark, rows, ["common words"])
    found = resampling.importance_resample(docs, wanted)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == brute(rows, ["common words"])


def test_sql_is_given():
    assert "op13_importance_resampling" in ORACLE and "op11_centroid_clusters" in ORACLE
