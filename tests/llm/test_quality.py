"""The quality discriminant against a plain one, and its accuracy on held-out documents."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cohortlane.llm import quality

SCHEMA = "doc_id long, text string, lang string, score string, features int, label int"


def texts(n=160):
    rng = random.Random(8)
    words = "lorem ipsum Dolor sit amet, straße été 42 and more. Then again; what now?".split()
    junk = "BUY!! NOW!! $$$ ### XXX!! 99999 &&&".split()
    good = [" ".join(rng.choice(words) for _ in range(rng.randrange(30, 200))) + "\nlast line." for _ in range(n)]
    bad = [" ".join(rng.choice(junk) for _ in range(rng.randrange(10, 90))) for _ in range(n // 3)]
    odd = [None, "", " ", "\n\n", "a", "😀", "word " * 30_000]
    return [(t, 1) for t in good] + [(t, 0) for t in bad] + [(t, None) for t in odd]


@pytest.fixture(scope="module")
def given():
    rows = [(i, t, q) for i, (t, q) in enumerate(texts())]
    rows += rows[5:9] + [(11, "another text under a key that is taken", 1)]
    return rows + [(None, "no key here", 1), (None, None, 0)]


def labels_of(spark, given):
    known = [(i, q) for i, _, q in given if q is not None][:190] + [(3, 0), (4, None), (5, 7), (99_999, 1)]
    return known, spark.createDataFrame([(i, q, "x", 2.0) for i, q in known], "doc_id long, quality int, text string, features double")


def docs_of(spark, given):
    return spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t, _ in given], SCHEMA).repartition(4)


def plain_scores(given, known, shrink):
    """The discriminant from its definition, in loops."""
    found = {}
    taught = {0: [], 1: []}
    weights = Counter((i, q) for i, q in known if i is not None and q in (0, 1) and zlib.crc32(str(i).encode()) % 4 != 2)
    make = quality.Statistics().of
    vectors = [np.asarray(make(t)) for _, t, _ in given]
    for (i, _, _), x in zip(given, vectors):
        for q in (0, 1):
            taught[q] += [x] * weights[i, q]
    whole = np.stack(taught[0] + taught[1])
    centre, scale = whole.mean(axis=0), np.sqrt(np.maximum(whole.var(axis=0), quality.LEAST))
    logs = {}
    for q in (0, 1):
        placed = (np.stack(taught[q]) - centre) / scale
        d, n = placed.shape[1], len(placed)
        share = max(shrink, d / (n + d))
        covariance = np.cov(placed.T, bias=True)
        covariance = (1 - share) * covariance + share * np.trace(covariance) / d * np.eye(d)
        inverse, (_, logdet) = np.linalg.inv(covariance), np.linalg.slogdet(covariance)
        for k, x in enumerate(vectors):
            z = (x - centre) / scale - placed.mean(axis=0)
            logs[q, k] = math.log(n / len(whole)) - logdet / 2 - z @ inverse @ z / 2
    for k, (i, t, _) in enumerate(given):
        found[i, t] = 1 / (1 + math.exp(min(700, max(-700, logs[0, k] - logs[1, k]))))
    return found


def test_quality_against_the_definition(spark, given):
    known, labels = labels_of(spark, given)
    docs = docs_of(spark, given)
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(given)
    wanted = plain_scores(given, known, quality.SHRINK)
    by_text = {}
    for (i, t), score in wanted.items():
        by_text.setdefault(i, []).append(score)
    for row in rows:
        assert row.held_out == (row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 4 == 2)
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.7)
        assert min(abs(row.score - s) for s in by_text[row.doc_id]) < 1e-6
    assert list(quality.quality_scores(docs, labels).columns) == ["doc_id", "held_out", "score", "predicted"]


def test_without_labels_of_both_kinds(spark, given):
    docs = docs_of(spark, given).limit(6)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (1, 1), (3, 1)], "doc_id long, quality int")
    learned = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (0, 1, 3))
    scores = {r.score for r in quality.quality_scores(docs_of(spark, given), one).collect()}
    assert scores == {(learned + 0.5) / (learned + 1)}
    assert quality.quality_scores(docs.limit(0), one).collect() == []


def test_constant_statistics(spark):
    """All texts of a label alike: the covariance has no spread of its own."""
    rows = [(i, "same words here" if i % 2 else "$$$ $$$") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    found = {r.doc_id: r.predicted for r in quality.quality_scores(docs, labels).collect()}
    assert found == {i: i % 2 for i in range(40)}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    told = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = {q: [r.predicted == q for r in told if r.quality == q] for q in (0, 1)}
    assert np.mean(right[0]) >= 0.9 and np.mean(right[1]) >= 0.97
