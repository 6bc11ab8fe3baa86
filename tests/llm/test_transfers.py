"""What goes to the Python workers of the pipeline's stages, and which workers there are."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlane.llm import jaccard_join, language_id, packing


def below_python(df):
    """The optimized plan's line below its only Arrow function."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = [i for i, line in enumerate(lines) if "MapInArrow" in line]
    assert len(at) == 1
    return lines[at[0] + 1]


@pytest.mark.parametrize("name", ["text", "the words"])
def test_the_language_stage_sends_a_text_once(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("body", F.lit("x")).withColumnRenamed("text", name)
    kept = language_id.drop_unidentified(docs, text=name)
    assert len(re.findall(r"\btext#\d+", below_python(kept))) == 1
    assert kept.columns == docs.columns
    found, all_rows = Counter(map(tuple, kept.collect())), Counter(map(tuple, docs.collect()))
    assert 0 < sum(found.values()) and not found - all_rows


def test_the_language_stage_keeps_texts_of_another_type(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.col("text").cast("binary").alias("text"), "lang")
    kept = language_id.drop_unidentified(docs)
    assert kept.dtypes == docs.dtypes
    plain = language_id.drop_unidentified(docs.withColumn("text", F.col("text").cast("string")))
    assert Counter(bytes(r.text) for r in kept.collect()) == Counter(r.text.encode() for r in plain.collect())


@pytest.mark.parametrize("plan", [[], [(5, 0, 2, 7, 0), (6, 0, 1, 7, 1)]])
def test_plans_of_packing_need_no_python_workers(spark, plan):
    ranked = spark.range(3).select(F.lit(5).cast("long").alias("length"), F.col("id").alias("rank"))
    joined = packing.placed(ranked, "length", plan, "__first long, __slot int")
    assert "ExistingRDD" not in joined._jdf.queryExecution().executedPlan().toString()
    assert dict(joined.dtypes)["__first"] == "bigint" and dict(joined.dtypes)["__slot"] == "int"
    assert sorted((r["rank"], r["__first"], r["__slot"]) for r in joined.collect()) == ([(0, 7, 0), (1, 7, 0)] if plan else [])


def test_sketch_links_fold_in_the_worker_that_finds_them(spark, monkeypatch):
    seen, real = [], jaccard_join.connected
    monkeypatch.setattr(jaccard_join, "connected", lambda edges, fold=True: seen.append((edges, fold)) or real(edges, fold))
    rng = np.random.default_rng(4)
    base = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(3)]
    sets = [(10 * k + c, 7, 300, bytearray(np.sort(np.concatenate([b[c:], b[:c] + np.uint64(1)])).tobytes())) for k, b in enumerate(base) for c in range(4)]
    sets.append((99, 7, 300, bytearray(np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)).tobytes())))
    df = spark.createDataFrame(sets, "id long, component long, n long, shingles binary").repartition(3)
    found = {r.id: r.component for r in jaccard_join.sketched_groups(df, 80).collect()}
    assert found == {10 * k + c: 10 * k for k in range(3) for c in range(4)}
    ((edges, fold),) = seen
    assert not fold and edges._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
