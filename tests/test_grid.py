"""Many-to-many joins with heavy keys and learned orders of dates."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortlane import StudySpec
from cohortlane.functions.times import with_date_text
from cohortlane.operators import contingency, grid, timing

from tests.conftest import rows


def nested_join(left, right):
    held = defaultdict(list)
    for *key, value in right:
        held[tuple(key)].append(value)
    return Counter((*l, r) for l in left for r in held.get((l[1], l[2]), [None]))


def sides(seed, hub_left, hub_right):
    rng = random.Random(seed)
    left = [(i, rng.choice([None, "a", "b", f"s{rng.randrange(40)}"]), rng.choice([None, 1.0, float(rng.randrange(4))])) for i in range(300)]
    left += [(1000 + i, "hub", None) for i in range(hub_left)] + [(5000 + i, "only left", 0.5) for i in range(hub_left)]
    right = {(s, t, f"g{rng.randrange(6)}") for _, s, t in rng.sample(left, 250)} | {("right only", 1.0, "g0"), ("a", 1.0, None)}
    right = {r for r in right if r[0] != "only left"} | {("hub", None, f"h{i}") for i in range(hub_right)}
    return left, sorted(right, key=repr)


@pytest.mark.parametrize("hub_left, hub_right", [(200, 1), (150, 30), (3, 200), (0, 0)])
def test_grid_join(spark, hub_left, hub_right):
    left, right = sides(hub_left, hub_left, hub_right)
    a = spark.createDataFrame(left, "sample long, subject string, time double").repartition(3)
    b = spark.createDataFrame(right, "subject string, time double, `Group` string").repartition(2)
    found = grid.grid_join(a, b, ["subject", "time"], [F.col("sample")], [F.col("Group")])
    assert found.columns == ["sample", "subject", "time", "Group"]
    assert Counter(tuple(r) for r in found.collect()) == nested_join(left, right)


def test_no_task_holds_a_heavy_key(spark):
    """A third of the rows on one side are of one key that has many rows on the other side too."""
    left = spark.range(30_000).selectExpr("id as sample", "if(id % 3 = 0, 'hub', concat('s', id % 5000)) as subject", "1.0D as time")
    right = spark.range(4_000).selectExpr("if(id < 12, 'hub', concat('s', id)) as subject", "1.0D as time", "cast(id as string) as `Group`")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = grid.grid_join(left, right, ["subject", "time"], [F.col("sample")], [F.col("Group")])
        held = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        plain = left.join(right, ["subject", "time"], "left").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert sum(held) == sum(r["n"] for r in plain) > 130_000
    assert max(held) <= 2 * sum(held) / 16 < max(r["n"] for r in plain)


def test_grids_of_heavy_keys(spark):
    weights = spark.createDataFrame([("x", 1000, 10), ("y", 900, 0), ("z", 10, 1000), ("w", 5, 5)], "k string, n_left long, n_right long")
    found = {r.k: (r.down, r.across) for r in grid.heavy_grid(weights, 8).collect()}
    assert set(found) == {"x", "y", "z"} and found["y"][1] == 1 and found["y"][0] > 1
    assert found["x"][0] > found["x"][1] and found["z"][0] < found["z"][1]
    assert all(down * across > 1 for down, across in found.values())


def test_groups_of_cells(spark):
    long = spark.createDataFrame([("s1", "a", 1.0, "M", "own"), ("s2", "a", None, "M", "own"), ("s3", None, 1.0, "M", "own"), ("s4", "b", 2.0, "M", "own")],
                                 "sample_id string, subject string, time double, modality string, `Group` string")
    groups = spark.createDataFrame([("a", 1.0, "x"), ("a", 1.0, "y"), ("a", 1.0, "y"), ("a", None, "z"), (None, 1.0, None)], "subject string, time double, `Group` string")
    found = contingency.long_with_groups(long, groups)
    assert found.columns == ["sample_id", "subject", "time", "modality", "Group"]
    assert rows(found.select("sample_id", "Group")) == [("s1", "x"), ("s1", "y"), ("s2", "z"), ("s3", None), ("s4", None)]


def order_of(spark, texts):
    row = timing.time_column_facts(spark.createDataFrame([(t,) for t in texts], "t string"), "t").first()
    return row.date_order, row.n_mdy, row.n_dmy


def test_the_column_tells_the_order(spark):
    assert order_of(spark, ["03/04/2024", "05/06/2024", "25/04/2024"]) == ("dmy", 2, 3)
    assert order_of(spark, ["03/04/2024", "04/25/2024"]) == ("mdy", 2, 1)
    assert order_of(spark, ["03/04/2024", "1.2.24"]) == ("mdy", 2, 2)  # nothing tells: the month comes first
    assert order_of(spark, ["Jan 5 2024", "25 Dec 2023", "2024-13-05", "10:30", "40/50/2024", None, ""]) == ("mdy", 0, 0)
    assert order_of(spark, ["25042024", "04052024"]) == ("dmy", 1, 2)


def test_dates_with_the_day_first(spark):
    texts = {"03/04/2024": "2024-04-03", "4/25/2024": "2024-04-25", "25.4.24": "2024-04-25", "Jan 5 2024": "2024-01-05", "2024-02-03": "2024-02-03",
             "31/04/2024": None, "1/2/2024 10:30": "2024-01-02", "05042024": "2024-04-05"}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {r.t: r.m for r in with_date_text(df, F.col("t"), "m", "dmy").selectExpr("t", "left(cast(m as string), 10) as m").collect()}
    assert found == texts


def test_learned_orders_reach_the_times(spark):
    df = spark.createDataFrame([("s1", "a", "01/02/2024"), ("s2", "a", "05/02/2024"), ("s3", "a", "25/02/2024")], "sample string, id string, visit string")
    spec = StudySpec("sample", "id", "visit", ())
    assert rows(timing.days_since_start(df, spec).select("time")) == [(0.0,), (24.0,), (4.0,)]
    assert timing.settle_time_kind(df, spec).date_order == "dmy"
    fixed = timing.settle_time_kind(df, StudySpec("sample", "id", "visit", (), time_kind="date"))
    assert fixed.date_order == "mdy"
    with pytest.raises(ValueError, match="date_order"):
        StudySpec("sample", "id", "visit", (), date_order="ydm")
