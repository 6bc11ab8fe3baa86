import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from cohortlane import StudySpec
from cohortlane.operators import aggregates, attach, binning, contingency, covariates, ranking, reshape, search, timing
from cohortlane.operators.constraints import KeyViolation, check_key, key_violations
from cohortlane.plans.overlap import Overlap
from cohortlane.plans.study import Study
from cohortlane.plans.timeline import Timeline, ranges_with_points

from tests.conftest import rows

SPEC = StudySpec("sample", "id", "week", ("Mic", "Pro"))
SCHEMA = "sample string, id string, week int, grp string, Mic string, Pro string"
SAMPLES = [
    ("a0", "a", 0, "X", "Yes", "No"),
    ("a2", "a", 2, "X", "yes", "1"),
    ("a4", "a", 4, "X", "no", None),
    ("b1", "b", 1, "Y", "No", "true"),
    ("b5", "b", 5, "Y", "No", "TRUE"),
    ("c3", "c", 3, None, "Yes", "No"),
    ("d1", "d", 1, "Y", "No", "No"),
]


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame(SAMPLES, SCHEMA)


def test_spec_from_positions(samples):
    assert StudySpec.from_positions(samples, ["Mic", "Other", "Pro"]) == SPEC
    assert SPEC.candidate_covariates(samples) == ["grp"]


def test_spec_needs_roles(spark, samples):
    with pytest.raises(ValueError):
        StudySpec.from_positions(samples.select("sample", "id"), ["Mic"])
    with pytest.raises(ValueError):
        StudySpec("sample", "nobody", "week", ()).on(samples)


def test_spec_finds_names_by_their_clean_form(spark):
    df = spark.createDataFrame([("s", "i", 0, "Yes")], "sample string, id string, week int, `RNA seq` string")
    spec = StudySpec("sample", "id", "week", ("RNA.seq",)).on(df)
    assert spec.modalities == ("RNA seq",)
    assert rows(reshape.long_availability(df, spec)) == [("s", "i", "0", 0.0, "RNA seq", "Yes")]


def test_long(samples):
    assert rows(reshape.long_availability(samples, SPEC, ["grp"])) == sorted([
        ("a0", "a", "0", 0.0, "X", "Mic", "Yes"), ("a2", "a", "2", 2.0, "X", "Mic", "yes"), ("a2", "a", "2", 2.0, "X", "Pro", "1"),
        ("b1", "b", "1", 1.0, "Y", "Pro", "true"), ("b5", "b", "5", 5.0, "Y", "Pro", "TRUE"), ("c3", "c", "3", 3.0, None, "Mic", "Yes"),
    ])


def test_no_modality_or_no_flag_keeps_the_schema(samples):
    none = StudySpec("sample", "id", "week", ("Other",))
    full = reshape.long_availability(samples, SPEC)
    empty = reshape.long_availability(samples, none)
    assert empty.dtypes == full.dtypes and empty.count() == 0
    off = samples.withColumns({"Mic": F.lit("No"), "Pro": F.lit("No")})
    assert reshape.long_availability(off, SPEC).count() == 0
    assert aggregates.modality_ranges(off, SPEC).count() == 0
    assert aggregates.timepoint_stats_text(off, SPEC).columns == ["Omics_Name", "Min_Samples_Per_Individual", "Max_Samples_Per_Individual"]
    assert aggregates.modality_ranges(samples, none).count() == 0
    assert contingency.contingency(off, SPEC, "grp").count() == 0


def test_counts_and_ranges(samples):
    assert rows(aggregates.modality_ranges(samples, SPEC)) == [
        ("a", "Mic", 0.0, 2.0), ("a", "Pro", 2.0, 2.0), ("b", "Pro", 1.0, 5.0), ("c", "Mic", 3.0, 3.0)
    ]
    assert rows(aggregates.timepoint_stats(samples, SPEC)) == [("Mic", 1, 2, 1, 1, 2), ("Pro", 1, 2, 1, 1, 2)]
    assert rows(aggregates.timepoint_stats_text(samples, SPEC))[0] == ("Mic", "1 (1 | 50.0%)", "2 (1 | 50.0%)")
    assert rows(aggregates.cohort_sizes(samples, SPEC)) == [(3, 4)]
    assert rows(aggregates.points_per_subject(samples, SPEC)) == [("a", 3), ("b", 2), ("c", 1)]


def test_range_without_times_is_null(spark):
    df = spark.createDataFrame([("s1", "a", None, "Yes", "No"), ("s2", "a", "x", "Yes", "No")], "sample string, id string, week string, Mic string, Pro string")
    assert rows(aggregates.modality_ranges(df, SPEC)) == [("a", "Mic", None, None)]


def facts(spark, values):
    return tuple(timing.time_kind_facts(spark.createDataFrame([(v,) for v in values], "t string"), "t").first())


def test_time_kind(spark):
    assert facts(spark, ["1", "2.5", None]) == (True, 0.0, "numeric")
    assert facts(spark, [None, None]) == (True, 0.0, "numeric")
    assert facts(spark, ["2024-01-05", "x"]) == (False, 0.5, "numeric")
    assert facts(spark, ["2024-01-05", "1/2/24", "x"])[1:] == (pytest.approx(2 / 3), "date")
    assert facts(spark, ["2024-01-05", "x", None])[2] == "numeric"


def test_days_since_start(spark):
    schema = "sample string, id string, week string"
    df = spark.createDataFrame(
        [("1", "a", "1/5/2024 12:00"), ("2", "a", "2024-01-07"), ("3", "a", "junk"), ("4", "b", "13/02/2024"), ("5", "c", None)], schema
    )
    days = {r["sample_id"]: r["time"] for r in timing.days_since_start(df, SPEC).collect()}
    assert days == {"1": 0.0, "2": 1.5, "3": None, "4": 0.0, "5": None}


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_typed_dates_count_from_the_start(spark, kind):
    df = spark.createDataFrame([("1", "a", date(2024, 3, 1)), ("2", "a", date(2024, 3, 31))], "sample string, id string, week date")
    df = df.withColumn("week", F.col("week").cast(kind))
    assert sorted(r["time"] for r in timing.days_since_start(df, SPEC).collect()) == [0.0, 30.0]


def test_start_counts_samples_without_data(spark):
    df = spark.createDataFrame(
        [("1", "a", date(2024, 3, 1), "No"), ("2", "a", date(2024, 3, 4), "Yes")], "sample string, id string, week date, Mic string"
    )
    assert rows(aggregates.modality_ranges(df, SPEC)) == [("a", "Mic", 3.0, 3.0)]
    assert [r["time"] for r in reshape.long_availability(df, SPEC).collect()] == [3.0]


def test_contingency(samples):
    assert rows(contingency.contingency(samples, SPEC, "grp")) == [
        (None, 1, 0, 1), ("Total", 2, 2, 3), ("X", 1, 1, 1), ("Y", 0, 1, 1)
    ]


def test_contingency_leaves_out_a_modality_without_data(samples):
    only = samples.withColumn("Pro", F.lit("No"))
    assert contingency.contingency(only, SPEC, "grp").columns == ["Group", "Mic", "Total_Subjects_with_Omics"]


def test_contingency_shares_groups_met_at_one_time(spark):
    df = spark.createDataFrame([
        ("1", "a", 0, "X", "Yes", "No"), ("2", "a", 0, "Y", "No", "Yes"), ("3", "a", 1, "Z", "Yes", "No"), ("4", "b", 0, "X", "Yes", "No"),
    ], SCHEMA)
    assert rows(contingency.contingency(df, SPEC, "grp")) == [("Total", 4, 2, 4), ("X", 2, 1, 2), ("Y", 1, 1, 1), ("Z", 1, 0, 1)]


def test_contingency_against_the_join(spark):
    rng = random.Random(5)
    data = [
        (str(i), f"s{rng.randrange(12)}", rng.choice([0, 1, 2, None]), rng.choice(["X", "Y", "Z", None]), rng.choice(["Yes", "No"]), rng.choice(["Yes", "No"]))
        for i in range(120)
    ]
    df = spark.createDataFrame(data, SCHEMA)
    long = reshape.long_availability(df, SPEC, ["grp"])
    joined = contingency.long_with_groups(long.drop("grp"), long.withColumnRenamed("grp", "Group"))
    pairs = {(r["subject"], r["Group"], r["modality"]) for r in joined.collect()}
    table = {r["Group"]: tuple(r)[1:] for r in contingency.contingency(df, SPEC, "grp").collect()}
    for group in ("X", "Y", "Z", None):
        mine = {(s, m) for s, g, m in pairs if g == group}
        assert table[group] == (
            len({s for s, m in mine if m == "Mic"}), len({s for s, m in mine if m == "Pro"}), len({s for s, _ in mine})
        )
    assert table["Total"] == tuple(sum(table[g][i] for g in ("X", "Y", "Z", None)) for i in range(3))


def test_contingency_with_missing(spark):
    df = spark.createDataFrame([
        ("1", "a", 0, "X", "Yes", "No"), ("2", "a", 1, "Y", "true", "yes"), ("3", "b", 0, None, "YES", "TRUE"), ("4", "c", 0, "W", "No", "No"),
        ("5", "d", 0, "X", "No", "No"),
    ], SCHEMA)
    want = [("Missing", 0, 1, 1), ("X", 1, 0, 2), ("Y", 0, 1, 1)]
    assert rows(contingency.contingency_with_missing(df, SPEC, "grp")) == sorted(want + [("Total", 1, 2, 4)])
    assert rows(contingency.contingency_by_joins(df, SPEC, "grp")) == want


def test_right_group_wins_in_a_collision(spark):
    long = spark.createDataFrame([("a", 0.0, "Mic", "old"), (None, None, "Pro", "old")], "subject string, time double, modality string, Group string")
    right = spark.createDataFrame([("a", 0.0, "new"), (None, None, "none")], "subject string, time double, Group string")
    got = contingency.long_with_groups(long, right)
    assert got.columns == ["subject", "time", "modality", "Group"] and {r["Group"] for r in got.collect()} == {"new", "none"}


def test_eligible_covariates(spark):
    df = spark.createDataFrame([
        ("1", "a", 0, "Yes", "u", 1.0, "k", float("nan")), ("2", "a", 1, "No", None, 2.0, "k", 3.0), ("3", "b", 0, "No", "v", 1.0, "k", 4.0),
    ], "sample string, id string, week int, Mic string, const string, varies double, single string, withnan double")
    assert [r["covariate"] for r in covariates.eligible_covariates(df, SPEC).orderBy("position").collect()] == ["None", "const", "withnan"]


def test_first_value(spark):
    df = spark.createDataFrame([
        ("s2", "a", 1, "late"), ("s1", "a", 0, None), ("s9", "b", 0, "second"), ("s8", "b", 0, "first"), ("s0", "c", 0, None),
    ], "sample string, id string, week int, grp string")
    assert rows(covariates.first_value(df, SPEC, "grp")) == [("a", "late"), ("b", "first"), ("c", None)]


def test_group_sizes(spark):
    df = spark.createDataFrame([
        ("1", "a", 0, "X", "p"), ("2", "a", 1, "none", "p"), ("3", "b", 0, "", "q"), ("4", "c", 0, "X", None), ("5", "c", 1, "X", "q"),
    ], "sample string, id string, week int, grp string, sec string")
    assert rows(covariates.group_sizes(df, SPEC, "grp")) == [("None", 2), ("X", 2)]
    assert rows(covariates.local_counts(df, SPEC, "grp", "sec")) == [("None", "p", 1), ("None", "q", 1), ("X", "p", 1), ("X", "q", 1)]
    assert [r["subject"] for r in ranking.subject_order_primary(df, SPEC, "grp").orderBy("subject_rank").collect()] == ["a", "b", "c"]


def brute_order(data, with_secondary):
    pairs = {(i, p) for i, p, _ in data}
    second = {i: s for i, _, s in data}
    size = lambda p: len({i for i, q in pairs if q == p})
    local = lambda p, s: len({i for i, q in pairs if q == p and second[i] == s})
    key = lambda r: (-size(r[1]), r[1], -local(r[1], second[r[0]]), second[r[0]], r[0]) if with_secondary else (-size(r[1]), r[1], r[0])
    seen = []
    for i, _ in sorted(pairs, key=key):
        if i not in seen:
            seen.append(i)
    return seen


@pytest.mark.parametrize("partitions", ["2", "7"])
@pytest.mark.parametrize("with_secondary", [False, True])
def test_subject_order_against_brute_force(spark, partitions, with_secondary):
    rng = random.Random(3)
    second = {}
    data = []
    for n in range(400):
        i = f"id{rng.randrange(150)}"
        second.setdefault(i, rng.choice("pqr"))
        data.append((i, "A" if rng.random() < 0.6 else rng.choice("BCD"), second[i]))
    df = spark.createDataFrame([(str(n), i, n, p, s) for n, (i, p, s) in enumerate(data)], "sample string, id string, week int, grp string, sec string")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        order = ranking.subject_order_primary_secondary(df, SPEC, "grp", "sec") if with_secondary else ranking.subject_order_primary(df, SPEC, "grp")
        got = order.orderBy("subject_rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert [r["subject_rank"] for r in got] == list(range(1, len(got) + 1))
    assert [r["subject"] for r in got] == brute_order(data, with_secondary)


def test_rank_by_points(samples):
    assert rows(ranking.subject_order_by_points(samples, SPEC)) == [("a", 3, 1), ("b", 2, 2), ("c", 1, 3)]


def test_dense_order_is_a_permutation_whatever_the_partitions(spark):
    df = spark.range(5000).select(F.concat(F.lit("n"), F.col("id")).alias("name"), (F.col("id") % 2).alias("half"))
    got = ranking.dense_order(df.repartition(9), [F.col("half"), F.col("name")], "rank").orderBy("rank").collect()
    assert [(r["half"], r["name"]) for r in got] == sorted((n % 2, f"n{n}") for n in range(5000))
    assert [r["rank"] for r in got] == list(range(1, 5001))


@pytest.mark.parametrize("partitions, threshold", [("3", "10m"), ("16", "10m"), ("16", "-1")])
def test_attach_cuts_heavy_keys(spark, partitions, threshold):
    kept, broadcast = (spark.conf.get(f"spark.sql.{c}") for c in ("shuffle.partitions", "autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        many = spark.range(3000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id")).cast("string").alias("k"), "id")
        facts = many.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")).filter("k <> '2500'")
        joined = attach.attach(many, facts, ["k"], "n", [F.col("id")])
        got = {(r["k"], r["id"], r["top"]) for r in joined.collect()}
        assert joined.count() == 3000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert got == {("0", i, 1999) if i < 2000 else (str(i), i, None if i == 2500 else i) for i in range(3000)}


def quartiles(values):
    ordered = sorted(values)
    cuts = []
    for p in (0, 0.25, 0.5, 0.75, 1):
        spot = p * (len(ordered) - 1)
        low, part = int(spot), spot - int(spot)
        high = min(low + 1, len(ordered) - 1)
        cuts.append((1 - part) * ordered[low] + part * ordered[high])
    return cuts


@pytest.mark.parametrize("seed", range(3))
def test_quartile_cuts(spark, seed):
    rng = random.Random(seed)
    values = [round(rng.gauss(50, 20), rng.choice([0, 2])) for _ in range(rng.randrange(40, 400))]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    found = binning.quartile_cuts(df, "x")
    assert found.n_distinct == len(set(values))
    assert list(found.cuts) == pytest.approx(sorted(set(quartiles(values))))
    assert binning.quartile_cuts(df, "x", approximate=True).cuts[0] == min(values)


def binned(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return [(r["x"], r["x_bin"], r["x_quartile"]) for r in binning.quartile_bins(df, "x").collect()]


def test_quartile_bins(spark):
    got = {x: (n, label) for x, n, label in binned(spark, [float(v) for v in range(17)] + [None])}
    assert got[0.0] == (1, "[0,4)") and got[4.0] == (2, "[4,8)") and got[16.0] == (4, "[12,16]") and got[None] == (None, None)


def test_few_values_stay_raw(spark):
    assert binned(spark, [float(v) for v in range(15)])[14] == (14.0, None, "14")
    assert binned(spark, [float(v) for v in range(16)])[15][1] == 4


def test_ties_without_three_cuts_stay_raw(spark):
    values = [1.0] * 500 + [float(v) for v in range(2, 20)]
    assert binned(spark, values)[0] == (1.0, None, "1")


def test_labels_get_more_digits_when_needed():
    assert binning.QuartileCuts(99, (10000.1, 10000.4, 10000.9)).labels == ("[10000.1,10000.4)", "[10000.4,10000.9]")
    assert binning.QuartileCuts(99, (1.0, 2.5, 1000.0)).labels == ("[1,2.5)", "[2.5,1000]")
    assert binning.QuartileCuts(0, ()).usable() is False


def test_scale_kinds(spark):
    def kind(values):
        df = spark.createDataFrame([(v,) for v in values], "g string")
        return {r["scale_kind"] for r in binning.covariate_levels(df, "g").collect()}

    assert kind([str(n) for n in range(16)]) == {"continuous"}
    assert kind([str(n) for n in range(15)]) == {"sequential"}
    assert kind([f"g{n}" for n in range(12)]) == {"qualitative"}
    assert kind([f"g{n}" for n in range(13)] + [None]) == {"sequential"}


def test_timeline(samples):
    line = Timeline(samples, SPEC, primary="grp")
    assert [(r["subject"], r["color_group"], r["subject_rank"]) for r in line.axis_labels().orderBy("subject_rank").collect()] == [
        ("b", "Y", 1), ("d", "Y", 2), ("c", None, 3), ("a", "X", 4)
    ]
    place = line.geometry.first()
    assert (place["modality"], place["min_time"], place["time_range"], place["strip_x"]) == ("Mic", 0.0, 3.0, -1.0)
    assert place["anchor_x"] == pytest.approx(-1.7)
    tips = {(r["sample_id"], r["modality"]): r["tooltip"] for r in line.points().collect()}
    assert tips["a0", "Mic"] == "a <br> week : 0 <br> Omics Type: Mic <br> grp : X"
    assert tips["c3", "Mic"].endswith("grp : NA")
    assert rows(line.segments().select("subject", "modality")) == rows(ranges_with_points(line.ranges(), line.points()).select("subject", "modality"))
    assert line.strip().count() == 4 and line.anchors().count() == 3
    assert line.anchored().count() == 9 and line.anchored().filter("available = 'Anchor'").count() == 3
    assert line.facet("Pro").count() == 3 and line.facet("Mic", anchors=True).count() == 6
    assert rows(line.modality_levels()) == [("Mic", 1), ("Pro", 2)]


def test_timeline_without_groups(samples):
    line = Timeline(samples, SPEC)
    assert rows(line.strip().select("subject", "color_group", "subject_rank")) == [("a", "None", 1), ("b", "None", 2), ("c", "None", 3)]
    assert {r["point_group"] for r in line.points().collect()} == {"None"}


def test_timeline_with_secondary_only(samples):
    line = Timeline(samples, SPEC, secondary="grp")
    assert [r["subject"] for r in line.axis_labels().orderBy("subject_rank").collect()] == ["b", "d", "c", "a"]


@pytest.mark.parametrize("kind", ["boolean", "int", "double"])
def test_charts_with_typed_flags(spark, kind):
    df = spark.createDataFrame([("1", "a", 0, 1, 0), ("2", "a", 1, 0, 0), ("3", "b", 1, 1, 1)], "sample string, id string, week int, Mic int, Pro int")
    df = df.withColumns({m: F.col(m).cast(kind) for m in SPEC.modalities})
    want = [("1", "Mic"), ("3", "Mic"), ("3", "Pro")]
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        assert rows(Timeline(df, SPEC).points().select("sample_id", "modality")) == want
        assert rows(Overlap(df, SPEC).points().select("sample_id", "modality")) == want
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")


def test_modalities_may_be_called_like_other_columns(spark):
    df = spark.createDataFrame([("1", "a", 2, "Yes", "No"), ("2", "a", 3, "Yes", "Yes")], "s string, i string, t int, time string, subject string")
    spec = StudySpec("s", "i", "t", ("time", "subject"))
    want = [("1", "time"), ("2", "subject"), ("2", "time")]
    assert rows(reshape.long_availability(df, spec).select("sample_id", "modality")) == want
    assert rows(Timeline(df, spec).points().select("sample_id", "modality")) == want
    assert rows(Overlap(df, spec).points().select("sample_id", "modality")) == want
    assert rows(aggregates.samples_per_subject(df, spec)) == [("subject", "a", 1), ("time", "a", 2)]


def test_unknown_time_makes_the_strip_unknown(spark):
    df = spark.createDataFrame([("1", "a", None, "Yes"), ("2", "a", 1, "Yes")], "sample string, id string, week int, Mic string")
    place = Timeline(df, SPEC).geometry.first()
    assert place["strip_x"] is None and place["anchor_x"] is None


def test_overlap(samples):
    over = Overlap(samples, SPEC)
    assert rows(over.lanes) == [("Mic", 1, -0.3), ("Pro", 2, 0.3)]
    assert {(r["sample_id"], r["modality"]): r["y_offset"] for r in over.points().collect()}["b1", "Pro"] == pytest.approx(2.3)
    tip = {(r["subject"], r["modality"]): r["tooltip"] for r in over.segments().collect()}["b", "Pro"]
    assert tip == "Subject ID: b \n Omics Type: Pro \n Time Range: 1 to 5"
    assert rows(over.limits()) == [(0.0, 5.0, 0.5, -0.5, 5.5)]


def test_one_lane(samples):
    assert rows(Overlap(samples, StudySpec("sample", "id", "week", ("Pro",))).lanes) == [("Pro", 1, -0.3)]


def test_lane_offsets_are_even(spark):
    names = ("m1", "m2", "m3", "m4")
    df = spark.createDataFrame([("1", "a", 0, 0, 1, 1, 0), ("2", "a", 1, 1, 0, 0, 0)], "sample string, id string, week int, m1 int, m2 int, m3 int, m4 int")
    lanes = aggregates.modality_lanes(df, StudySpec("sample", "id", "week", names)).orderBy("lane").collect()
    assert [(r["modality"], round(r["lane_offset"], 6)) for r in lanes] == [("m2", -0.3), ("m3", 0.0), ("m1", 0.3)]


def test_wide_cells(spark):
    df = spark.createDataFrame([("1", "a", 0, "X", "Yes", "No"), ("2", "a", 1, "X", "1", "No"), ("3", "a", 2, None, "No", "Yes")], SCHEMA)
    wide = reshape.availability_wide(df, SPEC, "grp")
    assert {r["group"]: (r["Mic"], r["Pro"]) for r in wide.collect()} == {"X": (["1", "Yes"], []), None: ([], ["Yes"])}
    assert rows(reshape.wide_to_indicators(wide, SPEC.modalities)) == [("a", None, 0, 1), ("a", "X", 1, 0)]


def test_keys(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, v int")
    assert rows(key_violations(df, "k")) == [(None, 1), ("a", 2)]
    with pytest.raises(KeyViolation, match="^Sample ID column"):
        check_key(df, "k")
    with pytest.raises(KeyViolation, match="^Omics data"):
        check_key(df, "k", "omics")
    assert check_key(df.filter("k = 'b'"), "k").count() == 1


def test_search_preview_profile(samples):
    assert [r["sample"] for r in search.table_search(samples, "X yes").orderBy("sample").collect()] == ["a0", "a2"]
    assert search.table_search(samples, "").count() == 7
    assert [tuple(r) for r in search.preview(samples, ["sample"], 2, 2).collect()] == [("a0", "a"), ("a2", "a")]
    assert tuple(search.dataset_profile(samples).first()) == (7, 6)


def test_study(samples):
    study = Study(samples, SPEC).check()
    assert study.long().count() == 6 and study.samples_per_subject().count() == 4
    assert rows(study.sizes()) == [(3, 4)] and study.times().count() == 7
    assert [r["covariate"] for r in study.covariates().collect()] == ["None", "grp"]
    assert study.subject_order("grp").count() == 4 and study.subject_order(secondary="grp").count() == 4
    assert study.subject_order("grp", "grp").count() == 4 and study.subject_order().count() == 3
    assert study.contingency("grp").count() == 4 and study.timepoint_stats().count() == 2
    with pytest.raises(KeyViolation):
        Study(samples.union(samples), SPEC).check()
    with pytest.raises(KeyViolation, match="Subject ID"):
        Study(samples.withColumn("id", F.when(F.col("sample") != "a0", F.col("id"))), SPEC).check()


@pytest.mark.parametrize("share", [0.34, 0.9])
def test_a_subject_with_most_samples(spark, share):
    n = 2000
    df = spark.range(n).select(
        F.col("id").cast("string").alias("sample"),
        F.when(F.col("id") < share * n, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("id"),
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 30).cast("int")).alias("week"),
        F.lit("X").alias("grp"), (F.col("id") % 2).alias("Mic"), (F.col("id") % 3 == 0).alias("Pro"),
    )
    long = reshape.long_availability(df, SPEC)
    assert long.count() == n // 2 + len(range(0, n, 3))
    ranges = {(r["subject"], r["modality"]): (r["min_pts"], r["max_pts"]) for r in aggregates.modality_ranges(df, SPEC).collect()}
    by_hand = long.groupBy("subject", "modality").agg(F.min("time"), F.max("time")).collect()
    assert ranges == {(r[0], r[1]): (r[2], r[3]) for r in by_hand}
    assert Timeline(df, SPEC, "grp", "grp").points().count() == long.count()


def test_null_subjects_are_one_subject(spark):
    """Null subjects get times, ranks and shared groups like any other subject."""
    df = spark.createDataFrame(
        [("s1", None, 1, "A", "Yes"), ("s2", None, 1, "B", "Yes"), ("s3", "x", 2, "A", "Yes"), ("s4", None, 4, "A", "No")],
        "sample string, id string, week int, grp string, Mic string",
    ).withColumn("week", F.expr("date '2024-01-01' + week"))
    spec = StudySpec("sample", "id", "week", ("Mic",))
    times = {r["sample_id"]: r["time"] for r in timing.days_since_start(df, spec).collect()}
    assert times == {"s1": 0.0, "s2": 0.0, "s3": 0.0, "s4": 3.0}
    counts = {r["Group"]: r["Mic"] for r in contingency.contingency(df, spec, "grp").collect()}
    assert counts == {"A": 2, "B": 1, "Total": 3}
    line = Timeline(df, spec, "grp")
    assert {r["sample_id"]: r["subject_rank"] is None for r in line.points().collect()} == {"s1": False, "s2": False, "s3": False}
    assert line.axis_labels().count() == 2 and line.segments().count() == 2


def test_columns_with_the_names_of_helpers(spark):
    df = spark.createDataFrame(
        [("s1", "x", "2024-01-01", "y", "z", "w", "Yes"), ("s2", "x", "2024-01-03", "y", "z", "w", "Yes")],
        "sample string, id string, week string, _year string, _time string, _slice string, Mic string",
    )
    long = reshape.long_availability(df, StudySpec("sample", "id", "week", ("Mic",)), ["_year", "_time", "_slice"])
    assert sorted((r["sample_id"], r["time"], r["_year"], r["_time"], r["_slice"]) for r in long.collect()) == [
        ("s1", 0.0, "y", "z", "w"), ("s2", 2.0, "y", "z", "w")
    ]
