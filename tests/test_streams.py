"""Key index, snapshots and studies of cleaned names."""

import pytest
from pyspark.sql import functions as F

from cohortlane import StudySpec
from cohortlane.functions.names import resolved, with_clean_names
from cohortlane.operators import binning
from cohortlane.plans.study import Study
from cohortlane.session import drop_written, shared_folder, table_folder, written
from cohortlane.streaming import ingest, running
from cohortlane.streaming.keys import BITMAP, KeyIndex

from tests.conftest import rows
from tests.test_sources import put


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_known_keys(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "index"))
    assert not index.exists() and index.known(keys(spark, ["a"]), "r", 0).count() == 0
    index.add(keys(spark, ["a", "b", "a", None, ""]), "r", 0)
    index.add(keys(spark, ["c"]), "r", 1)
    index.add(keys(spark, []), "r", 2)
    asked = keys(spark, ["a", "c", "x", "", None, "a"])
    assert rows(index.known(asked, "s", 0)) == [("",), ("a",), ("c",)]
    assert rows(index.known(asked, "r", 0)) == [("c",)]  # a batch that runs again does not see itself
    index.add(keys(spark, ["d"]), "r", 0)  # and replaces what it wrote
    assert rows(index.known(keys(spark, ["a", "d"]), "s", 0)) == [("d",)]


def test_untouched_buckets_are_not_read(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "index"))
    stored = spark.range(20_000).selectExpr("concat('k', id) as k")
    index.add(stored, "r", 0)
    asked = keys(spark, ["k17", "k19999", "new"])
    suspects = index.suspects(asked, "r", 1)
    folders = index.opened(suspects)
    assert 2 <= len(folders) <= 3 and all("batch=0/bucket=" in f for f in folders)
    assert rows(index.known(asked, "r", 1)) == [("k17",), ("k19999",)]
    # Strange keys open few buckets: the filters rule out nearly all of them.
    strange = spark.range(2_000).selectExpr("concat('x', id) as k")
    assert index.suspects(strange, "r", 1).count() < 100
    # What is not opened is not read: the other buckets may even be broken.
    kept = {f.rsplit("=", 1)[1] for f in folders}
    for path in (tmp_path / "index" / "keys" / "run=r" / "batch=0").glob("bucket=*"):
        if path.name.split("=")[1] not in kept:
            for file in path.glob("part-*.parquet"):
                file.write_bytes(b"broken")
    spark.catalog.clearCache()
    assert rows(index.known(asked, "r", 1)) == [("k17",), ("k19999",)]


def test_no_stored_key_is_ruled_out(spark, tmp_path, monkeypatch):
    """Filters of several bitmaps: every stored key is a suspect."""
    from cohortlane.streaming import keys as module

    monkeypatch.setattr(module, "BUCKETS", 2)
    index = KeyIndex(spark, str(tmp_path / "index"))
    stored = spark.range(9_000).selectExpr("id as k")
    index.add(stored, "r", 0)
    filters = spark.read.parquet(index.filters)
    assert filters.agg(F.max("bitmaps")).first()[0] == -(-4500 * 16 // BITMAP) or filters.agg(F.max("bitmap")).first()[0] >= 1
    assert index.known(stored, "r", 1).count() == 9_000
    assert index.known(spark.range(9_000, 9_500).selectExpr("id as k"), "r", 1).count() == 0


def test_a_target_without_an_index_gets_one(spark, tmp_path):
    inbox, target, rejected = tmp_path / "inbox", str(tmp_path / "target"), str(tmp_path / "rejected")
    spark.createDataFrame([("1", "old", "f0.csv")], "k string, v string, file_name string").write.parquet(f"{target}/run=x/batch=0")
    inbox.mkdir()
    put(inbox / "d1", one__csv="k,v\n1,a\n2,b\n")
    stream = ingest.sample_file_stream(spark, f"{inbox}/*", "k string, v string")
    ingest.append_new_files(stream, "k", target, rejected, str(tmp_path / "marks")).awaitTermination()
    assert rows(spark.read.parquet(target).select("k", "v")) == [("1", "old"), ("2", "b")]
    assert rows(spark.read.parquet(rejected).select("k", "v")) == [("1", "a")]


def test_snapshots(spark, tmp_path):
    inbox, target, marks = tmp_path / "inbox", str(tmp_path / "snapshots"), str(tmp_path / "marks")
    spec = StudySpec("sample", "id", "week", ("Mic",), time_kind="numeric")
    schema = "sample string, id string, week int, Mic string"

    def run():
        stream = spark.readStream.schema(schema).option("header", True).option("nullValue", "NA").csv(str(inbox))
        running.write_snapshots(running.running_ranges(stream, spec), target, marks, parts=8).awaitTermination()
        return rows(running.read_snapshot(spark, target))

    assert running.read_snapshot(spark, target).count() == 0
    head = "sample,id,week,Mic\n"
    put(inbox, a__csv=head + "s1,a,3,Yes\ns2,a,1,No\ns3,b,2,Yes\ns0,NA,5,Yes\n")
    assert run() == [(None, "Mic", 1, 5.0, 5.0), ("a", "Mic", 1, 3.0, 3.0), ("b", "Mic", 1, 2.0, 2.0)]
    first = running.snapshot_parts(spark, target)
    put(inbox, b__csv=head + "s4,a,9,Yes\n")
    assert run() == [(None, "Mic", 1, 5.0, 5.0), ("a", "Mic", 2, 3.0, 9.0), ("b", "Mic", 1, 2.0, 2.0)]
    second = running.snapshot_parts(spark, target)
    moved = [p for p in second if second[p] != first.get(p)]
    assert len(moved) == 1 and set(second) == set(first)  # one subject, one part written anew
    put(inbox, c__csv=head + "s5,c,0,Yes\ns6,NA,4,Yes\n")
    assert run() == [(None, "Mic", 2, 4.0, 5.0), ("a", "Mic", 2, 3.0, 9.0), ("b", "Mic", 1, 2.0, 2.0), ("c", "Mic", 1, 0.0, 0.0)]
    newest = running.read_snapshot(spark, target)
    assert len({f.rsplit("/", 1)[0].rsplit("=", 1)[1] for f in newest.inputFiles()}) == len({f.rsplit("/", 1)[0] for f in newest.inputFiles()})  # every part once
    versions = sorted(r.batch for r in spark.read.parquet(f"{target}/versions").select("batch").distinct().collect())
    assert rows(running.read_snapshot(spark, target, versions[0])) == [(None, "Mic", 1, 5.0, 5.0), ("a", "Mic", 1, 3.0, 3.0), ("b", "Mic", 1, 2.0, 2.0)]


def test_names_resolve_by_their_cleaned_form(spark):
    columns = ["Sample ID", "ret-N", "ret.N", "2x"]
    assert [resolved(columns, n) for n in ("Sample ID", "Sample.ID", "Sample_ID", "ret.N", "ret N", "X2x", "none")] == [
        "Sample ID", "Sample ID", "Sample ID", "ret.N", "ret-N", "2x", None,
    ]
    df = spark.createDataFrame([("s1", "a", 1, "Yes", "g h"), ("s2", "b", 2, "No", "i")], "`Sample ID` string, `Subject ID` string, `Time point` int, `Mic robiome` string, `the group` string")
    for table in (df, with_clean_names(df)):
        study = Study(table, StudySpec("Sample ID", "Subject.ID", "Time_point", ("Mic.robiome", "Other")))
        assert rows(study.contingency("the.group")) == [("Total", 1, 1), ("g h", 1, 1)]
        assert study.subject_order("the group").count() == 2 and study.long("the_group").count() == 1
    with pytest.raises(ValueError, match="no such column"):
        study.contingency("absent")


def test_a_study_needs_its_columns(spark):
    one = spark.createDataFrame([("a",)], "id string")
    with pytest.raises(ValueError, match="at least a subject and a time"):
        StudySpec("id", "id", "id", ()).on(one)
    with pytest.raises(ValueError, match="role columns"):
        StudySpec("id", "who", "when", ()).on(spark.createDataFrame([("a", 1)], "id string, n int"))


def test_approximate_cuts_keep_the_number_of_values(spark):
    few = spark.range(600).selectExpr("cast(id % 15 as double) as x")
    many = spark.range(600).selectExpr("cast(id % 16 as double) as x")
    assert not binning.quartile_cuts(few, "x", approximate=True).usable()
    assert binning.quartile_cuts(many, "x", approximate=True).usable()


def test_written_tables_can_be_dropped(spark):
    kept = written(spark.range(3).toDF("n"), "kept")
    assert kept.count() == 3 and table_folder(spark).startswith(shared_folder(spark))
    path = kept.inputFiles()[0]
    assert spark.sparkContext.getCheckpointDir() is None or shared_folder(spark) != ""
    drop_written(spark)
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
