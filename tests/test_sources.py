import pytest

from cohortlane import StudySpec
from cohortlane.operators.constraints import KeyViolation
from cohortlane.sources import datasets, delimited
from cohortlane.streaming import ingest, running

from tests.conftest import rows


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)
    return str(folder)


def test_reads_by_extension(spark, tmp_path):
    put(tmp_path / "f", a__csv="id,n\nx,1\ny,NA\n", b__TSV="id\tn\nx\t1\n")
    assert rows(delimited.read_delimited(spark, str(tmp_path / "f" / "a.csv"))) == [("x", 1), ("y", None)]
    assert delimited.read_delimited(spark, str(tmp_path / "f" / "b.TSV")).columns == ["id", "n"]
    assert delimited.read_delimited(spark, str(tmp_path / "f" / "a.csv"), schema="id string, n double").dtypes[1] == ("n", "double")
    with pytest.raises(ValueError, match="unsupported file type: rds"):
        delimited.read_delimited(spark, "x.rds")


def test_text_files_of_several_delimiters(spark, tmp_path):
    folder = put(tmp_path / "t", a__txt="id,n\nx,1\n", b__txt="id\tn\ny\t2\n", c__txt="id;n\nz;3\n", d__txt="n id\n4 w\n")
    sniffed = {r["path"][-5:]: r["delimiter"] for r in delimited.sniff_delimiters(spark, folder).collect()}
    assert sniffed == {"a.txt": ",", "b.txt": "\t", "c.txt": ";", "d.txt": " "}
    simple = {r["path"][-5:]: r["delimiter"] for r in delimited.sniff_delimiters(spark, folder, simple=True).collect()}
    assert simple == {"a.txt": ",", "b.txt": "\t", "c.txt": "", "d.txt": ""}
    assert rows(delimited.read_delimited(spark, folder, "txt").select("id", "n")) == [("w", 4), ("x", 1), ("y", 2), ("z", 3)]


def test_first_line_of_files_in_many_splits(spark, tmp_path):
    big = "\n".join(["head"] + [f"line {i}" for i in range(20000)])
    folder = put(tmp_path / "s", a__txt=big, b__txt="only")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert {r["line"] for r in delimited.first_lines(spark, folder).collect()} == {"head", "only"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_previews(spark, tmp_path):
    folder = put(tmp_path / "p", a__csv="a,b,c\n" + "1,2,3\n" * 9)
    assert [tuple(r) for r in delimited.safe_preview(spark, f"{folder}/a.csv", 2, 2).collect()] == [(1, 2)] * 2
    assert delimited.safe_preview(spark, f"{folder}/none.csv").columns == ["error"]
    assert delimited.safe_preview(spark, f"{folder}/a.rds").first()["error"] == "unsupported file type: rds"


def test_name_files(spark, tmp_path):
    folder = put(tmp_path / "n", a__txt="OmicsType\n Microbiome\t\nProteomics\n\n", b__csv="OmicsType\nRNA\n x \n", c__csv="a,b\n,c\n")
    assert rows(delimited.read_names(spark, f"{folder}/a.txt", skip_header=True)) == [("Microbiome",), ("Proteomics",)]
    assert delimited.read_names(spark, f"{folder}/a.txt").count() == 3
    assert rows(delimited.read_names(spark, f"{folder}/b.csv", skip_header=True)) == [("RNA",), ("x",)]
    assert rows(delimited.read_names(spark, f"{folder}/c.csv")) == [("a",), ("b",), ("c",)]


def test_matrices_of_different_features(spark, tmp_path):
    folder = put(
        tmp_path / "m",
        rna__csv='SampleID,Gene2,Gene1\ns1,1.5,2\ns2,"3,5",NA\n',
        prot__csv='"sid",P1\nq1,-10\n01,7\n',
    )
    long = datasets.read_matrices(spark, folder)
    assert rows(long.select("dataset", "sample_id", "feature", "value")) == rows(spark.createDataFrame([
        ("rna", "s1", "Gene2", 1.5), ("rna", "s1", "Gene1", 2.0), ("rna", "s2", "Gene2", None), ("rna", "s2", "Gene1", None),
        ("prot", "q1", "P1", -10.0), ("prot", "01", "P1", 7.0),
    ], "d string, s string, f string, v double"))
    texts = {(r["sample_id"], r["feature"]): r["value_text"] for r in long.collect()}
    assert texts["s2", "Gene2"] == "3,5" and texts["s2", "Gene1"] is None
    named = datasets.read_matrices(spark, f"{folder}/rna.csv", sample_column="SampleID")
    assert named.count() == 4
    wide = datasets.matrix_rows(spark, folder)
    assert datasets.matrix_key_violations(wide).count() == 0
    assert rows(datasets.matrix_key_violations(wide.union(wide.filter("sample_id = 'q1'")))) == [("prot", "q1")]


def test_matrix_ids_and_headers_stay_as_written(spark, tmp_path):
    folder = put(tmp_path / "ids", a__csv='"Sample, ID",f 1,"o\'f"\n007,TRUE,1.50\n7,2,\n1.50,x,3\n')
    long = {(r["sample_id"], r["feature"]): (r["value"], r["value_text"]) for r in datasets.read_matrices(spark, folder, check=True).collect()}
    assert long == {
        ("007", "f 1"): (None, "TRUE"), ("007", "o'f"): (1.5, "1.50"), ("7", "f 1"): (2.0, "2"), ("7", "o'f"): (None, None),
        ("1.50", "f 1"): (None, "x"), ("1.50", "o'f"): (3.0, "3"),
    }
    put(tmp_path / "ids", b__csv="id,f\n1,2\n1,3\n")
    with pytest.raises(KeyViolation):
        datasets.read_matrices(spark, folder, check=True)


def test_matrix_keys_are_checked_unless_told_not_to(spark, tmp_path):
    twice = put(tmp_path / "twice", rna__csv="id,f\n1,2\n1,3\n", prot__csv="id,g\n1,2\n")
    nulls = put(tmp_path / "nulls", rna__csv="id,f\n1,2\nNA,3\n")
    for folder in (twice, nulls):
        with pytest.raises(KeyViolation):
            datasets.read_matrices(spark, folder)
        with pytest.raises(KeyViolation):
            datasets.ingest_matrices(spark, folder, str(tmp_path / "kept"))
    assert datasets.read_matrices(spark, twice, check=False).count() == 3 and not (tmp_path / "kept").exists()
    right = put(tmp_path / "right", rna__csv="id,f\n1,2\n", prot__csv="id,g\n1,5\n")
    stored = datasets.load_dataset(spark, datasets.ingest_matrices(spark, right, str(tmp_path / "kept")))
    assert rows(stored.select("dataset", "sample_id", "feature", "value")) == [("prot", "1", "g", 5.0), ("rna", "1", "f", 2.0)]


def test_wide_and_array_features(spark):
    df = spark.createDataFrame([("s", 1, 2.5, [1.0, 2.0])], "id string, a int, b double, v array<float>")
    assert rows(datasets.unpivot_features(df, "id", ["a", "b"], "d")) == [("d", "s", "a", 1.0), ("d", "s", "b", 2.5)]
    assert rows(datasets.array_features(df, "id", "v", "d")) == [("d", "s", "f0", 1.0), ("d", "s", "f1", 2.0)]


def test_store_and_load(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    path = datasets.save_dataset(df, str(tmp_path), "metadata", "my table", "k")
    assert path.endswith("/metadata_my.table") and rows(datasets.load_dataset(spark, [path, "other"])) == rows(df)
    with pytest.raises(KeyViolation):
        datasets.save_dataset(df.union(df), str(tmp_path), "metadata", "twice", "k")
    datasets.export_csv(df, str(tmp_path / "out"))
    assert rows(delimited.read_delimited(spark, str(tmp_path / "out"), "csv")) == rows(df)
    long = datasets.unpivot_features(df, "k", ["v"], "one")
    stored = datasets.load_dataset(spark, datasets.save_matrices(long, str(tmp_path)))
    assert rows(stored.filter("dataset = 'one'").select("sample_id", "value")) == [("a", 1.0), ("b", 2.0)]


def test_new_files(spark):
    arrivals = spark.createDataFrame([("a", "2/a"), ("a", "1/a"), ("b", "b"), ("c", "c")], "name string, path string")
    registry = spark.createDataFrame([("b",), ("b",)], "name string")
    assert rows(datasets.new_files_only(arrivals, registry)) == [("a", "1/a"), ("c", "c")]
    files = spark.createDataFrame([("x.CSV",), ("y.rds",), ("z.txt",)], "path string")
    assert datasets.supported_files(files).count() == 2


SAMPLES = "sample string, id string, week int, Mic string"


def test_streamed_files_are_appended_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    target, rejected, marks = (str(tmp_path / n) for n in ("target", "rejected", "marks"))
    head = "sample,id,week,Mic\n"

    def run():
        stream = ingest.sample_file_stream(spark, f"{inbox}/*", SAMPLES)
        ingest.append_new_files(stream, "sample", target, rejected, marks).awaitTermination()
        return sorted(r["sample"] for r in spark.read.parquet(target).collect())

    inbox.mkdir()
    put(inbox / "d1", one__csv=head + "s1,a,0,Yes\ns2,a,1,No\ns2,a,2,No\n,b,0,Yes\n")
    assert run() == ["s1"]
    put(inbox / "d2", two__csv=head + "s1,a,0,Yes\ns3,b,0,Yes\n")
    put(inbox / "d3", one__csv=head + "s9,z,0,Yes\n")
    assert run() == ["s1", "s3"]
    refused = spark.read.parquet(rejected)
    assert sorted(str(r["sample"]) for r in refused.collect()) == ["None", "s1", "s2", "s2"]


def test_running_ranges(spark, tmp_path):
    inbox = tmp_path / "inbox"
    target, marks = str(tmp_path / "updates"), str(tmp_path / "marks")
    spec = StudySpec("sample", "id", "week", ("Mic",), time_kind="numeric")

    def run():
        stream = spark.readStream.schema(SAMPLES).option("header", True).csv(str(inbox))
        running.write_updates(running.running_ranges(stream, spec), target, marks).awaitTermination()
        return rows(running.latest(spark.read.parquet(target)))

    put(inbox, a__csv="sample,id,week,Mic\ns1,a,3,Yes\ns2,a,1,No\ns3,b,2,Yes\n")
    assert run() == [("a", "Mic", 1, 3.0, 3.0), ("b", "Mic", 1, 2.0, 2.0)]
    put(inbox, b__csv="sample,id,week,Mic\ns4,a,9,Yes\n")
    assert run() == [("a", "Mic", 2, 3.0, 9.0), ("b", "Mic", 1, 2.0, 2.0)]


def test_streams_need_a_time_kind(spark):
    with pytest.raises(ValueError):
        running.running_ranges(spark.createDataFrame([], SAMPLES), StudySpec("sample", "id", "week", ("Mic",)))


def test_a_fresh_checkpoint_appends(spark, tmp_path):
    """What is stored decides which files and keys are new, whatever the checkpoint says."""
    inbox, target, rejected = tmp_path / "inbox", str(tmp_path / "target"), str(tmp_path / "rejected")
    head = "k.id,v\n"

    def run(marks):
        stream = ingest.sample_file_stream(spark, f"{inbox}/*", "`k.id` string, v string")
        ingest.append_new_files(stream, "k.id", target, rejected, str(tmp_path / marks)).awaitTermination()
        return sorted((r[0], r[1]) for r in spark.read.parquet(target).select("`k.id`", "v").collect())

    inbox.mkdir()
    put(inbox / "d1", one__csv=head + "1,a\n2,b\n")
    assert run("first") == [("1", "a"), ("2", "b")]
    put(inbox / "d2", two__csv=head + "2,zz\n3,c\n")
    assert run("second") == [("1", "a"), ("2", "b"), ("3", "c")]  # the first file's name is taken
    assert run("first") == [("1", "a"), ("2", "b"), ("3", "c")]
    assert [tuple(r) for r in spark.read.parquet(rejected).select("`k.id`", "v").collect()] == [("2", "zz")]


def test_mixed_types_by_delimiter(spark, tmp_path):
    folder = put(tmp_path / "x", a__txt="k,v,n\n01,1,1\n", b__txt="k;v;n\nb;word;2.5\n")
    df = delimited.read_delimited(spark, folder, "txt")
    assert dict(df.dtypes) == {"k": "string", "v": "string", "n": "double"}
    assert rows(df.select("k", "v", "n")) == [("01", "1", 1.0), ("b", "word", 2.5)]
