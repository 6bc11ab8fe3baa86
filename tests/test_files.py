"""Heads of files, folders of mixed layouts, matrices with odd headers and stored blocks."""

import pytest

from cohortlane.operators.constraints import KeyViolation
from cohortlane.sources import datasets, delimited, heads

from tests.conftest import rows
from tests.test_sources import put


def test_heads_of_files(spark, tmp_path):
    folder = put(tmp_path / "h", a__txt="one\r\ntwo\nthree\n", b__txt="only", c__txt="", d__txt="\n\nx\n")
    found = {(r.path[-5:], r.line_no): r.line for r in heads.file_heads(spark, folder, 2).collect()}
    assert found == {("a.txt", 1): "one", ("a.txt", 2): "two", ("b.txt", 1): "only", ("d.txt", 1): "", ("d.txt", 2): ""}
    nested = put(tmp_path / "h" / "k=1", e__txt="deep\nx\n")
    assert [r.line for r in heads.file_heads(spark, [nested], 1).collect()] == ["deep"]


def test_bytes_read_do_not_grow_with_the_file(spark, tmp_path):
    """What the JVM reads is counted by its file systems, what a task reads here by its process."""
    line = "a,b,c,d,e and more\n"

    def in_jvm():
        return sum(s.getBytesRead() for s in spark._jvm.org.apache.hadoop.fs.FileSystem.getAllStatistics())

    def here():
        return int(open("/proc/self/io").read().split()[1])

    jvm, own = {}, {}
    for name, times in (("small", 20_000), ("large", 1_500_000)):
        folder = put(tmp_path / name, a__txt=line * times, b__txt=line * times)
        before = in_jvm()
        assert {r.delimiter for r in delimited.sniff_delimiters(spark, folder).collect()} == {","}
        assert delimited.safe_preview(spark, f"{folder}/a.txt", 3).count() == 3
        jvm[name] = in_jvm() - before
        before = here()
        assert heads.first_lines_of(f"file:{folder}/a.txt", 3) == [line.strip()] * 3
        own[name] = here() - before
    assert jvm["large"] < 200_000 and abs(jvm["large"] - jvm["small"]) < 20_000
    assert own["large"] < 4 * heads.PORTION and own["small"] < 4 * heads.PORTION


def test_a_scan_gives_the_same_heads(spark, tmp_path, monkeypatch):
    import gzip

    folder = put(tmp_path / "h", a__txt="\ufeffone\r\ntwo\rthree\n", b__txt="only", c__txt="", d__txt="\n\nx\n", e__txt="é" * 50_000 + "\ny\n", **{"f g__txt": "x\r"})
    (tmp_path / "h" / "z.txt.gz").write_bytes(gzip.compress(b"packed\nlines\n"))

    def told():
        return sorted((r.path.rsplit("/", 1)[1].replace("%20", " "), r.line_no, r.line) for r in heads.file_heads(spark, folder, 2).collect())

    found = told()
    assert ("z.txt.gz", 1, "packed") in found and ("a.txt", 1, "one") in found and ("f g.txt", 1, "x") in found and len(found) == 10
    monkeypatch.setattr(heads, "reachable", lambda path: False)
    assert told() == found


def test_lines_that_end_between_portions(tmp_path, monkeypatch):
    monkeypatch.setattr(heads, "PORTION", 3)
    for text, want in (("ab\r\ncd", ["ab", "cd"]), ("ab\r", ["ab"]), ("abc\ndef\ng", ["abc", "def"]), ("\r\n\r\n\r\n", ["", ""]), ("ab\r\r", ["ab", ""]), ("", [])):
        (tmp_path / "x").write_bytes(text.encode())
        assert heads.first_lines_of(str(tmp_path / "x"), 2) == want


def test_folder_previews(spark, tmp_path):
    folder = put(tmp_path / "p", a__txt='id,n\nx,"1,5"\ny,NA\nz,3\n', b__txt="id;m;k\nw;2;\n", c__txt="head only\n")
    found = {(r.path[-5:], r.row_no): (r.names, r.cells) for r in delimited.folder_previews(spark, folder, 2).collect()}
    assert found == {
        ("a.txt", 1): (["id", "n"], ["x", "1,5"]),
        ("a.txt", 2): (["id", "n"], ["y", None]),
        ("b.txt", 1): (["id", "m", "k"], ["w", "2", None]),
    }


def test_folders_of_mixed_layouts(spark, tmp_path):
    folder = put(
        tmp_path / "m",
        a__txt="id,n,day\nx,1,2024-01-05\n",
        b__txt="day;n;id\n2024-01-06;2.5;y\n",
        c__txt="n,id,extra\n3000000000,z,true\n",
        d__txt="id\tn\tday\nw\tNA\tNA\n",
        e__txt="",
    )
    df = delimited.read_delimited(spark, folder, "txt")
    assert dict(df.dtypes) == {"id": "string", "n": "double", "day": "date", "extra": "boolean"}
    assert rows(df.selectExpr("id", "n", "cast(day as string)", "extra")) == [
        ("w", None, None, None), ("x", 1.0, "2024-01-05", None), ("y", 2.5, "2024-01-06", None), ("z", 3e9, None, True),
    ]
    known = delimited.read_delimited(spark, folder, "txt", "n double, id string, more int")
    assert known.columns == ["n", "id", "more"]
    assert rows(known) == [(None, "w", None), (1.0, "x", None), (2.5, "y", None), (3e9, "z", None)]
    csv = put(tmp_path / "c", a__csv="a,b\n1,2\n", b__csv="b,a\n3,4\n")
    assert rows(delimited.read_delimited(spark, csv, "csv").select("a", "b")) == [(1, 2), (4, 3)]
    assert rows(delimited.read_delimited(spark, csv, "csv", "a int, b int")) == [(1, 2), (4, 3)]


def test_the_simple_rule_of_delimiters(spark, tmp_path):
    folder = put(tmp_path / "r", a__txt="a,b\tc\n1,2\t3\n", b__txt="a b\n1 2\n", c__txt="a;b,c\nx;1,2\n")
    found = {k.header: k.separator for k in delimited.layouts(spark, folder, simple=True)}
    assert found == {"a,b\tc": "\t", "a b": " ", "a;b,c": ","}
    one = delimited.read_delimited(spark, f"{folder}/c.txt", simple=True)
    assert one.columns == ["a;b", "c"] and rows(one) == [("x;1", 2)]


def test_types_that_go_together():
    from pyspark.sql import types as T

    kinds = [T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.BooleanType(), T.StringType()]
    for a in kinds:
        for b in kinds:
            assert delimited.wider(a, b) == delimited.wider(b, a)
            for c in kinds:
                assert delimited.wider(delimited.wider(a, b), c) == delimited.wider(a, delimited.wider(b, c))
    assert delimited.wider(T.IntegerType(), T.LongType()) == T.LongType()
    assert delimited.wider(T.DateType(), T.TimestampType()) == T.TimestampType()


def test_matrix_headers_keep_their_places(spark, tmp_path):
    folder = put(tmp_path / "m", a__csv=",f1,f2\nA,1,2\n,f1,f2\n", b__csv='"id",f1,NA,,"f, 3"\nB,1,2,3,4\nC,5,,7\n\n')
    long = datasets.read_matrices(spark, folder, check=False)
    found = {(r.dataset, r.sample_id, r.feature): r.value_text for r in long.collect()}
    assert found == {
        ("a", "A", "f1"): "1", ("a", "A", "f2"): "2", ("a", None, "f1"): "f1", ("a", None, "f2"): "f2",  # a row like the header is a row
        ("b", "B", "f1"): "1", ("b", "B", "NA"): "2", ("b", "B", "V4"): "3", ("b", "B", "f, 3"): "4",
        ("b", "C", "f1"): "5", ("b", "C", "NA"): None, ("b", "C", "V4"): "7", ("b", "C", "f, 3"): None,
    }
    named = datasets.read_matrices(spark, f"{folder}/b.csv", sample_column="V4")
    assert {r.sample_id for r in named.collect()} == {"3", "7"} and {r.feature for r in named.collect()} == {"id", "f1", "NA", "f, 3"}


@pytest.mark.parametrize("header", ["id,f1,f2,f1", "id,,V2"])
def test_repeated_features_are_refused(spark, tmp_path, header):
    folder = put(tmp_path / "r", a__csv="id,g\n1,2\n", b__csv=header + "\n" + ",".join("1" * (header.count(",") + 1)) + "\n")
    with pytest.raises(KeyViolation, match="stand twice"):
        datasets.read_matrices(spark, folder)


def test_many_headers_and_no_files(spark, tmp_path):
    folder = put(tmp_path / "n", **{f"d{i}__csv": f"id,g{i % 4},h\ns{i},{i},x\n" for i in range(12)})
    long = datasets.read_matrices(spark, folder)
    assert rows(long.filter("feature <> 'h'").select("dataset", "feature", "value")) == sorted((f"d{i}", f"g{i % 4}", float(i)) for i in range(12))
    empty = put(tmp_path / "e", a__csv="")
    assert datasets.read_matrices(spark, empty).count() == 0


def test_one_feature_reads_one_block(spark, tmp_path):
    wide = spark.createDataFrame([(f"s{i}", [float(i + j) for j in range(200)]) for i in range(30)], "k string, v array<double>")
    long = datasets.array_features(wide, "k", "v", "one").unionByName(datasets.array_features(wide.limit(3), "k", "v", "two"))
    path = datasets.save_matrices(long, str(tmp_path))
    assert rows(spark.read.parquet(path).select(*long.columns)) == rows(long)
    one = datasets.load_feature(spark, path, "f17", "one")
    assert rows(one.select("sample_id", "value")) == sorted((f"s{i}", float(i + 17)) for i in range(30))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and plan.count("block") >= 1
    opened, stored = ({f.rsplit("/", 1)[0] for f in df.inputFiles()} for df in (one, spark.read.parquet(path)))
    assert len(stored) > 60 and rows(datasets.load_feature(spark, path, "f17").select("dataset").distinct()) == [("one",), ("two",)]
    read = {r.p.rsplit("/", 1)[0].rsplit("/", 2)[-2:][1] for r in one.selectExpr("_metadata.file_path as p").distinct().collect()}
    assert len(read) == 1 and opened
    assert datasets.load_feature(spark, path, "no such", "one").count() == 0


def test_indexed_search(spark, tmp_path):
    from cohortlane.operators.search import table_search
    from cohortlane.operators.search_index import indexed_search, searched_blocks, write_search_index

    df = spark.createDataFrame(
        [(i, f"name {i:04d}", float(i) / 4, ["Alpha beta", "GAMMA ray", "été 漢字", None][i // 100]) for i in range(400)], "k int, name string, x double, `a.b` string"
    )
    root = write_search_index(df, str(tmp_path / "index"), ["k"], 25)
    assert len(list((tmp_path / "index" / "rows").glob("block=*"))) == 16
    for query in ("gamma", "GAMMA 01", "name 0123", "alpha ray", "漢字 été", "be 3", "", "zzz", "00 4", "25.5"):
        assert rows(indexed_search(spark, root, query)) == rows(table_search(df, query)), query
    assert len(searched_blocks(spark, root, "gamma")) <= 5 and searched_blocks(spark, root, "zzzz") == [] and searched_blocks(spark, root, "a 4") is None
    one = indexed_search(spark, root, "gamma")
    assert {f.rsplit("/", 2)[-2] for f in one.inputFiles()} == {f"block={b}" for b in searched_blocks(spark, root, "gamma")}
    empty = write_search_index(df.limit(0), str(tmp_path / "empty"), ["k"])
    assert indexed_search(spark, empty, "gamma").count() == 0


def test_merged_quantile_sketches(spark):
    import random

    from cohortlane.operators import binning

    rng = random.Random(7)
    values = [(d, rng.choice([None, float("nan"), rng.gauss(0, 10), float(rng.randrange(5))])) for d in range(30) for _ in range(400)]
    df = spark.createDataFrame(values + [(99, None)], "day int, x double")
    size = 200
    sketches = binning.value_sketches(df, "x", ["day"], size)
    held = sorted(v for _, v in values if v is not None and v == v)
    found = {r.cut_no: (r.cut, r.n) for r in binning.merged_cuts(sketches).collect()}
    assert set(found) == {1, 2, 3, 4, 5} and found[1] == (held[0], len(held)) and found[5] == (held[-1], len(held))
    for number, (cut, n) in found.items():
        below, up_to = sum(v < cut for v in held) / n, sum(v <= cut for v in held) / n
        assert below - binning.rank_error(size) <= (number - 1) / 4 <= up_to + binning.rank_error(size)
    by_day = binning.merged_cuts(sketches, ["day"])
    assert by_day.filter("day = 99").count() == 0 and by_day.filter("day = 3").count() == 5
    assert binning.rank_error(2000) < binning.rank_error(200) < 0.02
