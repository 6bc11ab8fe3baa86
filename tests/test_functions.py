from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cohortlane.functions.flags import available_text, cell_available, is_available, is_available_exact
from cohortlane.functions.names import column_names, syntactic_name, with_clean_names
from cohortlane.functions.text import file_base_name, file_extension, likely_delimiter, simple_delimiter, split_names
from cohortlane.functions.times import with_date_text
from cohortlane.functions.values import (
    is_missing_label, legacy_label, missing_label, none_label, number_text, percent_text, to_number,
)


def values(df, *columns):
    return [r[0] if len(columns) == 1 else tuple(r) for r in df.select(*columns).collect()]


TEXT_FLAGS = ["Yes", "YES", "yes", " Yes", "True", "true", "TRUE", "1", "1.0", "0", "No", "", None]


def test_text_flags_in_any_case(spark):
    df = spark.createDataFrame([(f,) for f in TEXT_FLAGS], "flag string")
    hits = [f for f, hit in zip(TEXT_FLAGS, values(df, is_available(df, "flag"))) if hit]
    assert hits == ["Yes", "YES", "yes", "True", "true", "TRUE", "1"]


def test_text_flags_exact(spark):
    df = spark.createDataFrame([(f,) for f in TEXT_FLAGS], "flag string")
    hits = [f for f, hit in zip(TEXT_FLAGS, values(df, is_available_exact(df, "flag"))) if hit]
    assert hits == ["Yes", "yes", "TRUE", "1"]


@pytest.mark.parametrize("kind, given, text", [
    ("boolean", [True, False, None], ["TRUE", None, None]),
    ("int", [1, 0, 2, None], ["1", None, None, None]),
    ("double", [1.0, 0.0, float("nan"), None], ["1", None, None, None]),
])
def test_typed_flags(spark, kind, given, text):
    df = spark.createDataFrame([(v,) for v in given], f"flag {kind}")
    assert values(df, available_text(df, "flag")) == text
    assert values(df, is_available(df, "flag")) == [t is not None for t in text]


def test_cells(spark):
    df = spark.createDataFrame([(["Yes"],), (["file.txt"],), ([""],), ([],), (None,), ([None, "1"],)], "cell array<string>")
    assert values(df, cell_available(F.col("cell"))) == [1, 1, 0, 0, 0, 1]


def test_missing_labels(spark):
    df = spark.createDataFrame([(v,) for v in (None, "", "none", "Unknown", "NA", "missing", "FMT", "nan")], "g string")
    assert values(df, is_missing_label(F.col("g"))) == [True] * 6 + [False] * 2
    assert values(df, none_label(F.col("g")))[-2:] == ["FMT", "nan"]
    assert values(df, missing_label(F.col("g")))[:2] == ["Missing", ""]


def test_legacy_labels(spark):
    labels = ["[18,25)", "[40,55]", "[18.5,25.2)", "abc,12", "plain"]
    df = spark.createDataFrame([(v,) for v in labels], "label string")
    assert values(df, legacy_label(F.col("label"))) == ["[18)", "[40,55]", "[18.5,25.2)", "abc", "plain"]


def test_percent_rounds_halves_to_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (6, 28), (29, 29)], "n long, total long")
    assert values(df, percent_text(F.col("n"), F.col("total"))) == ["6.2%", "18.8%", "21.4%", "100.0%"]


def test_number_text(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, -3.0, 1.5, 0.1 + 0.2, 1.25e-7, None)], "x double")
    assert values(df, number_text(F.col("x"))) == ["0", "-3", "1.5", "0.3", "1.25e-07", None]


def test_number_text_ends_in_no_point(spark):
    df = spark.createDataFrame([(v,) for v in (2.9999999999999996, 1e15, 2.5e20, 1e-7, -0.0, 4516.950000000001)], "x double")
    assert values(df, number_text(F.col("x"))) == ["3", "1e+15", "2.5e+20", "1e-07", "0", "4516.95"]


def test_to_number_wants_the_whole_text(spark):
    df = spark.createDataFrame([(v,) for v in ("5", " 5.5 ", "-.5", "1e3", "5d", "abc", "", "0x1A", None)], "t string")
    assert values(df, to_number(F.col("t"))) == [5.0, 5.5, -0.5, 1000.0, None, None, None, None, None]


@pytest.mark.parametrize("text, moment", [
    ("1/5/2024 8:30", datetime(2024, 1, 5, 8, 30)),
    ("01-05-2024 08:30:15", datetime(2024, 1, 5, 8, 30, 15)),
    ("01/05/2024", datetime(2024, 1, 5)),
    ("2024-01-05", datetime(2024, 1, 5)),
    ("2024/1/5", datetime(2024, 1, 5)),
    ("13/02/2024", datetime(2024, 2, 13)),
    ("02.13.2024", datetime(2024, 2, 13)),
    ("1/2/24", datetime(2024, 1, 2)),
    ("1/2/99", datetime(1999, 1, 2)),
    ("20240105", datetime(2024, 1, 5)),
    ("12312024", datetime(2024, 12, 31)),
    ("5 Jan 2024", datetime(2024, 1, 5)),
    ("January 5, 2024", datetime(2024, 1, 5)),
    ("May 5 2024", datetime(2024, 5, 5)),
    ("02/30/2024", None),
    ("13/13/2024", None),
    ("13/02/2024 10:30", None),
    ("5 Foo 2024", None),
    ("visit 1", None),
    ("12", None),
    ("", None),
    (None, None),
])
def test_date_texts(spark, text, moment):
    df = spark.createDataFrame([(text,)], "t string")
    assert with_date_text(df, F.col("t"), "m").first()["m"] == moment


def test_lone_clock_time(spark):
    df = spark.createDataFrame([("10:30",), ("25:00",)], "t string")
    got = with_date_text(df, F.col("t"), "m").select(F.col("m").cast("string")).collect()
    assert [r[0] for r in got] == ["0000-01-01 10:30:00", None]


@pytest.mark.parametrize("name, clean", [
    ("Participant ID", "Participant.ID"), ("1st", "X1st"), ("a-b", "a.b"), ("if", "if."), ("NA", "NA."),
    (".5x", "X.5x"), (".x", ".x"), ("_x", "X_x"), ("", "X"), (None, "NA."), ("ok_1.b", "ok_1.b"),
])
def test_names(name, clean):
    assert syntactic_name(name) == clean


def test_equal_clean_names_stay_apart(spark):
    assert column_names(["a b", "a-b", "c"]) == {"a_b": "a.b", "a_b_2": "a.b", "c": "c"}
    df = spark.createDataFrame([(1, 2)], "`a b` int, `a-b` int")
    assert with_clean_names(df).columns == ["a_b", "a_b_2"]


def test_delimiters(spark):
    lines = ["a,b;c,d", "a\tb\tc,d", "a;b;c", "a b c", "a,b;c", "abc", "", None]
    df = spark.createDataFrame([(v,) for v in lines], "line string")
    assert values(df, likely_delimiter(F.col("line"))) == [",", "\t", ";", " ", ",", ",", ",", None]
    assert values(df, simple_delimiter(F.col("line")))[:7] == [",", "\t", "", "", ",", "", ""]


def test_name_lists(spark):
    df = spark.createDataFrame([("a, b ,,c",), ("",), (None,), ("\tx\r\n, y z ",)], "t string")
    assert values(df, split_names(F.col("t"))) == [["a", "b", "c"], [], [], ["x", "y z"]]


def test_file_names(spark):
    df = spark.createDataFrame([("/x/y/RNA.v2.CSV",), ("plain",), ("/a.b/c",)], "p string")
    assert values(df, file_base_name(F.col("p"))) == ["RNA.v2", "plain", "c"]
    assert values(df, file_extension(F.col("p"))) == ["csv", "", ""]
