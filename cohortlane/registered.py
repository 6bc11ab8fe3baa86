"""The named queries over the sales, event and document tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.functions.flags import is_available_exact
from cohortlane.functions.names import with_clean_names
from cohortlane.functions.text import first_line, likely_delimiter, simple_delimiter, split_names
from cohortlane.functions.values import as_text, legacy_label
from cohortlane.operators import aggregates, binning, contingency, covariates, ranking, reshape, search, timing
from cohortlane.operators.constraints import key_violations
from cohortlane.operators.search_index import indexed_search, write_search_index
from cohortlane.plans.overlap import Overlap
from cohortlane.plans.study import Study
from cohortlane.plans.timeline import Timeline, ranges_with_points
from cohortlane.session import shared_folder, written
from cohortlane.sources import datasets, delimited
from cohortlane.spec import StudySpec
from cohortlane.streaming import ingest, running
from cohortlane.studies import event_types, events_study, labels_study, orders_study, orders_with_flags, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# Availability


@query
def long_availability(spark, folder):
    return rounded(reshape.long_availability(*orders_study(spark, folder)), "time")


def mixed_flags(spark, folder) -> tuple[DataFrame, StudySpec]:
    """The return flags as a boolean, an int, a double and texts of several spellings."""
    df = orders_with_flags(spark, folder)
    spellings = F.array(*(F.lit(t) for t in ("Yes", "YES", "yes", "True", " Yes", "1", "TRUE", "true")))
    df = df.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority",
        F.col("has_A").alias("as_boolean"),
        F.col("has_N").cast("int").alias("as_int"),
        F.col("has_R").cast("double").alias("as_double"),
        F.when(F.col("has_A"), F.get(spellings, F.pmod("o_orderkey", F.lit(8)).cast("int")))
        .when(F.col("has_N"), "No").alias("as_words"),
    )
    return df, StudySpec("o_orderkey", "o_custkey", "o_orderdate", ("as_boolean", "as_int", "as_double", "as_words"))


@query
def availability_mixed_flags(spark, folder):
    return reshape.availability_cells(*mixed_flags(spark, folder))


@query
def availability_case_sensitive(spark, folder):
    return reshape.availability_cells(
        *mixed_flags(spark, folder), flag=lambda df, m: F.when(is_available_exact(df, m), as_text(df, m))
    )


@query
def availability_wide(spark, folder):
    df, spec = mixed_flags(spark, folder)
    wide = reshape.availability_wide(df, spec, "o_orderpriority")
    flagged = reshape.wide_to_indicators(wide, spec.modalities, "has_")
    return flagged.withColumns({m: F.array_join(m, "|") for m in spec.modalities})


# Counts and ranges


@query
def modality_ranges_orders(spark, folder):
    return rounded(aggregates.modality_ranges(*orders_study(spark, folder)), "min_pts", "max_pts")


@query
def modality_ranges_events(spark, folder):
    return aggregates.modality_ranges(*events_study(spark, folder))


@query
def samples_per_subject_orders(spark, folder):
    return aggregates.samples_per_subject(*orders_study(spark, folder))


@query
def samples_per_subject_events(spark, folder):
    return aggregates.samples_per_subject(*events_study(spark, folder))


@query
def subject_totals_orders(spark, folder):
    return aggregates.subject_totals(*orders_study(spark, folder))


@query
def timepoint_stats_orders(spark, folder):
    return aggregates.timepoint_stats(*orders_study(spark, folder))


@query
def timepoint_stats_events(spark, folder):
    return aggregates.timepoint_stats(*events_study(spark, folder))


@query
def timepoint_stats_labels(spark, folder):
    return aggregates.timepoint_stats(*labels_study(spark, folder))


@query
def timepoint_stats_text_orders(spark, folder):
    return aggregates.timepoint_stats_text(*orders_study(spark, folder))


@query
def timepoint_stats_text_events(spark, folder):
    return aggregates.timepoint_stats_text(*events_study(spark, folder))


@query
def cohort_sizes(spark, folder):
    return aggregates.cohort_sizes(*orders_study(spark, folder))


@query
def subject_rank_by_points_orders(spark, folder):
    return ranking.subject_order_by_points(*orders_study(spark, folder))


@query
def subject_rank_by_points_events(spark, folder):
    return ranking.subject_order_by_points(*events_study(spark, folder))


# Times


def text_times(spark, folder) -> tuple[DataFrame, StudySpec]:
    """Order dates written in several ways, every seventh of them unreadable."""
    forms = ("MM/dd/yyyy HH:mm", "M/d/yyyy H:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "M.d.yy")
    orders = table(spark, folder, "orders")
    form = F.pmod("o_orderkey", F.lit(7))
    text = reduce(
        lambda rest, f: F.when(form == f[0], F.date_format("o_orderdate", f[1])).otherwise(rest), enumerate(forms), F.lit("unknown")
    )
    return orders.select("o_orderkey", "o_custkey", text.alias("visit")), StudySpec("o_orderkey", "o_custkey", "visit", ())


def number_times(spark, folder) -> tuple[DataFrame, StudySpec]:
    """Day numbers as text, some of them with a word before."""
    df, spec = events_study(spark, folder)
    text = F.when(F.col("day") % 10 == 3, F.concat(F.lit("day-"), "day")).otherwise(F.col("day").cast("string"))
    return df.select("sample", "user_id", text.alias("visit")), StudySpec("sample", "user_id", "visit", ())


@query
def days_since_start_typed(spark, folder):
    df, spec = orders_study(spark, folder)
    orders = table(spark, folder, "orders")
    return rounded(timing.days_since_start(orders, StudySpec(spec.sample, spec.subject, spec.time, ())), "time")


@query
def days_since_start_null_subjects(spark, folder):
    orders = table(spark, folder, "orders")
    orders = orders.withColumn("o_custkey", F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey")))
    return rounded(timing.days_since_start(orders, StudySpec("o_orderkey", "o_custkey", "o_orderdate", ())), "time")


@query
def days_since_start_text(spark, folder):
    return rounded(timing.days_since_start(*text_times(spark, folder)), "time")


@query
def days_since_start_trained(spark, folder):
    """Day-first dates whose first rows fit month-first too; the column as a whole tells."""
    orders = table(spark, folder, "orders")
    day = F.dayofmonth("o_orderdate")
    text = F.when(F.col("o_orderkey") % 11 == 0, "not seen").when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "d.M.yy"))
    visits = orders.select("o_orderkey", "o_custkey", text.alias("visit"), (day > 12).alias("told")).orderBy("told", "o_orderkey").drop("told")
    return rounded(timing.days_since_start(visits, StudySpec("o_orderkey", "o_custkey", "visit", ())), "time")


@query
def days_since_start_numeric(spark, folder):
    return timing.days_since_start(*number_times(spark, folder))


@query
def time_kind_facts(spark, folder):
    columns = {
        "typed": (table(spark, folder, "orders"), "o_orderdate"),
        "text": (text_times(spark, folder)[0], "visit"),
        "words": (number_times(spark, folder)[0], "visit"),
        "number": (events_study(spark, folder)[0].withColumn("day", F.col("day").cast("string")), "day"),
    }
    facts = [timing.time_kind_facts(df, c).withColumn("column_name", F.lit(name)) for name, (df, c) in columns.items()]
    return rounded(reduce(DataFrame.unionByName, facts), "parsed_ratio")


# Groups


@query
def contingency_live(spark, folder):
    return contingency.contingency(*orders_study(spark, folder, customer=True), "segment")


@query
def contingency_live_changing_groups(spark, folder):
    return contingency.contingency(*orders_study(spark, folder), "o_orderpriority")


@query
def contingency_live_labels(spark, folder):
    return contingency.contingency(*labels_study(spark, folder), "lang")


def null_subjects(spark, folder) -> tuple[DataFrame, StudySpec]:
    """The orders study with every 13th customer unknown."""
    df, spec = orders_study(spark, folder, customer=True)
    return df.withColumn("o_custkey", F.when(F.col("o_custkey") % 13 != 0, F.col("o_custkey"))), spec


@query
def contingency_live_null_subjects(spark, folder):
    return contingency.contingency(*null_subjects(spark, folder), "c_mktsegment")


@query
def timeline_points_null_subjects(spark, folder):
    df, spec = null_subjects(spark, folder)
    wanted = [spec.sample, spec.subject, spec.time, *spec.modalities]
    return rounded(Timeline(written(df.select(*wanted), "samples"), spec).points(), "time")


@query
def cleaned_study(spark, folder):
    """Columns with blanks, signs and leading digits, cleaned, and asked for as they were or as they are."""
    df, spec = orders_study(spark, folder, customer=True)
    shown = dict(zip([spec.sample, spec.subject, spec.time, *spec.modalities, "segment"], ["Sample ID", "Subject ID", "Visit (day)", "ret A", "ret-N", "2 ret", "market segment"]))
    clean = with_clean_names(df.select(*(F.col(c).alias(name) for c, name in shown.items())))
    spec = StudySpec.from_positions(clean, ["ret A", "ret.N", "2 ret", "absent"])
    return Study(clean, spec).contingency("market segment")


@query
def samples_without_key(spark, folder):
    df, spec = orders_study(spark, folder)
    return spec.on(df).without_key(df).drop("o_totalprice")


@query
def contingency_variant(spark, folder):
    return contingency.contingency_with_missing(*orders_study(spark, folder, customer=True), "segment")


@query
def contingency_variant_mixed_flags(spark, folder):
    return contingency.contingency_with_missing(*mixed_flags(spark, folder), "o_orderpriority")


@query
def contingency_variant_joins(spark, folder):
    return contingency.contingency_by_joins(*orders_study(spark, folder, customer=True), "segment")


@query
def long_group_join(spark, folder):
    df, spec = orders_study(spark, folder)
    long = reshape.long_availability(df, spec, ["o_orderpriority"])
    groups = long.select("subject", "time", F.col("o_orderpriority").alias("Group"))
    joined = contingency.long_with_groups(long.drop("o_orderpriority"), groups)
    return rounded(joined, "time")


@query
def long_group_join_skewed(spark, folder):
    """A third of the orders are of one subject at one time, in all groups that there are."""
    orders = table(spark, folder, "orders")
    hub = F.col("o_orderkey") % 3 == 0
    rows = orders.select(
        F.col("o_orderkey").alias("sample_id"),
        F.when(hub, F.lit(None).cast("long")).otherwise(F.col("o_custkey")).alias("subject"),
        F.when(hub, F.lit(0)).otherwise(F.year("o_orderdate")).alias("time"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("Group"),
    )
    return contingency.long_with_groups(rows, rows.drop("sample_id"))


@query
def group_collision(spark, folder):
    """The cells have a Group of their own, which gives way to that of the group rows."""
    df, spec = orders_study(spark, folder)
    long = reshape.long_availability(df, spec, ["o_orderpriority"]).withColumn("Group", F.col("modality"))
    groups = long.select("subject", "time", F.col("o_orderpriority").alias("Group"))
    return rounded(contingency.long_with_groups(long.drop("o_orderpriority"), groups), "time")


@query
def eligible_covariates(spark, folder):
    df, spec = orders_study(spark, folder, nation=True)
    wanted = ["o_orderpriority", "segment", "c_mktsegment", "n_name", "c_acctbal", "unit"]
    df = df.withColumn("unit", F.lit("order")).select(spec.sample, spec.subject, spec.time, *spec.modalities, *wanted)
    return covariates.eligible_covariates(df, spec)


@query
def subject_first_value(spark, folder):
    df, spec = orders_study(spark, folder)
    df = df.withColumn("urgent", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return covariates.first_value(df, spec, "urgent")


@query
def group_sizes(spark, folder):
    return covariates.group_sizes(*orders_study(spark, folder, customer=True), "segment")


@query
def secondary_group_sizes(spark, folder):
    return covariates.subject_label_sizes(*orders_study(spark, folder, nation=True), "n_name")


@query
def local_group_counts(spark, folder):
    return covariates.local_counts(*orders_study(spark, folder, nation=True), "segment", "n_name")


@query
def subject_order_primary(spark, folder):
    return ranking.subject_order_primary(*orders_study(spark, folder, customer=True), "segment")


@query
def subject_order_primary_changing(spark, folder):
    return ranking.subject_order_primary(*orders_study(spark, folder), "o_orderstatus")


@query
def subject_order_primary_secondary(spark, folder):
    return ranking.subject_order_primary_secondary(*orders_study(spark, folder, nation=True), "segment", "n_name")


@query
def subject_order_secondary(spark, folder):
    return ranking.subject_order_secondary(*orders_study(spark, folder, nation=True), "n_name")


@query
def subject_order_numeric_secondary(spark, folder):
    return Study(*orders_study(spark, folder, customer=True)).subject_order("segment", "c_acctbal")


@query
def subject_order_numeric_secondary_only(spark, folder):
    return Study(*orders_study(spark, folder, customer=True)).subject_order(secondary="c_acctbal")


# Bins


@query
def quartile_cuts(spark, folder):
    return rounded(binning.quartile_cuts_frame(table(spark, folder, "customer"), "c_acctbal"), "cut")


@query
def quartile_cuts_with_ties(spark, folder):
    return rounded(binning.quartile_cuts_frame(table(spark, folder, "lineitem"), "l_quantity"), "cut")


@query
def quartile_cuts_merged(spark, folder):
    """Quartiles of all customers from one stored sketch per market segment, held against the exact places."""
    customers = table(spark, folder, "customer")
    sketches = written(binning.value_sketches(customers, "c_acctbal", ["c_mktsegment"]), "sketches")
    cuts = {row["cut_no"]: row["cut"] for row in binning.merged_cuts(sketches).collect()}
    value = F.col("c_acctbal")
    held = customers.agg(F.count(value).alias("n"), *(F.count_if(value < cut).alias(f"below{i}") for i, cut in cuts.items()), *(F.count_if(value <= cut).alias(f"up_to{i}") for i, cut in cuts.items()))
    told = [F.struct(F.lit(i).alias("cut_no"), F.lit(cut).alias("cut"), F.col(f"below{i}").alias("below"), F.col(f"up_to{i}").alias("up_to")) for i, cut in cuts.items()]
    places = held.select("n", F.inline(F.array(*told)))
    wanted, slack = (F.col("cut_no") - 1) / 4, binning.rank_error()
    near = (F.col("below") / F.col("n") <= wanted + slack) & (F.col("up_to") / F.col("n") >= wanted - slack)
    return places.select("cut_no", "n", F.when(F.col("cut_no").isin(1, 5), F.round("cut", 6)).alias("end"), near.alias("within_error"))


@query
def quartile_bins(spark, folder):
    return binning.quartile_bins(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query
def quartile_bins_few_values(spark, folder):
    return binning.quartile_bins(table(spark, folder, "labels"), "quality")


@query
def legacy_bin_labels(spark, folder):
    part = table(spark, folder, "part")
    bounds = F.concat(F.col("p_size"), F.lit(","), F.when(F.col("p_size") % 2 == 0, (F.col("p_size") + 5).cast("string")).otherwise(F.col("p_retailprice").cast("string")))
    label = F.concat(F.lit("["), bounds, F.when(F.col("p_size") % 3 == 0, "]").otherwise(")"))
    return part.select("p_partkey", label.alias("label")).withColumn("legacy_label", legacy_label(F.col("label")))


@query
def covariate_scale_kind(spark, folder):
    columns = (("customer", "c_acctbal"), ("customer", "c_mktsegment"), ("nation", "n_name"), ("part", "p_size"))
    levels = [
        binning.covariate_levels(table(spark, folder, name), column).withColumn("covariate", F.lit(column))
        for name, column in columns
    ]
    return reduce(DataFrame.unionByName, levels)


# Charts


def orders_timeline(spark, folder) -> Timeline:
    # A timeline reads its samples three times, so the joins behind them are written out.
    df, spec = orders_study(spark, folder, customer=True)
    wanted = [spec.sample, spec.subject, spec.time, *spec.modalities, "segment", "c_acctbal"]
    return Timeline(written(df.select(*wanted), "samples"), spec, primary="segment", secondary="c_acctbal")


@query
def timeline_points(spark, folder):
    return rounded(orders_timeline(spark, folder).points(), "time")


@query
def timeline_segments(spark, folder):
    return rounded(orders_timeline(spark, folder).segments(), "min_pts", "max_pts")


@query
def timeline_strip(spark, folder):
    return rounded(orders_timeline(spark, folder).strip(), "strip_x", "strip_width")


@query
def timeline_anchored(spark, folder):
    return rounded(orders_timeline(spark, folder).anchored(), "time")


@query
def timeline_facet(spark, folder):
    return rounded(orders_timeline(spark, folder).facet("ret_N"), "time")


@query
def timeline_axis_labels(spark, folder):
    return orders_timeline(spark, folder).axis_labels()


@query
def timeline_modality_levels(spark, folder):
    return orders_timeline(spark, folder).modality_levels()


@query
def timeline_events(spark, folder):
    return Timeline(*events_study(spark, folder)).points()


@query
def ranges_semi_join(spark, folder):
    df, spec = events_study(spark, folder)
    cells = reshape.availability_cells(df, spec).filter("modality <> 'error'")
    return ranges_with_points(aggregates.modality_ranges(df, spec), cells)


@query
def strip_positions(spark, folder):
    return rounded(
        Timeline(*events_study(spark, folder)).geometry, "time_range", "strip_offset", "strip_width", "strip_x", "anchor_x"
    )


@query
def overlap_points(spark, folder):
    return rounded(Overlap(*events_study(spark, folder)).points(), "y_offset")


@query
def overlap_segments(spark, folder):
    return rounded(Overlap(*events_study(spark, folder)).segments(), "y_offset")


@query
def overlap_limits(spark, folder):
    return rounded(Overlap(*events_study(spark, folder)).limits(), "padding", "x_min", "x_max")


@query
def modality_lanes(spark, folder):
    return rounded(aggregates.modality_lanes(*events_study(spark, folder)), "lane_offset")


# Tables and files


@query
def key_violations_lineitem(spark, folder):
    return key_violations(table(spark, folder, "lineitem"), "l_orderkey")


@query
def key_violations_orders(spark, folder):
    return key_violations(table(spark, folder, "orders"), "o_orderkey")


@query
def delimiter_sniff(spark, folder):
    line = first_line(F.col("text"))
    return table(spark, folder, "documents").select(
        "doc_id", likely_delimiter(line).alias("delimiter"), simple_delimiter(line).alias("simple_delimiter")
    )


@query
def name_list_parse(spark, folder):
    text = F.concat(F.regexp_replace("p_name", " ", " ,\t"), F.lit(",, "), F.col("p_type"))
    return table(spark, folder, "part").select("p_partkey", F.explode(split_names(text)).alias("name"))


@query
def name_table_flatten(spark, folder):
    padded = table(spark, folder, "part").select(
        F.concat(F.lit(" "), "p_name", F.lit("\t")).alias("a"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(" ").alias("b")
    )
    return delimited.flatten_names(padded)


@query
def preview(spark, folder):
    lines = table(spark, folder, "lineitem")
    return search.preview(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 10)


@query
def dataset_profile(spark, folder):
    return search.dataset_profile(table(spark, folder, "lineitem"))


@query
def feature_matrix_long(spark, folder):
    return rounded(datasets.array_features(table(spark, folder, "embeddings"), "vec_id", "embedding", "embeddings"), "value")


def scratch(spark, name: str) -> str:
    return f"{shared_folder(spark)}/cohortlane/{name}-{uuid.uuid4().hex}"


@query
def folder_delimiters(spark, folder):
    """One text file per language and source; only the first line of each is read."""
    name = F.concat_ws("-", "lang", "source").alias("name")
    texts = table(spark, folder, "documents").select(name, "doc_id", "text")
    path = scratch(spark, "texts")
    texts.repartition("name").sortWithinPartitions("name", "doc_id").select("name", "text").write.partitionBy("name").text(path)
    found = delimited.sniff_delimiters(spark, path)
    return found.select(F.regexp_extract("path", "name=([^/]*)", 1).alias("name"), "line", "delimiter")


@query
def file_preview(spark, folder):
    """The first rows of one file per market segment, some with commas and some with semicolons."""
    customers = table(spark, folder, "customer").withColumn("segment", F.col("c_mktsegment"))
    paths = []
    for mark, wanted in ((",", F.col("segment") < "F"), (";", F.col("segment") >= "F")):
        paths.append(scratch(spark, "previewed"))
        rows = customers.filter(wanted).repartition("segment").sortWithinPartitions("segment", "c_custkey")
        rows.write.partitionBy("segment").option("header", True).option("sep", mark).csv(paths[-1])
    shown = delimited.folder_previews(spark, paths, 5)
    return shown.select(F.regexp_extract("path", "segment=([^/]*)", 1).alias("segment"), "row_no", F.array_join("names", "|").alias("names"), F.array_join("cells", "|").alias("cells"))


@query
def mixed_folder_read(spark, folder):
    """Customers in files of three separators, other orders of columns and other types."""
    customers = table(spark, folder, "customer")
    kinds = (
        (",", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], {}),
        (";", ["c_mktsegment", "c_acctbal", "c_custkey", "c_name"], {"c_acctbal": F.floor("c_acctbal")}),
        ("\t", ["c_name", "c_custkey"], {"c_custkey": F.format_string("K%05d", "c_custkey")}),
    )
    base = scratch(spark, "mixed")
    for i, (mark, names, changed) in enumerate(kinds):
        rows = customers.filter(F.col("c_custkey") % 3 == i).withColumns(changed).select(*names)
        rows.write.option("header", True).option("sep", mark).csv(f"{base}/{i}")
    return delimited.read_delimited(spark, [f"{base}/{i}" for i in range(len(kinds))], "txt")


@query
def names_from_files(spark, folder):
    """Part names from text files with a header line and from tables without one."""
    parts = table(spark, folder, "part")
    lists, tables = scratch(spark, "names"), scratch(spark, "names")
    export = parts.filter("p_size <= 25").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("Names"))
    export.write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(lists)
    parts.filter("p_size > 25").select("p_type", "p_name").write.csv(tables)
    return delimited.read_names(spark, lists, skip_header=True, extension="txt").unionByName(delimited.read_names(spark, tables, extension="csv"))


@query
def feature_matrix_unnamed(spark, folder):
    """A matrix whose first column and one feature have no name, and another feature is called NA."""
    vectors = table(spark, folder, "embeddings")
    sample = F.lpad(F.col("vec_id").cast("string"), 8, "0")
    names = ["", "f0", "NA", "", "f3"]
    cells = [sample, *(F.col("embedding")[i].cast("double").cast("string") for i in range(4))]
    line = F.concat_ws(",", *cells)
    path = scratch(spark, "matrix")
    vectors.select(line.alias(",".join(names))).write.option("header", True).option("sep", "\t").csv(path)
    return rounded(datasets.read_matrices(spark, path).select("sample_id", "feature", "value"), "value")


@query
def feature_matrix_blocks(spark, folder):
    """Three features of a stored matrix, each from its own block."""
    vectors = table(spark, folder, "embeddings")
    long = datasets.array_features(vectors, "vec_id", "embedding", "embeddings")
    path = datasets.save_matrices(long, scratch(spark, "blocks"))
    wanted = [datasets.load_feature(spark, path, feature, "embeddings") for feature in ("f0", "f7", "f31")]
    return rounded(reduce(DataFrame.unionByName, wanted).select("dataset", "sample_id", "feature", "value"), "value")


@query
def new_files_only(spark, folder):
    documents = table(spark, folder, "documents")
    name = F.concat_ws("-", "lang", "source")
    arrivals = documents.select(name.alias("name"), F.format_string("%s/%08d.txt", name, "doc_id").alias("path"))
    toxic = table(spark, folder, "labels").filter("toxic = 1").select("doc_id")
    registry = documents.join(toxic, "doc_id").select(name.alias("name")).distinct()
    return datasets.new_files_only(arrivals, registry)


@query
def table_search(spark, folder):
    return search.table_search(table(spark, folder, "customer"), "House 00 4")


@query
def table_search_indexed(spark, folder):
    """The same search through triples per block; half of the blocks' market segments lie apart."""
    customers = table(spark, folder, "customer")
    blocks = max(1, customers.count() // 16)
    root = write_search_index(customers, scratch(spark, "search"), ["c_mktsegment", "c_custkey"], blocks)
    return indexed_search(spark, root, "House 00 4")


@query
def csv_roundtrip(spark, folder):
    customers = table(spark, folder, "customer")
    path = f"{shared_folder(spark)}/cohortlane/csv-{uuid.uuid4().hex}"
    datasets.export_csv(customers, path)
    return delimited.read_delimited(spark, path, "csv", customers.schema)


@query
def stored_dataset(spark, folder):
    root = f"{shared_folder(spark)}/cohortlane/stored-{uuid.uuid4().hex}"
    return datasets.load_dataset(spark, [datasets.save_dataset(table(spark, folder, "orders"), root, "metadata", "all orders", "o_orderkey")])


@query
def feature_matrix_files(spark, folder):
    vectors = table(spark, folder, "embeddings")
    width = vectors.select(F.max(F.size("embedding"))).first()[0]
    sample = F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("Sample, ID")
    base = f"{shared_folder(spark)}/cohortlane/matrix-{uuid.uuid4().hex}"
    halves = {f"{base}/first": range(width // 2), f"{base}/second": range(width // 2, width)}
    for path, places in halves.items():
        datasets.export_csv(vectors.select(sample, *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in places)), path)
    return rounded(datasets.read_matrices(spark, list(halves)).select("sample_id", "feature", "value"), "value")


@query
def matrix_key_violations(spark, folder):
    """Documents as a matrix whose sample key is the number of characters."""
    documents = table(spark, folder, "documents").select(F.lpad(F.col("n_chars").cast("string"), 6, "0").alias("sample"), F.col("doc_id").alias("f0"))
    path = f"{shared_folder(spark)}/cohortlane/matrix-{uuid.uuid4().hex}"
    datasets.export_csv(documents, path)
    rows = datasets.matrix_rows(spark, path).withColumn("dataset", F.lit("documents"))
    return datasets.matrix_key_violations(rows)


@query
def streamed_files(spark, folder):
    customers = table(spark, folder, "customer")
    base = f"{shared_folder(spark)}/cohortlane/stream-{uuid.uuid4().hex}"
    datasets.export_csv(customers, f"{base}/inbox")
    stream = ingest.sample_file_stream(spark, f"{base}/inbox", customers.schema)
    ingest.append_new_files(stream, "c_custkey", f"{base}/kept", f"{base}/refused", f"{base}/offsets").awaitTermination()
    return spark.read.parquet(f"{base}/kept").select(*customers.columns)


@query
def streamed_files_two_runs(spark, folder):
    """A second run, with a fresh checkpoint, meets keys that are stored, and adds what is new."""
    customers = table(spark, folder, "customer")
    base = scratch(spark, "stream")
    even = F.col("c_custkey") % 2 == 0
    for run, arrived in enumerate((even, ~even | (F.col("c_custkey") % 10 == 0))):
        datasets.export_csv(customers.filter(arrived), f"{base}/inbox/{run}")
        stream = ingest.sample_file_stream(spark, f"{base}/inbox/*", customers.schema)
        ingest.append_new_files(stream, "c_custkey", f"{base}/kept", f"{base}/refused", f"{base}/offsets{run}").awaitTermination()
    return spark.read.parquet(f"{base}/kept").select(*customers.columns)


@query
def streamed_files_refused(spark, folder):
    """Rows whose key is stored already, stands twice in the batch or is missing."""
    customers = table(spark, folder, "customer")
    base = scratch(spark, "stream")
    key = F.col("c_custkey")
    twice = customers.filter(key % 7 == 3)
    batches = (
        customers.filter(key % 2 == 0),
        customers.filter((key % 10 == 0) | (key % 2 == 1)).unionByName(twice.filter(key % 2 == 1)).unionByName(customers.filter(key % 11 == 0).withColumn("c_custkey", F.lit(None).cast("long"))),
    )
    for run, arrived in enumerate(batches):
        datasets.export_csv(arrived, f"{base}/inbox/{run}")
        stream = ingest.sample_file_stream(spark, f"{base}/inbox/*", customers.schema)
        ingest.append_new_files(stream, "c_custkey", f"{base}/kept", f"{base}/refused", f"{base}/offsets").awaitTermination()
    return spark.read.parquet(f"{base}/refused").select(*customers.columns)


def event_samples(events: DataFrame, kinds: tuple[str, ...]) -> tuple[DataFrame, StudySpec]:
    """One sample per event, a boolean per type."""
    samples = events.select("event_id", "user_id", "ts", *((F.col("event_type") == k).alias(k) for k in kinds))
    return samples, StudySpec("event_id", "user_id", "ts", kinds, time_kind="date")


@query
def running_ranges_events(spark, folder):
    events = table(spark, folder, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/event[s].parquet")
    base = scratch(spark, "running")
    ranges = running.running_ranges(*event_samples(stream, event_types(events)))
    running.write_snapshots(ranges, f"{base}/snapshots", f"{base}/offsets").awaitTermination()
    return running.read_snapshot(spark, f"{base}/snapshots")


@query
def running_ranges_batches(spark, folder):
    """Three batches merged one after the other; the newest version is read."""
    events = table(spark, folder, "events")
    base, kinds = scratch(spark, "running"), event_types(events)
    for batch in range(3):
        events.filter(F.col("event_id") % 3 == batch).write.parquet(f"{base}/inbox/{batch}")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/inbox/*")
        ranges = running.running_ranges(*event_samples(stream, kinds))
        running.write_snapshots(ranges, f"{base}/snapshots", f"{base}/offsets").awaitTermination()
    return running.read_snapshot(spark, f"{base}/snapshots")
