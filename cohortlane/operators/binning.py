"""Quartile bins and the scale kind of a covariate."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlane.functions.values import as_text, column, type_of, named
from cohortlane.operators.ranking import dense_order, in_order

# Limits of the binning and palette rules.
MANY_VALUES = 15
# Fixed value: how a level that is a number looks.
NUMBER_LEVEL = r"^-?[0-9,.]+$"
QUALITATIVE_LEVELS = 12
LABEL_DIGITS = 4
LABEL_DIGITS_MOST = 12
QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


@dataclass(frozen=True)
class QuartileCuts:
    """The distinct cut points of a column, at most five, and its distinct values."""

    n_distinct: int
    cuts: tuple[float, ...]

    def usable(self, many: int = MANY_VALUES) -> bool:
        return self.n_distinct > many and len(self.cuts) >= 3

    @property
    def labels(self) -> tuple[str, ...]:
        """Interval texts with as many digits as keep the cut points apart."""
        for digits in range(LABEL_DIGITS, LABEL_DIGITS_MOST + 1):
            texts = [f"{cut:.{digits}g}" for cut in self.cuts]
            if len(set(texts)) == len(texts):
                break
        pairs = list(zip(texts, texts[1:]))
        return tuple(f"[{a},{b}{']' if i == len(pairs) - 1 else ')'}" for i, (a, b) in enumerate(pairs))


def _value_counts(df: DataFrame, name: str) -> DataFrame:
    value = column(df, name).cast("double")
    return df.select(value.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("held"))


def quartile_cuts(df: DataFrame, name: str, approximate: bool = False) -> QuartileCuts:
    """Exact linear-interpolation quartiles over all rows, duplicates dropped.

    The values fold to counts, the distinct values are sorted across the cluster, and only
    the slices that hold a wanted position are looked into. ``approximate`` takes the cut points
    from a sketch; the distinct count stays exact up to one more than ``MANY_VALUES``, where it ends.
    """
    if not isinstance(type_of(df, name), T.NumericType):
        raise ValueError(f"{name} is not numeric")
    if approximate:
        value = column(df, name).cast("double")
        row = df.agg(F.percentile_approx(value, list(QUARTILES), 100_000).alias("cuts")).first()
        few = df.select(value.alias("value")).filter("value IS NOT NULL").distinct().limit(MANY_VALUES + 1).count()
        return QuartileCuts(few, tuple(sorted(set(row["cuts"] or ()))))
    placed = in_order(_value_counts(df, name), F.col("value"))
    # One row per sorted partition.
    slices = placed.groupBy("_slice").agg(F.count("*").alias("n_distinct"), F.sum("held").alias("n")).orderBy("_slice").collect()
    n = sum(s["n"] for s in slices)
    if not n:
        return QuartileCuts(0, ())
    spots = [p * (n - 1) for p in QUARTILES]
    wanted = sorted({int(edge) for spot in spots for edge in (math.floor(spot), math.ceil(spot))})
    at = _values_at(placed, {s["_slice"]: s["n"] for s in slices}, wanted)
    cuts = []
    for spot in spots:
        low, high, part = math.floor(spot), math.ceil(spot), spot - math.floor(spot)
        cuts.append(at[low] if at[low] == at[high] else (1 - part) * at[low] + part * at[high])
    return QuartileCuts(sum(s["n_distinct"] for s in slices), tuple(sorted(set(cuts))))


def _values_at(placed: DataFrame, held: dict[int, int], wanted: list[int]) -> dict[int, float]:
    """Values at 0-based positions; at most eight positions, so at most eight slices are read."""
    before, inside = 0, {}
    for number, size in held.items():
        if any(before <= w < before + size for w in wanted):
            inside[number] = before
        before += size
    starts = F.create_map(*(F.lit(v).cast("bigint") for pair in inside.items() for v in pair))
    earlier = Window.partitionBy("_slice").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.filter(F.col("_slice").isin(*inside)).select(
        "value", "held", (starts[F.col("_slice")] + F.coalesce(F.sum("held").over(earlier), F.lit(0))).alias("low")
    )
    spots = F.array(*(F.lit(w).cast("bigint") for w in wanted))
    low, high = F.col("low"), F.col("low") + F.col("held")
    hits = counted.select("value", F.explode(F.filter(spots, lambda w: (w >= low) & (w < high))).alias("spot"))
    return {row["spot"]: row["value"] for row in hits.collect()}


#: Size of a sketch; see ``rank_error``.
SKETCH_SIZE = 2_000


def rank_error(size: int = SKETCH_SIZE) -> float:
    """How far, as a share of all values, a cut from a sketch may lie from its place, 99 times in 100.

    The published bound of the sketch for one rank, the same however many sketches were merged.
    """
    return 2.296 / size**0.9723


def value_sketches(df: DataFrame, name: str, by: list[str], size: int = SKETCH_SIZE) -> DataFrame:
    """``by``, ``n`` and a mergeable quantile sketch of the non-null values of each group, a few kilobytes whatever its rows."""
    value = column(df, name).cast("double")
    rows = df.select(*(named(c) for c in by), value.alias("value")).filter("value IS NOT NULL")
    return rows.groupBy(*(named(c) for c in by)).agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def merged_cuts(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by``, ``n``, ``cut_no`` and ``cut`` of sketches merged over groups, days or files.

    The first and the last cut are the exact ends; the others lie within ``rank_error`` of their places.
    """
    merged = sketches.groupBy(*(named(c) for c in by or ())).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")).filter("n > 0")
    ranks = F.array(*(F.lit(p) for p in QUARTILES))
    cuts = F.posexplode(F.kll_sketch_get_quantile_double("sketch", ranks))
    told = merged.select(*(named(c) for c in by or ()), "n", cuts.alias("place", "cut"))
    return told.select(*(named(c) for c in by or ()), "n", (F.col("place") + 1).alias("cut_no"), "cut")


def quartile_cuts_frame(df: DataFrame, name: str) -> DataFrame:
    """The cut points as rows: ``cut_no``, ``cut`` and the distinct count."""
    found = quartile_cuts(df, name)
    rows = [(i + 1, cut, found.n_distinct) for i, cut in enumerate(found.cuts)]
    return df.sparkSession.createDataFrame(rows, "cut_no int, cut double, n_distinct bigint")


def bin_number(value: Column, cuts: QuartileCuts) -> Column:
    """1 for the lowest bin; bins hold their lower edge and the last one both edges."""
    number = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, cut in enumerate(cuts.cuts[1:-1], 1):
        number = number.when(value < cut, i)
    return number.otherwise(len(cuts.cuts) - 1)


def quartile_bins(df: DataFrame, name: str, cuts: QuartileCuts | None = None, many: int = MANY_VALUES) -> DataFrame:
    """Add ``<name>_quartile``, with the bin label, or the value as text when not binned.

    A numeric column is binned when it has more than ``many`` distinct values and at least three
    distinct cut points. Adds ``<name>_bin`` with the bin number, null when not binned.
    """
    label, number = as_text(df, name), F.lit(None).cast("int")
    if isinstance(type_of(df, name), T.NumericType):
        cuts = cuts or quartile_cuts(df, name)
        if cuts.usable(many):
            number = bin_number(column(df, name).cast("double"), cuts)
            texts = F.array(*(F.lit(t) for t in cuts.labels))
            label = F.when(number.isNotNull(), F.element_at(texts, number))
    return df.withColumns({f"{name}_bin": number, f"{name}_quartile": label})


def covariate_levels(df: DataFrame, name: str) -> DataFrame:
    """The distinct labels of a column with their order and the kind of scale they call for.

    ``continuous`` when there are more than 15 and all look like numbers, ``qualitative`` up
    to 12, else ``sequential``.
    """
    levels = df.select(as_text(df, name).alias("level")).filter("level IS NOT NULL").distinct()
    ordered = dense_order(levels, [F.col("level")], "level_index")
    facts = ordered.agg(
        F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("level").rlike(NUMBER_LEVEL)), F.lit(True)).alias("numbers")
    )
    kind = (
        F.when(F.col("numbers") & (F.col("n") > MANY_VALUES), "continuous")
        .when(F.col("n") <= QUALITATIVE_LEVELS, "qualitative")
        .otherwise("sequential")
    )
    return ordered.withColumn("scale_kind", facts.select(kind).scalar())
