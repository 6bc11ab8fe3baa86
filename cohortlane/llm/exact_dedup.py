"""Exact duplicates by 128-bit content hash, with the bytes compared inside every group.

Rows fold to one small row per hash before any text moves, so a group of any size is combined
where its rows lie. Only rows of groups with several members bring their text along again, spread
by row key. Their smallest and largest text per hash are found with a combine before the shuffle:
the two are the same bytes exactly if all texts of the group are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.functions.times import own_prefix
from cohortlane.llm.frames import ascii_lower
from cohortlane.session import written


def content_hash(body: Column) -> Column:
    """128 bits of the normalised text."""
    return F.md5(body)


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max", normalise=ascii_lower) -> DataFrame:
    """``key``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of every row.

    Texts are equal when their normalised bytes are; null counts as empty. The row with the
    largest (``keep="max"``) or smallest key of a group stays; among rows with the same key and
    text each is marked as staying. Rows with a null key belong to their group, and stay only if
    all its keys are null. An empty table gives no rows; other columns are not read.
    """
    best = F.max if keep == "max" else F.min
    plain = df.select(F.col(f"`{key}`").alias("id"), normalise(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))).alias("body"))
    hashed = written(plain.select("id", content_hash(F.col("body")).alias("hash"), F.sha2("body", 256).alias("text_sha256")), "hashed")
    groups = hashed.groupBy("hash").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
    several = written(groups.filter("group_size > 1").select("hash", "keep_id", "group_size"), "several")
    members = hashed.join(several, "hash", "left_semi")
    collided = written(colliding(plain, members), "collided")
    if collided.isEmpty():
        keyed = hashed.join(several, "hash", "left")
    else:  # the same hash with other bytes: there the text itself is the key
        bodies = plain.withColumn("hash", content_hash(F.col("body"))).join(collided, "hash", "left_semi")
        exact = bodies.groupBy("hash", "body").agg(best("id").alias("keep_id"), F.count("*").alias("group_size"))
        told = exact.select("hash", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
        sound = several.join(collided, "hash", "left_anti")
        keyed = (
            hashed.join(collided, "hash", "left_anti").join(sound, "hash", "left")
            .unionByName(hashed.join(collided, "hash", "left_semi").join(told, ["hash", "text_sha256"]))
        )
    keep_id = F.coalesce("keep_id", "id")
    return keyed.select(
        F.col("id").alias(key),
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"),
        "text_sha256",
    )


def colliding(plain: DataFrame, members: DataFrame) -> DataFrame:
    """Hashes of ``members`` under which not all texts are byte for byte the same."""
    asked = members.select(F.col("id").alias("asked"))
    bodies = plain.join(asked, plain["id"].eqNullSafe(asked["asked"]), "left_semi")
    ends = bodies.groupBy(content_hash(F.col("body")).alias("hash")).agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return ends.filter("low <> high").select("hash")


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whose names are free.

    Of rows alike in key and text, one stays. Key and text hash are one tag, so the rows are
    shuffled once, by it, both for the join and for picking one of its rows.
    """
    own = own_prefix(docs)
    tag = own + "tag"

    def tagged(key_column: Column, sha: Column) -> Column:
        return F.sha2(F.concat_ws("/", sha, key_column.cast("string")), 256).alias(tag)

    groups = exact_groups(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("body")), "key", "body", keep)
    stay = groups.filter("kept").select(tagged(F.col("key"), F.col("text_sha256"))).distinct()
    body = ascii_lower(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    marked = docs.withColumn(tag, tagged(F.col(f"`{key}`"), F.sha2(body, 256)))
    return marked.join(stay, tag, "left_semi").dropDuplicates([tag]).select(*(F.col(f"`{c}`") for c in docs.columns))
