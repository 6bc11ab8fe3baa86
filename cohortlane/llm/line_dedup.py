"""Lines that many documents share, found on range-partitioned hashes and dropped by bitmap.

Occurrences (hash, document, position) are dealt to ranges of (hash, document), sorted by hash,
document and position, and streamed: the positions of a hash in one row fold to one record that
begins with the first occurrence, which ``keep="first"`` lets stand. A hash that very many documents
hold lies in several ranges, and only one partial count per range and hash goes on; its records are
cut into even slices where they meet the hashes that go. What comes back to the rows is no text but
one compressed bitmap each: a mask per 64 lines, kept only where a line goes. A row is known by its
document key and a hash of its text, so rows that share a key but not a text have bitmaps of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlane.llm.frames import ASCII_SPACE, ascii_lower
from cohortlane.operators.attach import attach
from cohortlane.session import written

WORD = 64


def lines_of(text: Column) -> Column:
    """The lines between newlines; null and empty texts are one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.btrim(line, F.lit(ASCII_SPACE))


def occurrences(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """``doc``, ``body``, ``h1``, ``h2``, ``positions``: where each row holds each line, first place first.

    ``body`` is the hash of the row's text. The hashes are written before they are dealt, since the
    ranges are drawn from a sample and each text would be split for that as well.
    """
    whole = F.col(f"`{text}`").cast("string")
    keys = F.transform(lines_of(ascii_lower(whole)), line_key)
    each = df.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("body"), F.posexplode(keys).alias("position", "line")).filter(F.char_length("line") >= min_chars)
    hashed = written(each.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "doc", "body", "position"), "hashes")
    order = ["h1", "h2", "doc", "body"]
    dealt = hashed.repartitionByRange(*order).sortWithinPartitions(*order, "position")
    return written(dealt.groupBy(*order).agg(F.sort_array(F.collect_set("position")).alias("positions")), "occurrences")


def shared_lines(held: DataFrame, min_docs: int) -> DataFrame:
    """Hashes in at least ``min_docs`` documents, with the number of their records and their first row and place."""
    first = F.min(F.struct("doc", "body", F.col("positions")[0].alias("position"))).alias("first")
    by_doc = held.groupBy("h1", "h2", "doc").agg(F.count("*").alias("n_rows"), first)
    shared = by_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.sum("n_rows").alias("n_rows"), F.min("first").alias("first"))
    return written(shared.filter(F.col("n_docs") >= min_docs).drop("n_docs"), "shared")


def keep_bitmaps(held: DataFrame, dropped: DataFrame, keep: str) -> DataFrame:
    """``doc``, ``body``, ``n_dropped`` and ``bitmap``: (word, mask of kept lines) where a line of the word goes."""
    found = attach(held, dropped, ["h1", "h2"], "n_rows", [F.col("doc"), F.col("body")], "inner")
    places = found.select("doc", "body", "first", F.explode("positions").alias("position"))
    if keep == "first":
        stays = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("body") == F.col("first.body")) & (F.col("position") == F.col("first.position"))
        places = places.filter(~stays)
    words = places.groupBy("doc", "body", F.floor(F.col("position") / WORD).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, position % {WORD})")).alias("gone")
    )
    return words.groupBy("doc", "body").agg(
        F.sum(F.bit_count("gone")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("kept")))).alias("bitmap"),
    )


def kept_text(lines: Column, bitmap: Column) -> Column:
    """The lines whose bit is set, joined by newlines; without a bitmap all of them.

    The sparse bitmap is laid out once per document as one mask per 64 lines, so each line is one lookup.
    """
    masks = F.map_from_entries(bitmap)
    every = F.transform(F.sequence(F.lit(0), F.floor(F.size(lines) / WORD).cast("int")), lambda w: F.coalesce(F.try_element_at(masks, w), F.lit(-1)))
    spread = F.transform(F.array(every), lambda m: F.filter(lines, lambda line, i: stands(m, i)))[0]
    return F.when(bitmap.isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(spread, "\n"))


def stands(masks: Column, i: Column) -> Column:
    mask = F.get(masks, F.floor(i / WORD).cast("int"))
    return F.call_function("shiftright", mask, (i % WORD).cast("int")).bitwiseAND(F.lit(1)) == 1


def line_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """``key``, ``n_lines``, ``n_dropped``, ``kept_text`` of every document.

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of
    ``min_chars`` code points or more that ``min_docs`` documents hold lose all their lines in every
    document; with ``keep="first"`` the first line of the smallest document key, null before all
    others, stays. Null and empty texts are one empty line, which stays, since it has no code points.
    Rows with the same document key count as one document, null keys too; each loses the lines of
    its own text. An empty table gives no rows; other columns are not read.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep}")
    held = occurrences(df, key, text, min_chars)
    maps = keep_bitmaps(held, shared_lines(held, min_docs), keep).withColumnsRenamed({"doc": "map_doc", "body": "map_body"})
    whole = F.col(f"`{text}`").cast("string")
    docs = df.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(whole).alias("body"), whole.alias("whole"))
    lines = lines_of(F.col("whole"))
    same = docs["doc"].eqNullSafe(maps["map_doc"]) & (docs["body"] == maps["map_body"])
    return docs.join(maps, same, "left").select(
        F.col("doc").alias(key),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        kept_text(lines, F.col("bitmap")).alias("kept_text"),
    )
