"""The registered queries of the subpackage and their SQL where SQL can express them."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlane.llm.bpe import bpe_round_trip
from cohortlane.llm.centroids import centroid_clusters
from cohortlane.llm.context_tree import context_tree_scores
from cohortlane.llm.exact_dedup import exact_groups
from cohortlane.llm.fingerprints import fingerprints
from cohortlane.llm.jaccard_join import jaccard_components
from cohortlane.llm.language_id import language_id
from cohortlane.llm.line_dedup import line_dedup
from cohortlane.llm.packing import pack_documents
from cohortlane.llm.quality import quality_scores
from cohortlane.llm.resampling import importance_resample
from cohortlane.llm.sharding import write_shards
from cohortlane.llm.token_counts import token_counts


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_round_trip(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(documents(spark, folder))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(documents(spark, folder), keep="max")


def added_tokens(path: str) -> dict[str, int]:
    """The tokens that a vocabulary file declares beside its merges and finds in texts as they are."""
    with open(path, encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


#: Of the file whose ids are packed.
SPECIALS = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def packed(docs: DataFrame) -> DataFrame:
    """The ids of byte_bpe_50k.json: its vocabulary is that of the rank file, with its added tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIALS)


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(documents(spark, folder))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op6_prefix_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(documents(spark, folder))


def op7_language_codes(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(documents(spark, folder))


def op8_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree_scores(documents(spark, folder))


def op9_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """The law is ``key``: document id and number of shards decide."""
    shards = write_shards(documents(spark, folder))
    return shards.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup(documents(spark, folder), keep="none")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(table(spark, folder, "embeddings"))


def op12_quality_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(documents(spark, folder), table(spark, folder, "labels"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resample(documents(spark, folder), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_token_counts": op5_token_counts,
    "op6_prefix_fingerprints": op6_prefix_fingerprints,
    "op7_language_codes": op7_language_codes,
    "op8_context_tree": op8_context_tree,
    "op9_external_shuffle": op9_external_shuffle,
    "op10_line_dedup": op10_line_dedup,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_quality_discriminant": op12_quality_discriminant,
    "op13_importance_resampling": op13_importance_resampling,
}

def cluster_rounds(rounds: int = 10) -> str:
    """Rounds of nearest centroid and floored mean, one after the other, on components as rows."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        near{i} AS MATERIALIZED (
            SELECT vec_id, cluster, distance FROM (
                SELECT vec_id, cluster, CAST(sum((f.x - c.x) * (f.x - c.x)) AS BIGINT) AS distance
                FROM components f JOIN centroids{i} c USING (place) GROUP BY vec_id, cluster
            ) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
        )""")
        if i < rounds:
            steps.append(f"""
        centroids{i + 1} AS MATERIALIZED (
            SELECT c.cluster, c.place, coalesce(m.x, c.x) AS x FROM centroids{i} c LEFT JOIN (
                SELECT cluster, place, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
                FROM components JOIN near{i} USING (vec_id) GROUP BY cluster, place
            ) m USING (cluster, place)
        )""")
    return ",".join(steps)


ORACLE: dict[str, str] = {
    "op3_exact_dedup": """
        WITH keyed AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
            FROM documents
        ), grouped AS (
            SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM keyed GROUP BY body
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
        FROM keyed JOIN grouped USING (body)
    """,
    "op10_line_dedup": """
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
            FROM documents
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
            FROM lines
        ), shared AS (
            SELECT line_key FROM keyed WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10
        ), marked AS (
            SELECT doc_id, line, place, line_key IN (SELECT line_key FROM shared) AS dropped FROM keyed
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op11_centroid_clusters": f"""
        WITH kept AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), components AS MATERIALIZED (
            SELECT vec_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS place FROM kept
        ), centroids0 AS MATERIALIZED (
            SELECT cluster, place, x FROM components JOIN (
                SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < 8
            ) USING (vec_id)
        ),{cluster_rounds()}, named AS (
            SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM centroids10 GROUP BY cluster
        )
        SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM near10 JOIN named USING (cluster)
    """,
    "op13_importance_resampling": """
        WITH crc_table AS MATERIALIZED (
            SELECT list(code ORDER BY i) AS codes FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, bit: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS code
                FROM range(256) t(i)
            )
        ), words AS MATERIALIZED (
            SELECT kind, id, unnest(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'
            )) AS word
            FROM (SELECT 's' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)
        ), bytes AS (
            SELECT word, list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes
            FROM (SELECT DISTINCT word FROM words)
        ), hashed AS MATERIALIZED (
            SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, codes[xor(c, b) % 256 + 1]))) % 10000 AS bucket
            FROM bytes, crc_table
        ), counted AS (
            SELECT bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM words JOIN hashed USING (word) GROUP BY bucket
        ), gained AS (
            SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + 10000.0::DOUBLE)
                / ((s + 1.0::DOUBLE) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM counted
        ), weighed AS (
            SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight
            FROM words JOIN hashed USING (word) JOIN gained USING (bucket) WHERE kind = 's' GROUP BY id
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
                (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
            FROM documents LEFT JOIN weighed ON id = doc_id
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
        )
        SELECT doc_id, n_features, weight, score,
            CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)
    """,
}
