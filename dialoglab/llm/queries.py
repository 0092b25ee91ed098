"""Queries of this subpackage: thin digests of the operators' results, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bag_search, bpe, exact_dedup, hard_negatives, license_scan, line_dedup, mixing, ngram_join, pivot_search, quality, sharding,
               token_count, token_files)
from .common import documents


def op1_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.kd_shards(documents(spark, sf_dir), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op2_cuckoo_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_divide_skip_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.jaccard_groups(documents(spark, sf_dir), n=3, num=90, den=100)
    return out.drop("name", "text_hash")


def op4_license_paragraph_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(documents(spark, sf_dir))


def op5_perfect_hash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(documents(spark, sf_dir), min_docs=10, min_chars=1)


def op6_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return bpe.digest(bpe.encode_documents(documents(spark, sf_dir), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN))


def op7_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(documents(spark, sf_dir))


def op8_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return token_files.round_trip(documents(spark, sf_dir), vocab.path("byte_bpe_50k.json"))


def op9_rank_synchronous_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocab

    return token_count.count_tokens(documents(spark, sf_dir), vocab.path("piece_bpe_32k.model"), limit=4096)


def op10_hypergeometric_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir)).drop("shards")


def op11_coordinate_pruned_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", noisy))


def op12_bag_dedup_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op13_pivot_distance_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=10, every=100, scale=1024)


QUERIES = {f.__name__: f for f in (
    op1_kd_tree_sharding, op2_cuckoo_exact_dedup, op3_divide_skip_jaccard_join, op4_license_paragraph_classifier,
    op5_perfect_hash_line_dedup, op6_segment_tree_bpe, op7_adaptive_quality_rules, op8_rans_token_files, op9_rank_synchronous_token_counts,
    op10_hypergeometric_mixing, op11_coordinate_pruned_negatives, op12_bag_dedup_lexical_search, op13_pivot_distance_top_k,
)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE = {
    "op2_cuckoo_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t,
                 sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', '', 'g')) AS text_sha256 FROM documents
        ), g AS (
          SELECT text_sha256, count(*) AS group_size,
                 first(doc_id ORDER BY length(t) DESC, doc_id NULLS LAST) AS keep_id FROM d GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)
    """,
    "op5_perfect_hash_line_dedup": r"""
        WITH l AS (
          SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), x AS (
          SELECT r, unnest(range(1, len(lines) + 1)) AS k, unnest(lines) AS line FROM l
        ), y AS (
          SELECT r, k, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x
        ), c AS (
          SELECT key FROM y WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
        ), z AS (
          SELECT r, count(c.key) AS n_dropped, string_agg(line, chr(10) ORDER BY k) FILTER (WHERE c.key IS NULL) AS kept
          FROM y LEFT JOIN c USING (key) GROUP BY r
        )
        SELECT doc_id, len(lines) AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM l JOIN z USING (r)
    """,
    "op11_coordinate_pruned_negatives": r"""
        WITH e AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
          FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
          SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
          FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
        ), p AS (
          SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
               row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10
    """,
    "op12_bag_dedup_lexical_search": r"""
        WITH d AS (
          SELECT row_number() OVER () AS r, doc_id,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents
        ), c AS (
          SELECT count(*) FILTER (WHERE len(words) > 0) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d
        ), t AS (
          SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) GROUP BY r, term
        ), w AS (
          SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, n_docs
        ), i AS (
          SELECT item_id, term, count(*) AS times FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
          GROUP BY item_id, term
        ), s AS (
          SELECT item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(words) * n_docs) // n_terms))))::BIGINT AS score
          FROM i JOIN w USING (term) JOIN t USING (term) JOIN d USING (r), c GROUP BY item_id, r
        )
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
        FROM s JOIN d USING (r) WHERE score > 0 QUALIFY rank <= 10
    """,
    "op13_pivot_distance_top_k": r"""
        WITH e AS (
          SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
          SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(q.v, e.v)::BIGINT AS score
          FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id
        )
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 10
    """,
}
