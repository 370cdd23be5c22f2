"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tideline.llm import (
    alignment, bpe, embeddings, fill_in_middle, language_id, language_model, licences, packing, pages, quality, simhash,
    topk, toxicity,
)
from tideline.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.decisions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents")).drop("group")


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def language_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    return language_id.predictions(docs, language_id.fit(docs, ~held_out), held_out)


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.held_out_scores(table(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def fill_in_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.link_statistics(table(spark, sf_dir, "documents"), *paths)


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {
    "op1_exact_top_k": exact_top_k,
    "op2_license_scans": license_scans,
    "op3_best_fit_packing": best_fit_packing,
    "op4_quality_classifier": quality_classifier,
    "op5_simhash_near_dedup": simhash_near_dedup,
    "op6_embedding_near_dedup": embedding_near_dedup,
    "op7_toxicity": toxicity_scores,
    "op8_language_id": language_predictions,
    "op9_lm_scoring": lm_scoring,
    "op10_byte_bpe": byte_bpe,
    "op11_fill_in_middle": fill_in_middles,
    "op12_cross_tokenizer_alignment": cross_tokenizer_alignment,
    "op13_html_extraction": html_extraction,
    "pipeline": corpus_pipeline.run,
}

#: Integer inner products of all pairs of a query and another row.
TOP_K_SQL = """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS q
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.r AS query, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score, b.r
        FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id, r) AS rank FROM scored)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE: dict[str, str] = {"op1_exact_top_k": TOP_K_SQL, "op2_license_scans": licences.scan_sql(), "op11_fill_in_middle": fill_in_middle.sql()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
