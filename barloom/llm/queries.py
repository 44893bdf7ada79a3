"""The operators over the warehouse tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import divergence, embeddings, language, lines, mixing, negatives, packing, pieces, quality, simhash, syncmers, toxicity, urls
from barloom.llm.common import fold, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 5) == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), model_file or public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) == 1)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold("doc_id", 4) == 2)
    return found.select("doc_id", f"{name}.held_out", f"{name}.lang_pred", f"{name}.score", f"{name}.accepted")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_removed, n_words, kept_sha256): the deleted spans, and the text that is left, its words and digest."""
    found, spans = lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.greatest(F.size(spans), F.lit(0)).cast("long").alias("n_removed"), mixing.size_of(F.col("text")).alias("n_words"), F.sha2("text", 256).alias("kept_sha256"))


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str, tokenizer_file: str | None = None) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_file or public_tokenizers.path("word_bpe_49k.json"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; every seventh vec_id has its label moved on, as the query's contract says."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_embedding_near_dedup, op3_toxicity, op4_mixing, op5_sentencepiece,
    op6_quality, op7_language, op8_line_dedup, op9_syncmer_fingerprints, op10_url_filter,
    op11_best_fit_packing, op12_source_divergence, op13_hard_negatives,
)}
ORACLE = {"op4_mixing": mixing.SQL, "op12_source_divergence": divergence.SQL, "op13_hard_negatives": negatives.SQL}
