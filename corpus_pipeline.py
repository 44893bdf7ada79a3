"""A training corpus from the documents: language, line dedup, near-dedup, mix, tokens.

Every stage takes (spark, docs, sf_dir) and works on all that the one before
kept; ``run`` writes each result to the shared folder and reads it again. The
columns of ``docs`` come along under any names; doc_id, text, lang and source are
looked at. Every stage takes an empty table and gives one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import language, lines, mixing, pieces, shingles
from barloom.llm.common import fold, stored, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected ones, null texts and texts without letters among them, go."""
    found, name = language.identify(docs, fold("doc_id", 4) == 2)
    return found.where(F.col(name)["accepted"]).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; a document of which nothing is left goes, untouched ones stay, null texts too.

    Rows with one doc_id are not compared with each other; repeated rows lose the same.
    """
    found, spans = lines.deduplicated(docs)
    found = found.where(spans.isNull() | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(spans.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return found.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

    Equal texts, null ones as empty, are one group, so of repeated rows one stays.
    """
    return shingles.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a null source is a source, rows with one doc_id are taken together, texts without words cost nothing."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests, a row for each row of the mix; a null text counts as empty."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", identify), ("line_dedup", dedup_lines), ("simhash_near_dedup", dedup_near), ("mixing", mix_sources), ("sentencepiece", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents.

    Null and letterless texts go in the first stage; rows without doc_id go
    through all stages, but line dedup leaves their texts as they are.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # fingerprints, alignment and centroids are beyond SQL; tests hold the stages against brute force
