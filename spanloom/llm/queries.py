"""The registered queries of this subpackage, with production parameters, and their oracles where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, chains, codes, covertree, decontam, dialogues, lm, media, neardup, pii, suffix, tokens, toxicity
from .common import read_documents

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_documents(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_documents(spark, sf_dir))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item of which a document holds a passage."""
    return decontam.find_passages(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm.lm_scores(read_documents(spark, sf_dir))
    return scores.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.decode_digests(bpe.encode(read_documents(spark, sf_dir), path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a line break belongs to the line that it ends."""
    return tokens.section_tokens(read_documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.deduplicate(read_documents(spark, sf_dir)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.fuzzy_passages(read_documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_payloads(media.store_payloads(read_documents(spark, sf_dir)))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair_report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.similar_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_pii": op2_pii,
    "op3_decontamination": op3_decontamination,
    "op4_lm_scores": op4_lm_scores,
    "op5_bpe": op5_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_passages": op9_passages,
    "op10_media": op10_media,
    "op11_conversations": op11_conversations,
    "op12_vector_codes": op12_vector_codes,
    "op13_similar_vectors": op13_similar_vectors,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op4_lm_scores": lm.SQL, "op11_conversations": dialogues.SQL, "op12_vector_codes": codes.SQL, "op13_similar_vectors": covertree.SQL}
