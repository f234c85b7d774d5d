"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyq.llm import fill_in_middle, merkle, oracles, substrings
from canopyq.llm.bpe import bpe_round_trip
from canopyq.llm.hamming import sign_codes, top_k
from canopyq.llm.jaccard import jaccard_join
from canopyq.llm.licenses import scan_licences
from canopyq.llm.packing import pack_documents
from canopyq.llm.quality import quality
from canopyq.llm.repetition import repetition_rules
from canopyq.llm.secrets import labelled_findings, learned_language, secret_findings, train_forest
from canopyq.llm.token_counts import edited_token_counts
from canopyq.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, findings = table(spark, sf_dir, "documents"), labelled_findings(spark)
    return secret_findings(docs, train_forest(findings, language=learned_language(docs, findings)))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return top_k(codes, codes.where("vec_id % 50 = 0"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_token_counts(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and rearranged; digests of its output and of the text rebuilt from it."""
    return fill_in_middle.digests(fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words removed that 13-word windows of earlier documents cover."""
    return substrings.digests(substrings.without_repeats(table(spark, sf_dir, "documents")))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and the root of its version, in which some leaves are tampered with."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    return merkle.digests(merkle.manifest(docs, changes={"n_chars": F.when(tampered, docs["n_chars"] + 1).otherwise(docs["n_chars"])}))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_license_scans": op3_license_scans,
    "op4_quality_rules": op4_quality_rules,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_secret_scans": op8_secret_scans,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_token_counts": op10_token_counts,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {"op11_fill_in_middle": oracles.FILL_IN_MIDDLE, "op12_substring_dedup": oracles.SUBSTRING_DEDUP, "op13_merkle_manifest": oracles.MERKLE_MANIFEST}
