"""Driver queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, licenses, minhash, packing, periodic_runs, pii, quality_cnn, quality_rules, simhash, syncmers, token_counts, url_filter, whitening
from codeloom.llm.common import table
from codeloom.llm.sql import ORACLE_SQL


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.production_rules(spark))
    return url_filter.contract(out)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_cnn.score(docs, quality_cnn.train(docs, table(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.collapse(periodic_runs.with_planted(table(spark, sf_dir, "documents"))))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def base_license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can express."""
    return op4_license_scans(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5 that SQL can express."""
    return op5_syncmer_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def vector_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op13 that SQL can express, a row for each vector."""
    return op13_embedding_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express."""
    return op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_token_counts,
        op3_best_fit_packing,
        op4_license_scans,
        op5_syncmer_fingerprints,
        op6_url_filters,
        op7_pii,
        op8_byte_bpe,
        op9_simhash,
        op10_quality_classifier,
        op11_periodic_runs,
        op12_minhash_dedup,
        op13_embedding_whitening,
        vector_deviations,
        base_license_places,
        edited_texts,
        base_personal_data,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
