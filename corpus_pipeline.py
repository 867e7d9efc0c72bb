"""From raw documents to packed training sequences, one operator a stage.

Edge cases: a null, empty or blank text fails the quality rules and goes. Very long texts are read whole by every
stage. Of repeated rows one stays, whatever their ids; rows may share an id or have none, and each text that stays
is packed under its own id. Ties between copies go by doc_id, then text hash. Null values in other columns, and
extra columns of whatever name, pass through the first four stages unchanged. Without labels of both classes the
classifier rejects nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import common, packing, pii, quality_cnn, quality_rules, simhash

#: The encoder's cache of parts in the last stage, a quarter of the default: workers still hold what earlier stages loaded.
GENERATION = 60_000
#: Texts whose sets of 5-word shingles have this Jaccard similarity are near copies.
SIMILARITY = 0.8


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network accepts; it is fitted on the labelled rows of ``docs``."""
    return quality_cnn.keep(docs, quality_cnn.train(docs, common.table(spark, sf_dir, "labels")))


def quality_cascade(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash within its radius, or 5-word shingles at ``SIMILARITY`` or more."""
    return simhash.keep_one(docs, similarity=SIMILARITY)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and disclosing terms replaced in their texts."""
    return pii.sanitise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True, generation=GENERATION)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_cascade),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, fingerprints and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole table; each result is stored in the shared folder and freed after its use."""
    docs = common.table(spark, sf_dir, "documents")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            stored = common.Stored(docs)
            docs = stored.df
            if before:
                before.free()
            before = stored
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query: :func:`sequences` with the digests of the pieces instead of their ids."""
    return sequences(spark, sf_dir).drop("ids")
