"""Corpus pipeline: five stages over documents, each written as Parquet and read again.

Language ID drops documents without a letter and those whose best language is hardly likelier than
chance (with one learned language or none there is no such cut), SimHash near-dedup keeps one document of
each group, decontamination drops documents that contain a benchmark item, PII masks personal
data, and packing deals the rest into sequences. All but the last return the columns of
documents.

Edge cases, in every stage as in the operator it calls: a document whose text is null or has no
letter is rejected by the first stage; null doc_id, lang and source pass; very long texts are
whole rows; of repeated rows, and of documents that tie, near-dedup keeps one (the least doc_id,
then the least hash of the text); empty tables give no rows; further columns of documents, whatever
their names, are carried to the last stage. What a stage wrote is read by the next and goes when
the application ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import decontaminate, language, packing, pii, simhash
from deltaloom.llm._common import materialise, table

#: A document is rejected whose best language covers less than this share of the way from chance to
#: certainty: with four languages 0.3.
OVER_CHANCE = 1 / 15


def least_score(labels: int) -> float:
    """The score that a document needs: chance + ``OVER_CHANCE`` * (1 - chance); none below two languages."""
    return 1 / labels + OVER_CHANCE * (1 - 1 / labels) if labels > 1 else 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    return language.accepted(docs, model, least_score(len(model.labels) if model else 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", mask_pii),
    ("best_fit_packing", pack),
]

#: Trained, tokenised and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
