"""From raw documents to token ids: classify, remove near duplicates and benchmark passages, redact, encode.

Each stage takes (spark, docs, sf_dir) and gives the rows that it keeps with the columns of documents; the last gives token ids.
Stages treat null texts as empty ones, take texts of any length whole, keep columns they don't know, and give an empty result for an
empty table. Rows that repeat an id are judged by their own texts, but go or stay together in the stages on pairs; of near duplicates the
smallest id stays, and rows without an id stay in every stage on pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import bpe, decontam, lsh_forest, pii, weak_label
from orrery.llm.common import discard, materialise, scratch, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label scorers find good."""
    return weak_label.keep(docs, weak_label.fit(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates (5-word shingles, similarity 0.8)."""
    return lsh_forest.deduplicate(docs, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, and the text decoded from them."""
    return bpe.encode(docs)


STAGES = [("quality_classifier", classify), ("near_dedup", deduplicate), ("decontamination", decontaminate), ("pii", redact), ("bpe", encode)]

#: The stages (learned scorers, components, learned spans, merges) are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; what a stage wrote besides is deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            kept.add(name)
            before, docs = docs, materialise(stage(spark, docs, sf_dir), name)
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
