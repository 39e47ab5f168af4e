"""A corpus pipeline of five stages: two quality filters, near-duplicates, a mix of sources, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from armwise.llm import mixing, ngram_join, piece_codec, quality_classifier, quality_rules
from armwise.llm.common import written
from armwise.llm.queries import table, vocabulary


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def ruled(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.passing(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    return ngram_join.one_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and token ids, with their number, their CRC and the checks of parity and round trip."""
    return piece_codec.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality_classifier", classified), ("quality_rules", ruled), ("ngram_join", deduplicated), ("cube_mix", mixed), ("piece_codec", encoded)]

#: A fitted classifier and a seeded mix are outside SQL; the tests hold run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over all documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
