"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from armwise.llm import annulus, embedding_dedup, mixing, ngram_join, piece_codec, quality_classifier, quality_rules, secrets, sharding, token_files, toxicity, vector_codes, warc


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file, which every machine has."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_piece_codec(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), model or vocabulary("piece_bpe_32k.model"))


def op6_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer or vocabulary("word_bpe_49k.json"), end_id=2)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), weights=[1.0] * 8, grown=[1.0] * 9)


def op9_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture_slot")


def op11_annulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annulus.cluster(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_join, op2_quality_classifier, op3_pivot_index, op4_toxicity, op5_piece_codec, op6_token_files, op7_quality_rules, op8_rendezvous_shards, op9_cube_mix, op10_warc, op11_annulus, op12_vector_codes, op13_secrets)}

ORACLE_SQL: dict[str, str] = {"op1_ngram_join": ngram_join.join_sql(), "op7_quality_rules": quality_rules.rules_sql(), "op10_warc": warc.archive_sql(), "op11_annulus": annulus.cluster_sql(), "op12_vector_codes": vector_codes.encode_sql()}
