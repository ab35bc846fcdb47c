"""Queries ``op1_`` to ``op13_`` over whole tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodemark.llm import embed, merkle, quality
from lodemark.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.embed import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.mixing import mix_positions

    return mix_positions(table(spark, sf_dir, "documents"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.pii import surrogates

    return surrogates(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.tokens import counts_with_edits

    return counts_with_edits(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.spm import sample_encodings

    return sample_encodings(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.simhash import fingerprint_documents

    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.align import align

    return align(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodemark.llm.merkle import prove

    return prove(table(spark, sf_dir, "documents"))


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _shipped(f)
    for f in (
        op1_quality_rules,
        op2_embedding_near_dedup,
        op3_mix_sources,
        op4_pii_surrogates,
        op5_substring_dedup,
        op6_html_extraction,
        op7_warc,
        op8_token_counts,
        op9_sentencepiece,
        op10_minhash_near_dedup,
        op11_simhash_fingerprints,
        op12_token_alignment,
        op13_merkle_manifest,
    )
}

ORACLE: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE_SQL,
    "op2_embedding_near_dedup": embed.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
