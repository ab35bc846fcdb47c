"""Cleaning of a text corpus in stages; each stage takes the documents that its predecessor kept.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodemark.llm import minhash, mixing, pii, quality, spm
from lodemark.session import cut, discard, ship


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """``row`` with all columns of ``docs``, beside those that an operator reads: no name can clash with its own."""
    return docs.select(F.struct("*").alias("row"), *columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    return quality.judge(_packed(docs, "text")).where("kept").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id. Rows that repeat a doc_id stay once for each row."""
    ship(spark)
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = _packed(docs)
    return rows.join(kept, F.col("row.doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets; n_chars follows the new text."""
    ship(spark)
    out = pii.pseudonymize(_packed(docs, "text"), pii.QUERY_KEY)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


#: Key of doc_id's metadata under which a mixed table says where the positions of its rows lie.
MIX = "lodemark.mix"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source needed) with both as strings that are never null."""
    told = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return docs.withColumns({"i_": told("doc_id"), "s_": told("source")})


def _nth(*order: str) -> Column:
    """Number of a row among those of its doc_id and source."""
    return F.row_number().over(Window.partitionBy("i_", "s_").orderBy(*order)).alias("k_")


def _placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, text needed) with their position among ``places``, range by range of it."""
    rows, on = _keyed(rows), ["i_", "s_"]
    if not places.where("k_ > 1").isEmpty():  # only then does the place among rows of one doc_id matter
        rows, on = rows.select("*", _nth("text")), [*on, "k_"]
    return rows.join(places, on, "left").repartitionByRange("position").sortWithinPartitions("position")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, range by range of positions.

    Files that are read again come in any order, and the columns stay those of documents. So the positions
    are written beside them, and the metadata of doc_id say where: they stay with a table that is written.
    """
    ship(spark)
    mixed = _keyed(mixing.mix(docs.select("doc_id", "source"))).select("i_", "s_", _nth("position"), "position")
    places = cut(mixed)
    out = _placed(_packed(docs, "doc_id", "source", "text"), places).select("row.*")
    return out.withMetadata("doc_id", {**docs.schema["doc_id"].metadata, MIX: places._lodemark_path})


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled encodings of each document: doc_id, sample, n_best, n_pieces, inclusion, ids_sha256, decoded and position.

    Rows are in the order of the mix that ``mixing_stage`` made, range by range; documents that were never mixed have no position.
    """
    ship(spark)
    path = docs.schema["doc_id"].metadata.get(MIX)
    rows = docs.select("doc_id", "text", "source")
    if path is None:
        mixed = rows.withColumn("position", F.lit(None).cast("long"))
    else:
        mixed = _placed(rows, spark.read.parquet(path))
    out = spm.sample_encodings(mixed.select("doc_id", "text", "position"), with_ids=False, carry=("position",))
    return out.select("doc_id", "sample", "n_best", "n_pieces", F.round("inclusion", 6).alias("inclusion"), "ids_sha256", "decoded", "position")


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mix_sources", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: Connected components over sampled signatures and Gumbel draws have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written out and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs, old = cut(stage(spark, docs, sf_dir)), docs
        discard(old)
    return STAGES[-1][1](spark, docs, sf_dir)
