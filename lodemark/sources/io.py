"""Readers and writers of records: JSON documents, CSV exports, snapshots by run."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON document or a folder of them; without a schema it is inferred."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested values as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """A snapshot of one run: only its partition is replaced."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def footprint(spark: SparkSession, path: str) -> DataFrame:
    """Bytes and files below a path, by folder, from file metadata alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def annotate(records: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Annotations of a pluggable provider over Arrow batches; ``provider`` maps a batch of records to rows of ``schema``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield provider(batch)

    return records.mapInPandas(run, schema)


def annotate_missing(records: DataFrame, cache: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "fingerprint") -> DataFrame:
    """Annotations from the cache where it has the fingerprint, from the provider elsewhere; ``schema`` holds the key."""
    missing = records.join(cache.select(key), key, "left_anti")
    return cache.join(records.select(key).distinct(), key, "left_semi").unionByName(annotate(missing, provider, schema))


def run_catalog(spark: SparkSession, path: str, plans: DataFrame, newest: int = 100) -> DataFrame:
    """(run_id, n_files, bytes, modified, n_rows, place and the columns of ``plans``) of the newest runs below ``path``.

    Runs are folders run_id=... as ``write_run`` makes them; ``plans`` has one row a run_id. Sizes and times come
    from the file system, row counts from the footers: no column is read. Newest by the run's id.
    """
    of = F.regexp_extract("path", r"/run_id=([^/]*)/", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    sizes = files.groupBy(of.alias("run_id")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))
    rows = spark.read.option("basePath", path).option("recursiveFileLookup", False).parquet(path).groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    found = sizes.join(rows, "run_id").join(plans, "run_id", "left").orderBy(F.col("run_id").desc()).limit(newest)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.col("run_id").desc())).cast("long"))  # a window over the newest ones
