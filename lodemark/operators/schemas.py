"""What raw rows hold: scalar paths to any of five levels, one schema for all rows, mappings held against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 5


def scalar_paths(df: DataFrame, raw: str, depth: int = DEPTH, carry: list[str] | None = None) -> DataFrame:
    """({carry}, path, value) of the scalars in a JSON text column, at most ``depth`` names deep; of a list its first element stands for it.

    Objects open level by level inside the row, without a shuffle; nulls, empty lists and what lies
    deeper give no row, and neither does text that is no JSON object.
    """
    carry = carry or []
    rows = df.select(*carry, F.try_parse_json(raw).alias("v"), F.lit("$").alias("path")).where(F.schema_of_variant("v").startswith("OBJECT"))
    for level in range(depth + 1):
        for _ in range(2):  # a list in a list counts as its first element, too
            kind = F.schema_of_variant("v")
            rows = rows.withColumn("v", F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$[0]", "variant")).otherwise(F.col("v")))
        is_object = F.schema_of_variant("v").startswith("OBJECT")
        if level == depth:
            return rows.where(~is_object).select(*carry, "path", F.try_variant_get("v", "$", "string").alias("value")).where("value IS NOT NULL")
        inside = F.try_variant_get("v", "$", "map<string,variant>")
        itself = F.create_map(F.lit(""), F.col("v"))
        rows = rows.select(*carry, "path", F.explode(F.when(is_object, inside).otherwise(itself)).alias("k", "v"))
        rows = rows.select(*carry, "v", F.when(F.col("k") == "", F.col("path")).otherwise(F.concat("path", F.lit("."), "k")).alias("path"))
    return rows


def schema_of(df: DataFrame, raw: str) -> DataFrame:
    """(schema): one type that holds all rows of a JSON text column, as text.

    Types merge by a lattice (whole numbers below decimals and doubles, objects field by field, the rest to
    VARIANT), so partial results combine in any order and only schemas travel.
    """
    return df.select(F.schema_of_variant_agg(F.try_parse_json(raw)).alias("schema"))


def paths_of(schema: DataFrame) -> DataFrame:
    """(path, type) of each field of a schema text, lists by their elements; one row in, a row a field out."""
    # OBJECT<a: T, b: OBJECT<...>>: names and types are split by depth, one level a round
    rows = schema.select(F.lit("$").alias("path"), F.col("schema").alias("type"))
    out = None
    for _ in range(DEPTH + 1):
        rows = rows.withColumn("type", F.regexp_replace("type", "^ARRAY<(.*)>$", "$1")).withColumn("type", F.regexp_replace("type", "^ARRAY<(.*)>$", "$1"))
        leaves = rows.where(~F.col("type").startswith("OBJECT<"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = F.regexp_extract("type", "^OBJECT<(.*)>$", 1)
        rows = rows.where(F.col("type").startswith("OBJECT<")).select("path", F.explode(_split_top(inner)).alias("f"))
        rows = rows.select(F.concat("path", F.lit("."), F.trim(F.regexp_extract("f", "^([^:]*):", 1))).alias("path"), F.trim(F.regexp_extract("f", "^[^:]*:(.*)$", 1)).alias("type"))
    return out.where("path <> '$'")


def _split_top(text: Column) -> Column:
    """The parts of a text at commas outside brackets."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("part"))

    def step(acc: Column, piece: Column) -> Column:
        part = F.when(acc["part"] == "", piece).otherwise(F.concat(acc["part"], F.lit(","), piece))
        whole = F.length(F.translate(part, "<(", "")) == F.length(F.translate(part, ">)", ""))
        return F.struct(F.when(whole, F.concat(acc["done"], F.array(part))).otherwise(acc["done"]).alias("done"), F.when(whole, F.lit("")).otherwise(part).alias("part"))

    return F.aggregate(F.split(text, ","), start, step, lambda acc: acc["done"])


def recover_mapping(paths: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """(field, path, type, status) of a mapping of fields to paths, held against (path, type).

    kept: the path is there. recovered: it is not, but another path ends in the same name (the shortest,
    then the first by text). missing: neither; path and type are null.
    """
    spark = paths.sparkSession
    wanted = spark.createDataFrame(list(mapping.items()), "field string, asked string").withColumn("name", F.element_at(F.split("asked", r"\."), -1))
    there = paths.select("path", "type", F.element_at(F.split("path", r"\."), -1).alias("name"))
    found = wanted.join(there, "name", "left").withColumn("same", F.coalesce(F.col("path") == F.col("asked"), F.lit(False)))
    best = found.groupBy("field").agg(F.min(F.struct((~F.col("same")).alias("other"), F.length("path").alias("n"), "path", "type")).alias("b"), F.count("path").alias("n"))
    status = F.when(F.col("n") == 0, "missing").when(F.col("b.other"), "recovered").otherwise("kept")
    present = F.col("n") > 0
    return best.select("field", F.when(present, F.col("b.path")).alias("path"), F.when(present, F.col("b.type")).alias("type"), status.alias("status"))
