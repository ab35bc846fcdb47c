"""From raw rows to records: paths, dates, ids, upserts, mapping inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "\x1f"


def fingerprint(*columns: str) -> Column:
    """SHA-256 over columns; nulls count as empty."""
    return F.sha2(F.concat_ws(SEP, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def record_id(platform: Column, url: Column, author: Column, text: Column) -> Column:
    """Id of a row that brings none: 24 hexadecimal digits of a digest."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (platform, url, author, text)])), 1, 24)


def first_of_paths(raw: Column, paths: list[str]) -> tuple[Column, Column]:
    """The first value among JSON paths that is neither null nor empty, and its path."""
    v = F.try_parse_json(raw)
    values = [F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths]
    path = F.lit(None).cast("string")
    for p, x in reversed(list(zip(paths, values, strict=True))):
        path = F.when(x.isNotNull(), F.lit(p)).otherwise(path)
    return F.coalesce(*values), path


def parse_date(raw: Column, now: Column) -> Column:
    """A timestamp from epoch seconds or milliseconds, ISO text, day text or "3 days ago"; null where nothing fits."""
    s = F.trim(raw)
    number = F.when(F.regexp_like(s, F.lit(r"^\d{9,14}(\.\d+)?$")), s.try_cast("double"))
    epoch = F.timestamp_micros((F.when(number > 1e10, number / 1000).otherwise(number) * 1_000_000).cast("long"))
    iso = F.when(F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}")), s.try_cast("timestamp"))
    bare = F.regexp_replace(s, "^[A-Z][a-z]{2},? ", "")  # without the day of the week
    bare = F.when(F.regexp_like(s, F.lit("^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),? ")), bare).otherwise(s)
    formats = [F.try_to_timestamp(bare, F.lit(f)) for f in ("dd/MM/yyyy", "dd-MM-yyyy", "dd MMM yyyy HH:mm:ss Z", "MMM dd HH:mm:ss Z yyyy", "MMM dd, yyyy")]
    n = F.regexp_extract(F.lower(s), r"^(\d+) (second|minute|hour|day|week|month|year)s? ago$", 1).try_cast("long")
    unit = F.regexp_extract(F.lower(s), r"^(\d+) (second|minute|hour|day|week|month|year)s? ago$", 2)
    sizes = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400, "month": 30 * 86400, "year": 365 * 86400}
    seconds = F.lit(None).cast("long")
    for k, x in sizes.items():
        seconds = F.when(unit == k, n * x).otherwise(seconds)
    ago = F.timestamp_micros(F.unix_micros(now) - seconds * 1_000_000)
    return F.coalesce(epoch, iso, *formats, ago)


def local_day(raw: Column) -> Column:
    """The calendar day in the text's own offset."""
    return F.when(F.regexp_like(raw, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.substring(raw, 1, 10))


def scalar_paths(df: DataFrame, column: str) -> DataFrame:
    """(path, value) of the scalars two levels deep in a JSON column; of an array its first element."""
    v = df.select(F.try_parse_json(column).alias("v")).where("v IS NOT NULL")
    one = v.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).select("key", "value")).where("key IS NOT NULL").select(F.col("key").alias("k"), F.col("value").alias("v"))
    kind = F.schema_of_variant("v")
    flat = one.where(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY")).select(F.concat(F.lit("$."), "k").alias("path"), F.try_variant_get("v", "$", "string").alias("value"))
    deep = one.where(kind.startswith("OBJECT"))
    two = deep.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("key2"), F.col("value").alias("value2")))
    two = two.select(F.concat(F.lit("$."), "k", F.lit("."), "key2").alias("path"), F.try_variant_get("value2", "$", "string").alias("value"))
    return flat.unionByName(two)


def infer_mapping(spark: SparkSession, columns: list[str], aliases: dict[str, tuple[str, ...]], accept: float = 0.70) -> DataFrame:
    """(field, path, score): the best column for each field; a schema is a handful of names, so this is local."""
    rows = []
    for field, names in aliases.items():
        best = max(((1.0 if c == field else 0.95 if c in names else 0.72 if field in c else 0.0), -i, c) for i, c in enumerate(columns))
        if best[0] >= accept:
            rows.append((field, best[2], best[0]))
    return spark.createDataFrame(rows, "field string, path string, score double")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both tables, one for each key: those of ``new`` win, and within a table the last by ``order``.

    Without ``order`` keys have to be unique within each table; any of several rows may stay.
    """
    rest = [c for c in old.columns if c not in keys]
    at = F.lit(0) if order is None else F.col(order)
    side = lambda df, v: df.select(*keys, F.struct(F.lit(v).alias("v"), at.alias("o")).alias("_v"), F.struct(*rest).alias("_r"))
    return side(old, 0).union(side(new, 1)).groupBy(*keys).agg(F.max_by("_r", "_v").alias("_r")).select(*keys, "_r.*")


def added(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``new`` whose keys ``old`` does not have."""
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def same_ids(asked: DataFrame, got: DataFrame, batch: str, key: str) -> DataFrame:
    """(batch, identical): whether both tables hold the same ids of a batch, each once."""
    n = F.count(F.lit(1))
    a = asked.groupBy(batch, key).agg(n.alias("a"))
    g = got.groupBy(F.col(batch).alias("_b"), F.col(key).alias("_k")).agg(n.alias("g"))
    j = a.join(g, (F.col(batch) == F.col("_b")) & (F.col(key) == F.col("_k")), "full_outer").select(F.coalesce(batch, "_b").alias(batch), ((F.col("a") == 1) & (F.col("g") == 1)).alias("ok"))
    return j.groupBy(batch).agg(F.every(F.coalesce("ok", F.lit(False))).alias("identical"))
