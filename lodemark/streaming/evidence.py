"""Streaming forms of the batch operators: windows with late data, bursts, dedupe, incremental upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 hours", keys: tuple[str, ...] = ("platform",)) -> DataFrame:
    """Counts by tumbling window; rows later than the watermark and rows without a time are dropped."""
    w = events.where("ts IS NOT NULL").withWatermark("ts", late)
    g = w.groupBy(F.window("ts", size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("records"))
    return g.select(F.col("w.start").alias("start"), *keys, "records")


def bursts(events: DataFrame, gap: str = "180 seconds", late: str = "10 minutes", least: int = 5) -> DataFrame:
    """Sessions of an author with at most ``gap`` between posts and at least ``least`` posts."""
    w = events.where("ts IS NOT NULL").withWatermark("ts", late)
    g = w.groupBy(F.session_window("ts", gap).alias("w"), "author").agg(F.count(F.lit(1)).alias("posts"))
    return g.where(F.col("posts") >= least).select("author", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "posts")


def first_seen(events: DataFrame, late: str = "1 day", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Each key once within the watermark; state older than it goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


def near_in_time(left: DataFrame, right: DataFrame, key: str, hours: int = 6, late: str = "2 hours") -> DataFrame:
    """Pairs of events of two streams (id, ts, ``key``) with equal keys and at most ``hours`` apart.

    Both watermarks and the interval bound the state: a row goes once no partner can come.
    """
    l = left.where("ts IS NOT NULL").withWatermark("ts", late).select(F.col("id").alias("id_a"), F.col("ts").alias("ts_a"), F.col(key).alias("key_a"))  # noqa: E741
    r = right.where("ts IS NOT NULL").withWatermark("ts", late).select(F.col("id").alias("id_b"), F.col("ts").alias("ts_b"), F.col(key).alias("key_b"))
    span = F.expr(f"INTERVAL {int(hours)} HOURS")
    return l.join(r, (F.col("key_a") == F.col("key_b")) & (F.col("ts_b") >= F.col("ts_a") - span) & (F.col("ts_b") <= F.col("ts_a") + span)).select("id_a", "id_b", "ts_a", "ts_b")


def append_batches(events: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "ts") -> StreamingQuery:
    """Write micro-batches below ``path``, one folder a batch, so a repeated batch overwrites itself.

    Within a batch the last row of a key by ``order`` stays; ``latest`` gives the table: the last value of each key wins.
    """

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c != key]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("r")).select(key, "r.*")
        last.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame, key: str = "id") -> DataFrame:
    """The newest row of each key of a table written by ``append_batches``."""
    rest = [c for c in table.columns if c not in (key, "_batch", "batch")]
    g = table.groupBy(key).agg(F.max_by(F.struct(*rest), "_batch").alias("r"))
    return g.select(key, "r.*")
