"""Bursts by gaps over a stream, with state of its own and timers.

The batch rule sorts an author's posts and counts gaps of at most three minutes. A stream may bring posts in any
order within the watermark, so a post waits in the author's state until the watermark has passed it; then
what has been passed is settled in order of time. A timer wakes an author whose next post is still to be settled,
so nothing has to arrive for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodemark.session import ship

#: Fixed: seconds of a rapid gap, gaps and posts of a burst.
RAPID, LEAST_GAPS, LEAST_POSTS = 180, 4, 5
OUT = "author string, posts long, rapid long, burst boolean"
STATE = "waiting array<long>, last long, posts long, rapid long"


def batch_bursts(events: DataFrame) -> DataFrame:
    """(author, posts, rapid, burst) over a table (author, ts); rows without author or time do not count."""
    e = events.where("author IS NOT NULL AND ts IS NOT NULL").select("author", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("author").orderBy("t"))
    g = e.withColumn("quick", F.coalesce((gap <= RAPID * 1_000_000).cast("long"), F.lit(0))).groupBy("author").agg(F.count(F.lit(1)).alias("posts"), F.sum("quick").alias("rapid"))
    return g.withColumn("burst", (F.col("posts") >= LEAST_POSTS) & (F.col("rapid") >= LEAST_GAPS))


def _settle(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    waiting, last, posts, rapid = state.get if state.exists else ([], None, 0, 0)
    new = [np.asarray(waiting, np.int64)] + [f["t"].to_numpy(np.int64) for f in frames]
    times = np.sort(np.concatenate(new))
    passed = state.getCurrentWatermarkMs() * 1000
    k = int(np.searchsorted(times, passed, "right"))
    ready, times = times[:k], times[k:]
    if len(ready):
        before = np.concatenate(([last] if last is not None else [], ready))
        posts, rapid, last = posts + len(ready), rapid + int((np.diff(before) <= RAPID * 1_000_000).sum()), int(ready[-1])
    state.update((times.tolist(), last, posts, rapid))
    if len(times):  # the timer goes off once the watermark is beyond the next post
        state.setTimeoutTimestamp(max(int(times[0]) // 1000 + 1, passed // 1000 + 1))
    if len(ready):
        yield pd.DataFrame({"author": [key[0]], "posts": [posts], "rapid": [rapid], "burst": [posts >= LEAST_POSTS and rapid >= LEAST_GAPS]})


def stream_bursts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same over a stream (author, ts), in update mode: a row for an author whenever some of its posts are settled.

    Rows later than the watermark are dropped. An author's state is four numbers and the posts that the
    watermark has not passed yet.
    """
    ship(events.sparkSession)
    e = events.where("author IS NOT NULL AND ts IS NOT NULL").select("author", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).withWatermark("ts", late)
    return e.groupBy("author").applyInPandasWithState(_settle, OUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
