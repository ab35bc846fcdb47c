"""Windows of days cut in halves until each holds few enough rows, and counts that betray a ceiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemark.session import cut

#: Fixed: no slice is shorter, and so many equal counts in a row are a ceiling.
MIN_SLICE_DAYS, CEILING_AGREEMENT = 1, 3


def split_windows(rows: DataFrame, key: str, day: str, limit: int, shortest: int = MIN_SLICE_DAYS) -> DataFrame:
    """(key, start, end, n, full) for each key: its span of days cut into windows of fewer than ``limit`` rows.

    A window with ``limit`` rows or more is halved (the first half takes the smaller part of an odd span)
    while both halves keep ``shortest`` days; one that cannot be halved stays, with ``full`` = true. Windows
    follow each other without gap or overlap. Rows without a key or day do not count; an empty table gives none.

    Rows are read once, for counts by day; any window's count is then the difference of two running sums.
    A round is a join of the windows that are still too full with these sums, and there are as many rounds
    as the longest span has halvings.
    """
    daily = rows.where(F.col(key).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(key).alias("k"), F.col(day).cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    by_day = Window.partitionBy("k").orderBy("d")
    sums = cut(daily.withColumn("upto", F.sum("n").over(by_day)).withColumn("next", F.lead("d").over(by_day)))
    span = sums.groupBy("k").agg(F.min("d").alias("start"), F.max("d").alias("end"), F.max("upto").alias("n"), F.lit(0).cast("long").alias("before"))
    # upto as a step function: what holds from d until the day before next
    steps = sums.select(F.col("k").alias("k_"), "d", F.coalesce("next", F.lit("9999-12-31").cast("date")).alias("next"), "upto")
    days = F.datediff("end", "start") + 1
    longest = span.agg(F.max(days)).first()[0] or 0
    done, level = [], span
    while True:
        can = (F.col("n") >= limit) & (days >= 2 * shortest)
        done.append(level.where(~can).select("k", "start", "end", "n", (F.col("n") >= limit).alias("full")))
        if longest < 2 * shortest:
            break
        longest = longest - longest // 2
        middle = F.date_add("start", F.floor(days / 2).cast("int") - 1)
        wide = level.where(can).withColumn("middle", middle)
        held = wide.join(steps, (F.col("k") == F.col("k_")) & (F.col("d") <= F.col("middle")) & (F.col("next") > F.col("middle")), "left")
        first = F.coalesce("upto", "before") - F.col("before")
        one = F.struct(F.col("start"), F.col("middle").alias("end"), first.alias("n"), F.col("before"))
        two = F.struct(F.date_add("middle", 1).alias("start"), F.col("end"), (F.col("n") - first).alias("n"), (F.col("before") + first).alias("before"))
        level = cut(held.select("k", F.inline(F.array(one, two))))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("k", key)


def ceilings(calls: DataFrame, key: str, order: str, returned: str, agreement: int = CEILING_AGREEMENT) -> DataFrame:
    """(key, ceiling): the count of the last ``agreement`` calls that returned anything, where these agree; else null.

    Unlike questions that all come back with one count show the limit of who answers. Calls that
    returned nothing, or no number, do not count.
    """
    n = F.col(returned).try_cast("long")
    last = calls.where(n > 0).withColumn("n_", n).withColumn("r_", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))).where(F.col("r_") <= agreement)
    same = last.groupBy(key).agg(F.when((F.count(F.lit(1)) == agreement) & (F.min("n_") == F.max("n_")), F.max("n_")).alias("ceiling"))
    return calls.select(key).distinct().join(same, key, "left")
