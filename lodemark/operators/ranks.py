"""Ranks within groups of any size, and exact quantiles, without a group or a column in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemark.session import cut, discard


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "rank", written: bool = False) -> DataFrame:
    """``df`` with ``name``: the place of each row in its group by ``order``, from 1 on; ties in any order. Nulls come first.

    Rows are dealt by ranges of group and order and counted where they lie; each range then starts at the
    sum of those before it. So a group with a third of all rows lies in many tasks, and the only window runs
    over one row for each range that a group touches. The rows are written once on the way, and once more
    if the numbered rows shall be ``written`` too.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()))
    part = rows.withColumn("range_", F.shiftright("at_", 33)).withColumn("g_", F.xxhash64(*group) if group else F.lit(0))
    runs = part.groupBy("g_", "range_").agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("g_").orderBy("range_")) - F.col("n_")
    out = part.join(runs.select("g_", "range_", (before - F.col("first_") + 1).alias("shift_")), ["g_", "range_"])
    out = out.withColumn(name, F.col("at_") + F.col("shift_")).drop("g_", "range_", "at_", "shift_")
    if written:
        out = cut(out)
        discard(rows)
    return out


#: Value ranges of the first pass: so many for each doubling.
RANGES = 512


def exact_quantile(df: DataFrame, group: str, columns: list[str], q: float) -> DataFrame:
    """(group, all_, {column}_p, {column}_n): the q-quantile of the positive values of each column and their number, by
    group and (``all_`` = true, group null) over all rows; interpolated between neighbours. Null where there are none.

    Selection by rank in two passes. The first counts values by range, ``RANGES`` to each doubling, so its
    state grows with the number of ranges only; running sums over the ranges show which ones hold the two
    ranks. The second counts the distinct values of these ranges, whose numbers are the only values that
    travel. What is broadcast is two ranges for each group and column.
    """
    entry = F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    values = df.select(F.col(group).alias("g"), F.inline(entry)).where("v > 0").withColumn("bin", F.floor(F.log2("v") * RANGES))
    bins = values.groupingSets([["g", "m", "bin"], ["m", "bin"]], "g", "m", "bin").agg(F.count(F.lit(1)).alias("n"), F.grouping("g").alias("all_"))
    of = Window.partitionBy("all_", "g", "m")
    bins = bins.withColumns({"before": F.sum("n").over(of.orderBy("bin")) - F.col("n"), "total": F.sum("n").over(of)})
    at = F.lit(q) * (F.col("total") - 1)
    low, high = F.floor(at), F.ceil(at)
    holds = lambda k, start, n: (k >= start) & (k < start + n)
    wanted = bins.where(holds(low, F.col("before"), F.col("n")) | holds(high, F.col("before"), F.col("n")))
    wanted = wanted.select("all_", F.col("g").alias("to"), "m", "bin", "before", "total")
    near = values.join(F.broadcast(wanted), ["m", "bin"]).where("all_ = 1 OR g <=> to")
    near = near.groupBy("all_", "to", "m", "bin", "v").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("total").alias("total"))
    start = F.col("before") + F.sum("n").over(Window.partitionBy("all_", "to", "m", "bin").orderBy("v")) - F.col("n")
    near = near.withColumn("start", start)
    value = lambda k: F.max(F.when(holds(k, F.col("start"), F.col("n")), F.col("v")))
    found = near.groupBy("all_", "to", "m").agg(value(low).alias("lo"), value(high).alias("hi"), F.first("total").alias("total"))
    p = F.when(low == high, F.col("lo")).otherwise((high - at) * F.col("lo") + (at - low) * F.col("hi"))
    found = found.select(F.col("to").alias(group), (F.col("all_") == 1).alias("all_"), "m", p.alias("p"), "total")
    one = lambda i, c, name: F.max(F.when(F.col("m") == i, F.col(c))).alias(name)
    return found.groupBy(group, "all_").agg(*[x for i, c in enumerate(columns) for x in (one(i, "p", f"{c}_p"), F.coalesce(one(i, "total", "n"), F.lit(0)).alias(f"{c}_n"))])
