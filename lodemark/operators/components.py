"""Connected components by randomized contraction, in DataFrame operations only.

Each round maps every vertex to the neighbour (or itself) of least random priority and rewrites
the edges to the images. A constant share of the vertices goes in each round whatever the shape of
the graph, so long chains need a logarithmic number of rounds too. Vertices of very high degree
are met by partial aggregation (the minimum) and by joins that adaptive execution can split.
Nothing is collected; each round is cut off by a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.session import cut, discard


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(id, component) for each vertex of ``edges``; component is the smallest id reachable.

    Null ends and self-loops are ignored; repeated edges count once; an empty edge table gives an
    empty result.
    """
    a, b = F.col(src), F.col(dst)
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    e = cut(e)
    maps: list[DataFrame] = []
    while not e.isEmpty():
        if len(maps) >= max_rounds:
            raise RuntimeError("components did not converge")
        seed = F.lit(len(maps) + 1)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min(F.struct(F.xxhash64("v", seed).alias("h"), F.col("v").alias("x"))).alias("n"))
        own = F.struct(F.xxhash64("u", seed).alias("h"), F.col("u").alias("x"))
        step = cut(near.select("u", F.least("n", own)["x"].alias("to")))
        maps.append(step)
        left, right = step.select("u", F.col("to").alias("ua")), step.select(F.col("u").alias("v"), F.col("to").alias("va"))
        moved = e.join(left, "u").join(right, "v").where("ua <> va")
        e, old = cut(moved.select(F.least("ua", "va").alias("u"), F.greatest("ua", "va").alias("v")).distinct()), e
        discard(old)
    if not maps:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    labels = maps[-1].select(F.col("u").alias("id"), F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = labels.select(F.col("id").alias("to"), "root")
        labels, old = cut(step.join(later, "to", "left").select(F.col("u").alias("id"), F.coalesce("root", "to").alias("root"))), labels
        discard(old)
        discard(step)
    least = labels.groupBy("root").agg(F.min("id").alias("least"))
    least = least.select("root", F.least("least", "root").alias("component"))
    return labels.join(least, "root").select("id", "component")
