"""Mixing sources to target weights by Pfair scheduling.

The rows of each source are cut into blocks of equal size. Block j (from 0) of a source of weight w
may start at floor(j / w) and must be done by ceil((j + 1) / w), both counted in blocks of the mix;
earliest-deadline-first over the released blocks then keeps every source within less than one block
of its target share at every point. When a source runs out, its weight is dealt out to those left in
proportion and a new phase begins, so every row is placed.

Only row counts by source reach the driver, of at most ``max_blocks`` sources. The number of blocks is bounded by a parameter, whatever
the number of rows: the block size follows from it. A row finds its block through counts of bounded
sub-groups of its source, so a source with a third of all rows is many tasks.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 20_000
GROUP_ROWS = 5_000


def pfair(blocks: list[int], weights: list[Fraction]) -> list[tuple[int, int, int, int, int]]:
    """(source, block, phase, release, deadline) in the order of the mix; all blocks of all sources.

    Sources without weight come last, one after the other. Release and deadline count from the start
    of the phase.
    """
    out: list[tuple[int, int, int, int, int]] = []
    done = [0] * len(blocks)
    alive = [i for i, n in enumerate(blocks) if n and weights[i] > 0]
    phase = 0
    while alive:
        total = sum(weights[i] for i in alive)
        share = {i: weights[i] / total for i in alive}
        late = [(-(-1 // share[i]), i, 0) for i in alive]  # released at 0
        heapq.heapify(late)
        early: list[tuple[int, int, int]] = []
        slot, gone = 0, None
        while gone is None:
            while early and early[0][0] <= slot:
                r, i, j = heapq.heappop(early)
                heapq.heappush(late, (-(-(j + 1) // share[i]), i, j))
            if not late:  # cannot be with full use; then take what is released next
                slot = early[0][0]
                continue
            deadline, i, j = heapq.heappop(late)
            out.append((i, done[i], phase, int(j // share[i]), int(deadline)))
            done[i] += 1
            slot += 1
            if done[i] == blocks[i]:
                gone = i
            else:
                heapq.heappush(early, (int((j + 1) // share[i]), i, j + 1))
        alive.remove(gone)
        phase += 1
    for i, n in enumerate(blocks):
        for j in range(done[i], n):
            out.append((i, j, phase, j, j + 1))
    return out


def target_weights(counts: dict[str | None, int], power: float = 0.5) -> dict[str | None, Fraction]:
    """Tempered weights: each source's row count to ``power``, as exact fractions."""
    return {k: Fraction(round(n**power * 1000), 1000) for k, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str | None, Fraction] | None = None, max_blocks: int = MAX_BLOCKS, power: float = 0.5, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The columns of ``docs`` (doc_id, source needed) with block, phase, release, deadline and position.

    position runs from 0 without gaps; the mix is the order of position. Within a source rows are in
    the order of a hash of doc_id (ties: doc_id, then any order among equal rows). A null source is a
    source of its own. Sources absent from ``weights``, or of weight 0, come after all others. Rows
    that repeat are placed once each; an empty table gives an empty result. Input columns of the
    same names as the added ones are replaced.
    """
    spark = docs.sparkSession
    added = ["block", "phase", "release", "deadline", "position"]
    counts = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) > max_blocks:
        raise ValueError(f"{len(counts)} sources; more than {max_blocks} have to be grouped first, since the schedule is drawn up on the driver")
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    weights = target_weights(counts, power) if weights is None else weights
    size = max(1, -(-sum(counts.values()) // max_blocks))
    blocks = [-(-counts[s] // size) for s in names]
    plan, start = [], 0
    for i, j, phase, release, deadline in pfair(blocks, [Fraction(weights.get(s, 0)) for s in names]):
        plan.append((i, j, phase, release, deadline, start))
        start += min(size, counts[names[i]] - j * size)
    schema = "_s int, block long, phase int, release long, deadline long, _start long"
    schedule = spark.createDataFrame(plan, schema)
    sources = spark.createDataFrame([(i, s, max(1, -(-counts[s] // group_rows))) for i, s in enumerate(names)], "_s int, _name string, _n int")
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source")
    rows = rows.join(F.broadcast(sources), F.col("source").cast("string").eqNullSafe(F.col("_name"))).drop("_name")
    h = F.xxhash64(F.col("doc_id"), F.lit(7))
    # groups are ranges of the hash, so that the order within a source is by hash throughout
    top = F.shiftrightunsigned(h, 32)
    rows = rows.withColumn("_r", top).withColumn("_g", F.floor(top * F.col("_n") / F.lit(float(1 << 32))).cast("long"))
    from pyspark.sql import Window

    sizes = rows.groupBy("_s", "_g").agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_s", "_g", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_s", "_g").orderBy("_r", "doc_id")) - 1
    ranked = rows.withColumn("_rank", rank).join(offsets, ["_s", "_g"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.withColumn("block", F.floor(F.col("_rank") / F.lit(size)).cast("long")).join(F.broadcast(schedule), ["_s", "block"])
    placed = placed.withColumn("position", (F.col("_start") + F.col("_rank") - F.col("block") * size).cast("long"))
    return placed.select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in added], *added)


def mix_positions(docs: DataFrame) -> DataFrame:
    """Every row's place in the mix of all sources."""
    return mix(docs.select("doc_id", "source"))
