"""Similarity joins over token sets, and what is built on them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lodemark.functions.text import here, jaccard
from lodemark.operators.components import connected_components
from lodemark.operators.ranks import numbered
from lodemark.session import cut


SKETCH = 8  # words of 64 bits
#: Rows whose tokens decide which tokens count as frequent, and how many of these there are at most.
SAMPLE_ROWS, FREQUENT = 20_000, 2048


def hashed(tokens: Column | str) -> Column:
    """The distinct tokens as sorted 8-byte hashes."""
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda t: F.xxhash64(t))))


def sketch(x: Column | str) -> list[Column]:
    """Bits of a set of hashes, as columns s0, s1, ...: a set that lacks a bit lacks all its elements."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    word = lambda k: F.aggregate(x, F.lit(0).cast("long"), lambda a, h: F.when(F.shiftright(h, 6).bitwiseAND(F.lit(SKETCH - 1)) == k, a.bitwiseOR(bit(h))).otherwise(a))
    return [here(word(k)).alias(f"s{k}") for k in range(SKETCH)]


def may_reach(threshold: float, a: str = "a", b: str = "b") -> Column:
    """Whether two sets can have a Jaccard similarity of ``threshold``, from their sizes and sketches ({s0_a}, {n_a}, ...).

    A bit of one set that the other lacks is an element that it lacks, so the intersection is at most the
    size less these bits. No similar pair is lost.
    """
    na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
    lacks = lambda x, y: sum((F.bit_count(F.col(f"s{k}_{x}").bitwiseAND(F.bitwise_not(F.col(f"s{k}_{y}")))) for k in range(SKETCH)), F.lit(0))
    need = F.lit(threshold / (1 + threshold)) * (na + nb) - 1e-6
    sizes = F.least(na, nb) >= F.lit(threshold) * F.greatest(na, nb) - 1e-6
    return sizes & (na - lacks(a, b) >= need) & (nb - lacks(b, a) >= need)


def _sided(df: DataFrame, side: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in keep])


#: Postings of a token that one group holds, and order ranges by which longer lists are divided.
BLOCK_ROWS, CUTS = 200_000, 256


def _windows(window: int, threshold: float):
    """Arrow function: (a, b) of the rows at most ``window`` places apart in their group (t, blk) that may be similar enough.

    Rows come sorted by group and order; only the last ``window`` rows are held from batch to batch.
    Rows that are not ``own`` come from the group before and only stand on the earlier side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            m = 0 if held is None else len(held[0])
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
            t, blk, own, o, n, *bits = cols
            size, found = len(t), []
            for d in range(1, min(window, size - 1) + 1):
                lo = max(m, d)
                i, j = slice(lo - d, size - d), slice(lo, size)
                ok = (t[i] == t[j]) & (blk[i] == blk[j]) & own[j]
                if not ok.any():
                    break  # groups are contiguous
                at = np.flatnonzero(ok & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-6))
                x, y = at + (lo - d), at + lo
                if threshold > 0:  # as in may_reach
                    for first in (True, False):
                        p, q = (x, y) if first else (y, x)
                        lacks = sum(np.bitwise_count((s[p] & ~s[q]).view(np.uint64)).astype(np.int64) for s in bits)
                        keep = n[p] - lacks >= threshold / (1 + threshold) * (n[p] + n[q]) - 1e-6
                        x, y = x[keep], y[keep]
                found.append((o[x], o[y]))
            held = [c[-window:] for c in cols]
            if found:
                pairs = np.unique(np.stack([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k]).cast(batch.column(3).type) for k in (0, 1)], ["a", "b"])

    return run


def _places(post: DataFrame, window: int, block_rows: int) -> DataFrame | None:
    """(t, ob, places): the groups of a token's rows by order range, for tokens of more than ``block_rows`` rows; None without any.

    A place is struct(blk, own). A range also goes, not as its own, to every later group that begins fewer than
    ``window`` rows after it. The table has at most ``CUTS`` rows for ``block_rows`` postings.
    """
    heavy = cut(post.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows).select("t"))
    if heavy.isEmpty():
        return None
    ranges = post.join(heavy, "t").groupBy("t", "ob").agg(F.count(F.lit(1)).alias("c"))
    ranges = ranges.withColumn("start", F.sum("c").over(Window.partitionBy("t").orderBy("ob")) - F.col("c"))
    ranges = cut(ranges.withColumn("blk", F.floor(F.col("start") / block_rows)))
    begins = ranges.groupBy("t", "blk").agg(F.min("start").alias("begin")).select("t", F.col("blk").alias("later"), "begin")
    more = ranges.join(begins, "t").where((F.col("later") > F.col("blk")) & (F.col("begin") - F.col("start") - F.col("c") < window))
    every = ranges.select("t", "ob", "blk", F.lit(True).alias("own")).union(more.select("t", "ob", "later", F.lit(False)))
    return cut(every.groupBy("t", "ob").agg(F.collect_list(F.struct("blk", "own")).alias("places")))


def recent_pairs(df: DataFrame, order: str, tokens: str, window: int = 80, per_row: int = 40, min_length: int = 4, threshold: float = 0.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) of rows that share a token, where a is among the ``window`` latest rows with it before b; ``order`` holds whole numbers.

    Rows give their first ``per_row`` sorted tokens of at least ``min_length`` characters. Each token's rows
    are shuffled once, in their order, and meet the ``window`` rows before them as they pass. Lists of more
    than ``block_rows`` are divided by ranges of the order; the rows before a part go to it too. With a
    ``threshold``, pairs whose sizes and sketches show that they are less similar are not made.
    """
    short = F.slice(F.sort_array(F.filter(F.array_distinct(tokens), lambda t: F.length(t) >= min_length)), 1, per_row)
    words = SKETCH if threshold > 0 else 0
    rows = df.select(F.col(order).alias("o"), here(short).alias("short"), *([here(hashed(tokens)).alias("x")] if words else []))
    rows = rows.select("o", F.transform("short", lambda t: F.xxhash64(t)).alias("short"), *([F.size("x").alias("n"), *sketch("x")] if words else [F.lit(0).alias("n")]))
    rows = cut(rows)  # texts are folded once
    bits = [f"s{k}" for k in range(words)]
    cuts = rows.agg(F.percentile_approx("o", [k / CUTS for k in range(1, CUTS)], 10_000)).first()[0] or []  # they only divide the work
    rows = rows.withColumn("ob", F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))).cast("array<bigint>"), lambda c: c < F.col("o"))))
    post = rows.select("o", "n", *bits, "ob", F.explode("short").alias("t"))
    places = _places(post.select("t", "ob"), window, block_rows)
    if places is None:
        post = post.withColumns({"blk": F.lit(0).cast("long"), "own": F.lit(True)})
    else:
        alone = F.array(F.struct(F.lit(0).cast("long").alias("blk"), F.lit(True).alias("own")))
        post = post.join(F.broadcast(places), ["t", "ob"], "left").select("o", "n", *bits, "t", F.inline(F.coalesce("places", alone)))
    post = post.select("t", "blk", "own", F.col("o"), F.col("n").cast("long").alias("n"), *bits)
    dealt = post.repartition("t", "blk").sortWithinPartitions("t", "blk", "o")
    kind = df.schema[order].dataType
    return dealt.mapInArrow(_windows(window, threshold), StructType([StructField("a", kind), StructField("b", kind)])).distinct()


def with_similarity(pairs: DataFrame, df: DataFrame, order: str, tokens: str, extra: list[str] | None = None) -> DataFrame:
    """Adds the Jaccard similarity of the token sets, as 8-byte hashes, (and {extra}_a, {extra}_b) to pairs.

    Pairs meet digests of the sets; sets themselves are fetched once for each pair of different ones, so copies cost none.
    """
    extra = extra or []
    sets = cut(df.select(F.col(order).alias("o"), *extra, here(hashed(tokens)).alias("x")).withColumn("d", F.xxhash64("x")))
    side = lambda k: sets.select(F.col("o").alias(k), F.col("d").alias(f"d_{k}"), *([F.size("x").alias("n_")] if k == "a" else []), *[F.col(c).alias(f"{c}_{k}") for c in extra])
    both = cut(pairs.join(side("a"), "a").join(side("b"), "b").withColumns({"u_": F.least("d_a", "d_b"), "v_": F.greatest("d_a", "d_b")}))
    kinds = cut(both.where("u_ <> v_").select("u_", "v_").distinct())
    needed = kinds.select(F.col("u_").alias("d")).union(kinds.select(F.col("v_").alias("d"))).distinct()
    one = cut(sets.join(needed, "d", "left_semi").select("d", "x").dropDuplicates(["d"]))
    sims = kinds.join(one.select(F.col("d").alias("u_"), F.col("x").alias("x_")), "u_").join(one.select(F.col("d").alias("v_"), F.col("x").alias("y_")), "v_")
    sims = sims.select("u_", "v_", jaccard(F.col("x_"), F.col("y_")).alias("s_"))
    alike = F.when(F.col("u_") != F.col("v_"), F.col("s_")).otherwise((F.col("n_") > 0).cast("double"))
    return both.join(sims, ["u_", "v_"], "left").withColumn("similarity", alike).drop("u_", "v_", "d_a", "d_b", "n_", "s_")


def _frequent(sets: DataFrame) -> list[int]:
    """The hashes of tokens found most in a random sample, the most frequent last. They only set an order: results do not depend on them."""
    sample = sets.select("x").sample(min(1.0, SAMPLE_ROWS / max(1, sets.count())), seed=7)
    top = sample.select(F.explode("x").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f")).orderBy(F.col("f").desc(), "t").limit(FREQUENT)
    return [r["t"] for r in reversed(top.collect())]


#: Sets of more elements fill a sketch of ``SKETCH`` words, so that it rules nothing out; they are met by wide ones instead.
LONG, BLOCK_BYTES = 1000, 4 << 20
_WIDE = "g string, band int, own boolean, o {0}, n long, bits binary"


def _wide(threshold: float):
    """Arrow function: each set (g, o, x) with bits that fit its size, for its own band of sizes and the one below."""
    step = -np.log(threshold)

    def bits(x: np.ndarray, band: int) -> bytes:
        words = 1 << max(0, int(np.ceil(np.log2(2 * np.exp((band + 1) * step) / 64))))  # two bits an element
        out = np.zeros(words * 64, np.uint8)
        out[x.astype(np.int64) & (words * 64 - 1)] = 1
        return np.packbits(out).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, o, x = (batch.column(k) for k in range(3))
            ends = x.offsets.to_numpy()
            flat, sizes = x.values.to_numpy(zero_copy_only=False), np.diff(ends)
            bands = np.floor(np.log(sizes) / step + 1e-9).astype(int).tolist()
            made = [bits(flat[ends[i] : ends[i + 1]], k - low) for i, k in enumerate(bands) for low in (0, 1)]
            twice = pa.array(np.repeat(np.arange(len(batch)), 2))
            cols = [g.take(twice), pa.array([k - low for k in bands for low in (0, 1)], pa.int32()), pa.array([True, False] * len(batch)), o.take(twice), pa.array(np.repeat(sizes, 2).astype(np.int64)), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["g", "band", "own", "o", "n", "bits"])

    return run


def _alike(threshold: float):
    """Arrow function: (a, b), a < b, of the sets of a cell that may be similar enough, at least one in its own band."""

    def run(t: pa.Table) -> pa.Table:
        kind = t.schema.field("o").type
        t = t.combine_chunks().sort_by("n")
        o, n, own, at, cross = (t.column(c).to_numpy() for c in ("o", "n", "own", "blk", "cross"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        need, upto = threshold / (1 + threshold), np.searchsorted(n, n / threshold + 1e-6, side="right")
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(len(n)):
            j = np.arange(i + 1, upto[i])
            j = j[(own[i] | own[j]) & ((at[j] != at[i]) | ~cross[i])]
            for lo in range(0, len(j), 4096):
                k = j[lo : lo + 4096]
                least = need * (n[i] + n[k]) - 1e-6
                k = k[n[i] - np.bitwise_count(bits[i] & ~bits[k]).sum(axis=1, dtype=np.int64) >= least]
                k = k[n[k] - np.bitwise_count(bits[k] & ~bits[i]).sum(axis=1, dtype=np.int64) >= need * (n[i] + n[k]) - 1e-6]
                found.append((np.minimum(o[i], o[k]), np.maximum(o[i], o[k])))
        pairs = [np.concatenate([np.zeros(0, o.dtype), *(f[c] for f in found)]) for c in (0, 1)]
        return pa.table([pa.array(x).cast(kind) for x in pairs], ["a", "b"])

    return run


def long_pairs(sets: DataFrame, threshold: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b), a < b, of large sets (g, o, x) of a group that may be similar enough; no similar pair is lost.

    Similar sets lie in one band of sizes or in neighbouring ones, where their bits meet, block by block:
    a block holds ``block_bytes`` of bits, and a cell two blocks.
    """
    kind = sets.schema["o"].dataType.simpleString()
    wide = cut(sets.where("g IS NOT NULL").select("g", "o", "x").mapInArrow(_wide(threshold), _WIDE.format(kind)))
    size = wide.groupBy("g", "band").agg(F.ceil(F.sum(F.length("bits")) / block_bytes).cast("int").alias("blocks"), F.bool_or("own").alias("any")).where("any").drop("any")
    blk = F.pmod(F.xxhash64("o", F.lit(3)), F.col("blocks")).cast("int")
    rows = wide.join(size, ["g", "band"]).withColumn("blk", blk)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("g", "band", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "own", "o", "n", "bits", "blk", (F.col("blk") != F.col("other")).alias("cross"))
    return rows.groupBy("g", "band", "i", "j").applyInArrow(_alike(threshold), f"a {kind}, b {kind}").distinct()


def set_join(df: DataFrame, order: str, tokens: str, group: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity), a < b, of different token sets of a group that are similar enough, each
    set standing for its first row; and (rep, id) of the later rows with an equal set.

    Prefix filter: in any one order of the tokens, similar sets share one of their first
    n - ceil(threshold * n) + 1 tokens. The order is that of the hashes, with the tokens that a sample shows
    to be frequent last, so only these few are posted, as hashes, with size and sketch of their set; what
    these rule out goes before any set is fetched. Sets of more than ``LONG`` elements meet those of about their
    size by wider sketches (``long_pairs``). The filters lose no pair, and nothing is cut.
    """
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(order).alias("o"), here(hashed(tokens)).alias("x")).where(F.size("x") > 0)
    rows = cut(rows.withColumn("d", F.sha2(F.array_join(F.transform("x", lambda h: h.cast("string")), ","), 256)))  # texts are folded once
    firsts = cut(rows.groupBy("g", "d").agg(F.min("o").alias("rep"), F.count(F.lit(1)).alias("m")))
    later = cut(rows.select("g", "d", "o").join(firsts.where("m > 1"), ["g", "d"]).where("o > rep"))
    copies = later.select("rep", F.col("o").alias("id"))
    sets = cut(rows.join(later.select("g", "d", "o"), ["g", "d", "o"], "left_anti").select("g", "o", "x"))
    n = F.size("x")
    often = F.array(*[F.lit(t) for t in _frequent(sets)]).cast("array<bigint>")
    prefix = F.slice(F.concat(F.array_except("x", often), F.array_intersect(often, F.col("x"))), F.lit(1), (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))
    most = LONG / threshold + 1  # what a set of ``LONG`` elements may be similar to; both ways hold the sizes between
    post = sets.where(n <= most).select("g", "o", n.alias("n"), here(prefix).alias("p"), *sketch("x")).withColumn("t", F.explode("p")).drop("p")
    post = post.withColumn("t", F.xxhash64("g", "t")).drop("g")  # of one group, or by chance of two, which is seen below
    a, b = _sided(post, "a", ["t"]), _sided(post, "b", ["t"])
    short = a.join(b, ["t"]).where((F.col("o_a") < F.col("o_b")) & may_reach(threshold) & (F.least("n_a", "n_b") <= LONG)).select(F.col("o_a").alias("a"), F.col("o_b").alias("b"))
    pairs = cut(short.unionByName(long_pairs(sets.where(n > LONG), threshold)).distinct())
    needed = cut(pairs.select(F.col("a").alias("o")).union(pairs.select(F.col("b").alias("o"))).distinct())
    one = sets.join(needed, "o", "left_semi")
    left, right = one.select(F.col("o").alias("a"), F.col("g").alias("ga"), F.col("x").alias("xa")), one.select(F.col("o").alias("b"), F.col("g").alias("gb"), F.col("x").alias("xb"))
    found = pairs.join(left, "a").join(right, "b").where("ga = gb").withColumn("similarity", jaccard(F.col("xa"), F.col("xb"))).where(F.col("similarity") >= threshold)
    return found.select("a", "b", "similarity").distinct(), copies


#: Tokens whose order the sample of ``similar_pairs`` settles, steps of the threshold that a band of sizes spans, postings and bytes of
#: sketches that a cell is meant to hold, parts of a band at most.
RANKED, STEPS, CELL_ROWS, CELL_BYTES, PARTS = 1 << 16, 3, 1 << 20, 32 << 20, 32
#: For the comparison: pairs that a block is meant to have, near copies that go to one block, rows that are broadcast at most.
CELL_PAIRS, CROWD, SENT = 1 << 18, 512, 1 << 20
_CELLS = "band int, part int, i int, j int, d long, n int, own boolean, blk int, bits binary, t array<int>, k array<int>"


def _prefix(n: np.ndarray, threshold: float) -> np.ndarray:
    """How many first elements of a set of ``n`` a similar set shares at least one with."""
    return (n - np.ceil(threshold * n - 1e-9) + 1).astype(np.int64)


class _Bands:
    """Bands of set sizes. A set stands in its own band and, where smaller ones in the band below can be similar, in that too."""

    def __init__(self, sizes: np.ndarray, rows: np.ndarray, threshold: float, cell_rows: int):
        self.threshold, edges = threshold, [1]
        while edges[-1] <= sizes.max(initial=1):
            edges.append(int(np.ceil(edges[-1] / threshold**STEPS)) + 1)
        self.edges = np.array(edges)
        self.width = np.maximum(256, self.edges[1:] // 64 * 64)  # bits of a sketch: about as many as the largest set has elements
        own, low = self.of(sizes)
        post = np.zeros(len(edges) - 1)
        held = np.zeros(len(edges) - 1)
        for band, some in ((own, sizes > 0), (low, low < own)):
            np.add.at(post, band[some], (rows * _prefix(sizes, threshold))[some])
            np.add.at(held, band[some], (rows * self.width[band] / 8)[some])
        self.parts = np.clip(np.ceil(post / cell_rows), 1, PARTS).astype(int)
        self.blocks = np.maximum(1, np.ceil(np.maximum(held / CELL_BYTES, post / (self.parts * 2 * cell_rows)))).astype(int)

    def of(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of sets of ``n`` elements, and that of the smallest ones similar to them: the same or the one below."""
        least = np.maximum(1, np.ceil(self.threshold * n - 1e-6)).astype(np.int64)
        return tuple(np.searchsorted(self.edges, x, side="right") - 1 for x in (n, least))


def _posted(bands: _Bands, often: np.ndarray, place: np.ndarray):
    """Arrow function: sets (d, x) with their prefixes, dealt over the cells of their bands.

    Tokens in ``often`` come last, in the order of their ``place``; the others by hash. A sketch holds the parity of the
    elements at each bit, so two sets differ in as many elements at least as their sketches in bits.
    """

    def rows_of(d: np.ndarray, x: pa.ListArray) -> Iterator[pa.RecordBatch]:
        flat, n = x.flatten().to_numpy(), x.value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
        rank = np.where(often[at] == flat, place[at], 0)
        order = np.lexsort((flat, rank, row))
        k = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        head = k < np.repeat(_prefix(n, bands.threshold), n)
        t, k, of = flat[order][head], k[head], row[head]
        own, low = bands.of(n)
        for band in np.unique(np.concatenate((own, low))):
            some = np.flatnonzero((own == band) | (low == band))
            new = np.full(len(n), -1)
            new[some] = np.arange(len(some))
            width, parts, blocks = (int(a[band]) for a in (bands.width, bands.parts, bands.blocks))
            mine = new[row] >= 0
            spot = new[row[mine]] * width + ((flat[mine] >> 20) % width)
            odd = (np.bincount(spot, minlength=len(some) * width) & 1).astype(np.uint8)
            bits = np.packbits(odd.reshape(len(some), width), axis=1)
            mine = new[of] >= 0
            cell = new[of[mine]] * parts + (t[mine] & 0xFFFFF) % parts
            sort = np.argsort(cell, kind="stable")
            cell, which = cell[sort], np.flatnonzero(np.diff(cell[sort], prepend=-1))
            ends = pa.array(np.append(which, len(cell)).astype(np.int32))
            tokens = pa.ListArray.from_arrays(ends, pa.array((t[mine][sort] >> 32).astype(np.int32)))
            places = pa.ListArray.from_arrays(ends, pa.array(k[mine][sort].astype(np.int32)))
            again = np.repeat(np.arange(len(which)), blocks)  # a row for each block that it meets
            other = np.tile(np.arange(blocks), len(which))
            one = cell[which][again] // parts
            blk = (d[some] >> 7)[one] % blocks
            cols = [np.full(len(again), band), cell[which][again] % parts, np.minimum(blk, other), np.maximum(blk, other)]
            cols = [pa.array(c.astype(np.int32)) for c in cols] + [pa.array(d[some][one]), pa.array(n[some][one].astype(np.int32)), pa.array((own[some] == band)[one]), pa.array(blk.astype(np.int32))]
            cols += [pa.array([b.tobytes() for b in bits], pa.binary()).take(pa.array(one)), tokens.take(pa.array(again)), places.take(pa.array(again))]
            yield pa.RecordBatch.from_arrays(cols, ["band", "part", "i", "j", "d", "n", "own", "blk", "bits", "t", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, one = np.unique(batch.column("d").to_numpy(), return_index=True)  # copies of a batch go as one
            batch = batch.take(pa.array(one))
            upto, start = np.cumsum(batch.column("x").value_lengths().to_numpy().astype(np.int64)), 0
            while start < len(batch):
                end = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + (1 << 20), side="right"))
                end = min(max(end, start + 1), start + 2000)
                part = batch.slice(start, end - start)
                yield from rows_of(part.column("d").to_numpy(), part.column("x"))
                start = end

    return run


def _met(threshold: float):
    """Arrow function: (u, v), u < v, of the sets of a cell that may be similar enough, by shared tokens, their places, sizes and sketches.

    At the first token that two sets share, they have no more in common than what follows it in each.
    """
    need = threshold / (1 + threshold)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        _, one = np.unique(table.column("d").to_numpy(), return_index=True)
        table = table.take(pa.array(one)).combine_chunks()
        d, own, blk = (table.column(c).to_numpy() for c in ("d", "own", "blk"))
        n = table.column("n").to_numpy().astype(np.int64)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(n), -1)
        tokens = table.column("t").combine_chunks()
        row = np.repeat(np.arange(len(n)), tokens.value_lengths().to_numpy())
        t, rest = tokens.flatten().to_numpy(), n[row] - table.column("k").combine_chunks().flatten().to_numpy()
        order = np.lexsort((n[row], t))
        t, row, rest = t[order], row[order], rest[order]
        size = n[row]
        held: list[np.ndarray] = []
        found: list[np.ndarray] = []

        def sifted() -> None:
            codes = np.unique(np.concatenate(held))
            held.clear()
            step = max(1, (1 << 21) // bits.shape[1])
            for lo in range(0, len(codes), step):
                some = codes[lo : lo + step]
                x, y = some // len(n), some % len(n)
                apart = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                found.append(some[apart <= (1 - 2 * need) * (n[x] + n[y]) + 1e-6])

        a, step, waiting = np.arange(len(t)), 0, 0
        while len(a):
            step += 1
            a = a[a + step < len(t)]
            a = a[(t[a] == t[a + step]) & (size[a] >= threshold * size[a + step] - 1e-6)]  # by size within a token: who fails now fails later
            b = a + step
            x, y = row[a], row[b]
            ok = (np.minimum(rest[a], rest[b]) >= need * (size[a] + size[b]) - 1e-6) & (own[x] | own[y]) & (x != y)
            ok &= (blk[x] != blk[y]) | (not cross)
            x, y = x[ok], y[ok]
            held.append(np.minimum(x, y) * len(n) + np.maximum(x, y))
            waiting += len(x)
            if waiting > 1 << 22 or len(held) > 1000:
                sifted()
                waiting = 0
        if held:
            sifted()
        codes = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
        x, y = d[codes // max(1, len(n))], d[codes % max(1, len(n))]
        return pa.table([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

    return run


def _compared(threshold: float):
    """Arrow function of a cell's pairs (u, v) and sets (d, x): the similar pairs with their similarity."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        ids, one = np.unique(sets.column("d").to_numpy(), return_index=True)
        x = sets.column("x").combine_chunks().take(pa.array(one))
        size = x.value_lengths().to_numpy().astype(np.int64)
        names, flat = np.unique(x.flatten().to_numpy(), return_inverse=True)
        start = np.cumsum(size) - size
        u, v = (np.searchsorted(ids, pairs.column(c).to_numpy()) for c in ("u", "v"))
        order = np.argsort(u, kind="stable")
        u, v = u[order], v[order]
        both, mark = np.zeros(len(u), np.int64), np.zeros(len(names) + 1, bool)
        first = np.append(np.flatnonzero(np.diff(u, prepend=-1)), len(u))
        for lo, hi in pairwise(first.tolist()):
            own = flat[start[u[lo]] : start[u[lo]] + size[u[lo]]]
            mark[own] = True
            while lo < hi:
                upto = np.cumsum(size[v[lo:hi]])
                to = lo + max(1, int(np.searchsorted(upto, 1 << 21, side="right")))
                w = v[lo:to]
                ends = upto[: len(w)]
                at = np.arange(ends[-1]) + np.repeat(start[w] - (ends - size[w]), size[w])
                both[lo:to] = np.add.reduceat(mark[flat[at]].astype(np.int64), ends - size[w])
                lo = to
            mark[own] = False
        alike = both / np.maximum(1, size[u] + size[v] - both)
        ok = alike >= threshold
        return pa.table([pa.array(ids[u[ok]]), pa.array(ids[v[ok]]), pa.array(alike[ok])], ["u", "v", "similarity"])

    return run


def _ranked(sets: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of tokens found most in a random sample, sorted, and the place of each, the most frequent last. They only set an order: results do not depend on them."""
    sample = sets.select("x").sample(min(1.0, SAMPLE_ROWS / max(1, rows)), seed=7)
    top = sample.select(F.explode("x").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f")).orderBy(F.col("f").desc(), "t").limit(RANKED).select("t").collect()
    t = np.array([r["t"] for r in top] or [0], np.int64)
    order = np.argsort(t)
    return t[order], len(t) - order


def _expanded(pairs: DataFrame, members: DataFrame, copies: int = 1000) -> DataFrame:
    """(a, b, similarity), a < b, of rows from pairs (u, v) of sets and the rows (d, o) of each; rows of one set have similarity 1.

    Rows of a set with many are dealt over blocks of ``copies``, and their partners go to each of these.
    """
    sizes = members.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / copies).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"))
    rows = members.join(sizes, "d").select("d", "o", "m", "blocks", F.pmod(F.xxhash64("o"), F.col("blocks")).cast("int").alias("blk"))
    left = rows.select("d", "blk", F.col("o").alias("a"))
    many = rows.where("m > 1").select("d", F.col("o").alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    equal = left.join(many, ["d", "blk"]).where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    wide = pairs.join(sizes.select(F.col("d").alias("u"), "blocks"), "u").select("u", "v", "similarity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
    far = wide.join(left.withColumnRenamed("d", "u"), ["u", "blk"]).join(members.select(F.col("d").alias("v"), F.col("o").alias("b")), "v")
    return equal.unionByName(far.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"))


def _neighbours_together(pairs: DataFrame, blocks: int, crowd: int = CROWD) -> DataFrame:
    """(u, v, i, j): pairs with the blocks of their sets, in order of the blocks. Sets with one least neighbour, themselves included,
    go to one block, so near copies meet in it; more than ``crowd`` of them go to a block for each ``crowd``."""
    both = pairs.select(F.col("u").alias("d"), F.col("v").alias("x")).union(pairs.select(F.col("v").alias("d"), F.col("u").alias("x")))
    near = both.groupBy("d").agg(F.min("x").alias("x")).select("d", F.least("d", "x").alias("g"))
    sizes = near.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / crowd).alias("m"))
    near = cut(near.join(sizes, "g").select("d", F.pmod(F.xxhash64("g", F.pmod(F.xxhash64("d"), F.col("m"))), F.lit(blocks)).cast("int").alias("k")))
    side = lambda c, k: near.select(F.col("d").alias(c), F.col("k").alias(k))
    return pairs.join(side("u", "p"), "u").join(side("v", "q"), "v").select("u", "v", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))


def similar_pairs(df: DataFrame, order: str, tokens: str, threshold: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(a, b, similarity), a < b, of all rows whose token sets have a Jaccard similarity of ``threshold`` (above 0) or more.

    Sets are 8-byte hashes, equal ones stand as one until the end. Prefix filter: in any one order of the tokens, similar
    sets share one of their first n - ceil(threshold * n) + 1 tokens. A cell holds a part of the tokens of a band of
    sizes, with a sketch of each set as wide as the band needs, which travels once for a cell and not with each token;
    it lets through what places, sizes and sketches cannot rule out. Sets are fetched for these pairs only, once for each
    pair of blocks that they meet in; near copies lie in one block. The filters lose no pair, and nothing is cut.
    """
    sets = df.select(F.col(order).alias("o"), here(hashed(tokens)).alias("x")).where(F.size("x") > 0)
    sets = cut(sets.select("o", "x", F.size("x").alias("n"), F.xxhash64("x").alias("d")))  # texts are folded once
    sizes = sets.groupBy("n").agg(F.count(F.lit(1)).alias("rows")).toPandas()
    bands = _Bands(sizes["n"].to_numpy().astype(np.int64), sizes["rows"].to_numpy(), threshold, cell_rows)
    cells = sets.select("d", "x").mapInArrow(_posted(bands, *_ranked(sets, int(sizes["rows"].sum()))), _CELLS)
    pairs = cut(cells.groupBy("band", "part", "i", "j").applyInArrow(_met(threshold), "u long, v long").distinct())
    members = sets.select("d", "o")
    firsts = sets.groupBy("d").agg(F.min("o").alias("rep"), F.first("n").alias("n"))
    needed = cut(pairs.select(F.col("u").alias("d")).union(pairs.select(F.col("v").alias("d"))).distinct().join(firsts, "d"))
    room = needed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] * 8
    blocks = max(1, -(-room // BLOCK_BYTES), -(-pairs.count() // CELL_PAIRS))
    dealt = cut(_neighbours_together(pairs, blocks))
    wanted = cut(dealt.select(F.col("u").alias("d"), "i", "j").union(dealt.select(F.col("v").alias("d"), "i", "j")).distinct().join(needed.select("d", "rep"), "d"))
    few = F.broadcast(wanted) if wanted.count() <= SENT else wanted
    fetched = sets.join(few.withColumnRenamed("d", "w"), (F.col("d") == F.col("w")) & F.col("o").eqNullSafe(F.col("rep"))).select("i", "j", "d", "x")
    alike = cut(dealt.groupBy("i", "j").cogroup(fetched.groupBy("i", "j")).applyInArrow(_compared(threshold), "u long, v long, similarity double"))
    return _expanded(alike, members)


def _in_sequence(edges: DataFrame) -> DataFrame:
    """(id) of the rows that the greedy rule drops: component by component, one edge after the other.

    A task holds the dropped ids of one component at a time; the edges pass through it.
    """
    kind = edges.schema["a"].dataType
    comp = connected_components(edges, "a", "b").select(F.col("id").alias("b"), F.col("component").alias("c"))
    rows = edges.join(comp, "b").select("c", "b", "a").repartition("c").sortWithinPartitions("c", "b", "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone = None, set()
        for batch in batches:
            out = []
            for c, b, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if c != now:
                    now, gone = c, set()
                if a not in gone and b not in gone:  # all edges that end in a have passed
                    gone.add(b)
                    out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.column(1).type)], ["id"])

    return rows.mapInArrow(run, StructType([StructField("id", kind)]))


def first_kept(pairs: DataFrame, max_rounds: int = 12) -> DataFrame:
    """(id, leader) for each row with an earlier row near it that is itself kept: the greedy rule in id order.

    ``pairs`` holds (a, b) with a < b. All rows without an undecided earlier neighbour are decided at
    once, round by round; what long chains leave after ``max_rounds`` is decided in sequence. The
    leader is the first kept row near the dropped one.
    """
    edges = cut(pairs.select("a", "b").distinct())
    undecided, gone = edges, edges.where("false").select(F.col("b").alias("id"))
    for _ in range(max_rounds):
        if undecided.isEmpty():
            break
        waiting = undecided.select(F.col("b").alias("a")).distinct()
        ready = undecided.join(waiting, "a", "left_anti")  # here a is kept for sure
        now = cut(ready.select(F.col("b").alias("id")).distinct())
        gone = gone.union(now)
        left = undecided.join(now.select(F.col("id").alias("b")), "b", "left_anti").join(now.select(F.col("id").alias("a")), "a", "left_anti")
        undecided = cut(left)
    if not undecided.isEmpty():
        gone = gone.union(cut(_in_sequence(undecided)))
    kept = edges.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_semi")
    return kept.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))


def near_copies(df: DataFrame, order: str, tokens: str, group: str, threshold: float) -> DataFrame:
    """(id, leader) of rows near an earlier kept row of their group."""
    pairs, copies = set_join(df, order, tokens, group, threshold)
    dropped = cut(first_kept(pairs))
    more = copies.join(dropped.select(F.col("id").alias("rep"), "leader"), "rep", "left").select("id", F.coalesce("leader", "rep").alias("leader"))
    return dropped.unionByName(more)


def clusters(edges: DataFrame, prefix: str) -> DataFrame:
    """(ord, cluster): components numbered by their first member."""
    comp = cut(connected_components(edges, "a", "b"))
    number = numbered(comp.select("component").distinct(), [], ["component"], "k")
    name = F.format_string(f"{prefix}-%04d", "k")
    return comp.join(number, "component").select(F.col("id").alias("ord"), name.alias("cluster"))


def coordination_edges(df: DataFrame, similarity: float, story: float, hours: float, min_length: int = 24) -> DataFrame:
    """(a, b) of rows (ord, author, folded, toks, media, ts) that different authors share.

    Equal texts of at least ``min_length`` characters and two or more authors are linked to their first
    row, however far apart. Near texts of different authors are linked within ``hours`` of each other;
    a row without a time is near no other. What media alone share is a story and left out.
    """
    rows = df.select("ord", "toks", "media", F.col("ts").cast("timestamp").alias("ts"), F.nullif("author", F.lit("")).alias("author"))
    same = df.where(F.length("folded") >= min_length).select("ord", "media", F.nullif("author", F.lit("")).alias("author"), F.sha2("folded", 256).alias("k"))
    groups = same.groupBy("k").agg(F.min("ord").alias("a"), F.count_distinct("author").alias("authors"), F.bool_and("media").alias("story")).where("authors >= 2 AND NOT story")
    exact = same.join(groups.select("k", "a"), "k").where("ord > a").select("a", F.col("ord").alias("b"))
    if rows.where("ts IS NOT NULL").isEmpty():  # then no text is near another
        return exact
    timed = rows.where("ts IS NOT NULL")
    side = lambda k: timed.select(F.col("ord").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("author", "media", "ts")])
    near = similar_pairs(timed, "ord", "toks", similarity).join(side("a"), "a").join(side("b"), "b")
    told = F.col("media_a") & F.col("media_b") & (F.col("similarity") >= story)
    close = F.abs(F.unix_micros("ts_a") - F.unix_micros("ts_b")) <= int(hours * 3600e6)
    near = near.where(~F.coalesce(F.col("author_a") == F.col("author_b"), F.lit(False)) & ~told & close)
    return exact.unionByName(near.select("a", "b")).distinct()


def interval_join(left: DataFrame, right: DataFrame, key: str, span: float) -> DataFrame:
    """Pairs of rows with equal keys and at most ``span`` seconds apart: time buckets of the span's size meet their neighbours.

    Both sides need the column ``sec`` (seconds); columns get the suffixes _a and _b.
    """
    l = left.select([F.col(c).alias(f"{c}_a") for c in left.columns]).withColumn("_t", F.floor(F.col("sec_a") / span))  # noqa: E741
    r = right.select([F.col(c).alias(f"{c}_b") for c in right.columns]).withColumn("_t", F.explode(F.array(*[F.floor(F.col("sec_b") / span) + d for d in (-1, 0, 1)])))
    return l.join(r, (F.col(f"{key}_a") == F.col(f"{key}_b")) & (l["_t"] == r["_t"]) & (F.abs(F.col("sec_a") - F.col("sec_b")) <= span)).drop("_t")
