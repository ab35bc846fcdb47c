"""SimHash fingerprints, and all fingerprints within a Hamming radius.

Terms of a text are its pairs of neighbouring words (A-Z lower-cased; a single word counts as one term),
each weighted by 1 + floor(log2(times)), at most 15. A term's 128 hash bits vote with its weight, and a
fingerprint has the bits whose ones outweigh their zeros. Two fingerprints that differ in h bits come
from term vectors whose angle is about pi * h / 128; their likeness is its cosine, at least 0.

Search: the bits are cut into blocks. Fingerprints that differ in at most ``radius`` bits agree wholly
on ``blocks - radius`` blocks, whichever these are, so there is a table for each choice of so many
blocks, keyed by them, and a join on table and key meets every partner. A pair counts in the first
table that holds it, and only if the whole fingerprints are near. Equal fingerprints are one entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemark.llm import words as W
from lodemark.session import cut

U = np.uint64
BITS, WORDS = 128, 2
RADIUS, BLOCKS = 6, 8
#: Weights that a 16-bit sum holds, and with it the terms that are added at once.
HEAVIEST = 15
AT_ONCE = 65535 // HEAVIEST
#: For each byte its bits as sums of 16 bits, four to a number.
LANES = np.array([[sum((b >> (4 * half + j) & 1) << (16 * j) for j in range(4)) for half in (0, 1)] for b in range(256)], U)
_SALT = [U(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(BITS // 64)]


def _terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct term hashes, their weights, and for each text the number of them."""
    h, _, _, first = W.word_hashes(data, off, lower=True)
    g = W.grams(h, WORDS)
    terms, weights, n = [np.zeros(0, U)], [np.zeros(0, np.int64)], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        x = g[a : b - WORDS + 1] if b - a >= WORDS else W.whole(h[a:b]) if b > a else h[a:b]
        u, times = np.unique(x, return_counts=True)
        terms.append(u)
        weights.append(np.minimum(HEAVIEST, np.frexp(times)[1]))
        n.append(len(u))
    return np.concatenate(terms), np.concatenate(weights), np.array(n, np.int64)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text as ``BITS // 64`` numbers; zeros without a word."""
    out = np.zeros((len(texts), BITS // 64), U)
    for lo in range(0, len(texts), 64):
        data, off = W.text_buffers(texts.slice(lo, 64))
        terms, weights, n = _terms(data, off)
        total = np.concatenate(([0], np.cumsum(weights)))
        ends = np.cumsum(n)
        for k in np.flatnonzero(n).tolist():  # runs of terms whose sums fit their lanes
            a, b = int(ends[k] - n[k]), int(ends[k])
            ones = np.zeros(BITS, np.int64)
            for p in range(a, b, AT_ONCE):
                some = slice(p, min(b, p + AT_ONCE))
                bits = np.stack([W.mix(terms[some] ^ s) for s in _SALT], axis=1).view(np.uint8)
                lanes = (LANES[bits] * weights[some, None, None].astype(U)).sum(axis=0, dtype=U)
                ones += lanes.reshape(-1).view(np.uint16).astype(np.int64)
            out[lo + k] = np.packbits(2 * ones > total[b] - total[a], bitorder="little").view(U)
    return out


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The cosine that the number of differing bits stands for, 0 to 1."""
    return np.maximum(0.0, np.cos(pi * np.bitwise_count(one ^ other).sum(axis=1) / BITS))


def _hex(f: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in f]


#: ``part`` marks rows of the first pass: 0 done, 1 the first text of a task, 2 its last, whose next text another task has.
ROW = "part int, doc_id long, tie long, text string, n_chars long, edited_sha256 string, hi long, lo long, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]] for c in ROW.split(", ")]


def _done(ids: list, texts: list[str], following: list[str], prints: np.ndarray, next_prints: np.ndarray) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 3] + f[: len(t) // 3] for t, f in zip(texts, following, strict=True)]
    of_edited = fingerprints(pa.array(edited, pa.large_string()))
    n = len(ids)
    parts = prints.view(np.int64).reshape(n, 2)
    cols = [[0] * n, ids, [0] * n, [None] * n, [len(t) for t in texts], [hashlib.sha256(e.encode()).hexdigest() for e in edited], parts[:, 0], parts[:, 1], _hex(prints), _hex(of_edited), likeness(prints, of_edited), likeness(prints, next_prints)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], _NAMES)


def _edge(part: int, doc_id: int | None, tie: int, text: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, doc_id, tie, text, *[None] * 8), _TYPES, strict=True)], _NAMES)


def _along(together: int = 128) -> Callable:
    """Rows (doc_id, tie, text) of a task in their order, each with the text after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: tuple[list, list[str], list[int]] = ([], [], [])
        prints = np.zeros((0, BITS // 64), U)
        begun = False
        for batch in batches:
            for lo in range(0, batch.num_rows, together):
                part = batch.slice(lo, together)
                ids, ties = part.column("doc_id").to_pylist(), part.column("tie").to_pylist()
                col = part.column("text").fill_null("")
                texts = col.to_pylist()
                if not begun:
                    yield _edge(1, ids[0], ties[0], texts[0])
                    begun = True
                ids, texts, ties = left[0] + ids, left[1] + texts, left[2] + ties
                prints = np.concatenate((prints, fingerprints(col)))
                if len(ids) > 1:
                    yield _done(ids[:-1], texts[:-1], texts[1:], prints[:-1], prints[1:])
                left, prints = (ids[-1:], texts[-1:], ties[-1:]), prints[-1:]
        if begun:
            yield _edge(2, left[0][0], left[2][0], left[1][0])

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            texts, following = part.column("text"), part.column("following")
            yield _done(part.column("doc_id").to_pylist(), texts.to_pylist(), following.to_pylist(), fingerprints(texts), fingerprints(following))


def successive(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, hi, lo, fingerprint, edited_fingerprint, near_edited, near_next) for each row, by descending doc_id.

    Texts are dealt by ranges of doc_id, one shuffle; the last text of a task meets the first one of the
    next task in a second pass over two rows a task. Rows that repeat a doc_id follow in the order of
    a hash of their texts; a null doc_id comes last.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    first = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_along(), ROW))
    # tasks in order of their first rows; two rows a task
    edge = first.where("part > 0").select("doc_id", "tie", "part")
    w = Window.orderBy(*order, "part")
    nexts = edge.select("doc_id", "tie", "part", F.lead(F.struct("doc_id", "tie")).over(w).alias("to"), F.first(F.struct("doc_id", "tie")).over(w).alias("wrap")).where("part = 2")
    nexts = nexts.select("doc_id", "tie", F.coalesce("to", "wrap").alias("to"))
    texts = first.where("part = 1").select(F.struct("doc_id", "tie").alias("to"), F.col("text").alias("following"))
    last = first.where("part = 2").select("doc_id", "tie", "text")
    same = (F.col("l.doc_id").eqNullSafe(F.col("x.doc_id"))) & (F.col("l.tie") == F.col("x.tie"))
    joined = last.alias("l").join(nexts.alias("x"), same).select("l.doc_id", "l.text", "x.to").join(texts.alias("t"), F.expr("x.to.doc_id <=> t.to.doc_id AND x.to.tie = t.to.tie"))
    rest = joined.select("l.doc_id", "l.text", "t.following").mapInArrow(_pairs, ROW)
    return first.where("part = 0").unionByName(rest).drop("part", "tie", "text")


def _tables(blocks: int, radius: int) -> list[tuple[int, ...]]:
    return list(combinations(range(blocks), blocks - radius))


def _block(hi: Column, lo: Column, k: int, blocks: int) -> Column:
    """The k-th of ``blocks`` ranges of bits, as a number."""
    a, b = BITS * k // blocks, BITS * (k + 1) // blocks
    if b <= 64 or a >= 64:
        of, a, b = (hi, a, b) if b <= 64 else (lo, a - 64, b - 64)
        return F.shiftrightunsigned(of, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long"))
    low = F.shiftrightunsigned(hi, a)
    return low.bitwiseOR(F.shiftleft(lo.bitwiseAND(F.lit((1 << (b - 64)) - 1).cast("long")), 64 - a))


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(hi, lo, to_hi, to_lo, distance): for each fingerprint of ``queries`` (hi, lo) all of ``prints`` (hi, lo) that differ in at most ``radius`` bits, itself included.

    Both sides hold each fingerprint once. ``blocks`` has to exceed ``radius``; more blocks give longer keys and more tables.
    """
    if not 0 <= radius < blocks or not 2 <= blocks <= 64:
        raise ValueError("blocks has to be above radius, at least 2 and at most 64")
    tables = _tables(blocks, radius)

    def keyed(df: DataFrame, *names: str) -> DataFrame:
        parts = [_block(F.col("hi"), F.col("lo"), k, blocks).alias(f"b{k}") for k in range(blocks)]
        key = F.array(*[F.struct(F.lit(i).alias("table"), F.xxhash64(*[F.col(f"b{k}") for k in t]).alias("key")) for i, t in enumerate(tables)])
        return df.select("hi", "lo", *parts).select(*[F.col(o).alias(n) for o, n in zip(("hi", "lo"), names, strict=True)], F.inline(key))

    one, other = keyed(queries, "hi", "lo"), keyed(prints, "to_hi", "to_lo")
    x, y = F.col("hi").bitwiseXOR(F.col("to_hi")), F.col("lo").bitwiseXOR(F.col("to_lo"))
    distance = F.bit_count(x) + F.bit_count(y)
    # the first blocks that agree name the first table
    agree = F.filter(F.array(*[F.when(_block(x, y, k, blocks) == 0, F.lit(k)) for k in range(blocks)]), lambda v: v.isNotNull())
    of = F.element_at(F.array(*[F.array(*[F.lit(k) for k in t]) for t in tables]), F.col("table") + 1)
    near = one.join(other, ["table", "key"]).where((distance <= radius) & (F.slice(agree, 1, blocks - radius) == of))
    return near.select("hi", "lo", "to_hi", "to_lo", distance.alias("distance"))


def fingerprint_documents(docs: DataFrame, every: int = 100, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_within) for each row of ``docs`` (columns doc_id, text).

    The edited text has the last third of the code points replaced by the beginning of the next text, by
    descending doc_id; after the last comes the first, so a single text is its own next. ``n_within``: how
    many other rows of the table have a fingerprint within ``radius`` bits, for rows whose doc_id ``every``
    divides; null for the others. A null text is empty, and an empty one has the fingerprint zero. Rows
    that repeat a doc_id each have their own; a null doc_id comes last. Other columns are ignored.
    """
    rows = cut(successive(docs))
    counts = rows.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"))
    asked = F.col("doc_id") % every == 0
    queries = rows.where(asked).select("hi", "lo").distinct()
    found = within(counts.select("hi", "lo"), queries, radius, blocks)
    found = found.join(counts.select(F.col("hi").alias("to_hi"), F.col("lo").alias("to_lo"), "n"), ["to_hi", "to_lo"])
    found = found.groupBy("hi", "lo").agg((F.sum("n") - 1).alias("n_within"))
    out = rows.join(found, ["hi", "lo"], "left").withColumn("n_within", F.when(asked, F.col("n_within")))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_within")
