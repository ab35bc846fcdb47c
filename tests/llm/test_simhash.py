"""Fingerprints against a plain vote, the edits against slices in order, and the search against all pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodemark.llm import simhash
from lodemark.llm import words as W

from .conftest import SF, WORD


def plain_print(text):
    """The fingerprint by a vote for each bit; only the word hashes are shared."""
    words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text or "")]

    def hashed(ws):
        data, off = W.text_buffers(pa.array([" ".join(ws)], pa.large_string()))
        return int(W.grams(W.word_hashes(data, off)[0], len(ws))[0])

    terms = Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter([tuple(words)] if words else [])
    votes = [0] * simhash.BITS
    for t, n in terms.items():
        h = np.array([hashed(t)], np.uint64)
        weight = min(15, n.bit_length())
        for k, salt in enumerate(simhash._SALT):
            bits = int(W.mix(h ^ salt)[0])
            for j in range(64):
                votes[64 * k + j] += weight if bits >> j & 1 else -weight
    return bytes(sum((votes[8 * b + j] > 0) << j for j in range(8)) for b in range(simhash.BITS // 8)).hex()


def hamming(x, y):
    return (int(x, 16) ^ int(y, 16)).bit_count()


def check(df, every=100, radius=simhash.RADIUS, blocks=simhash.BLOCKS):
    tie = {(r["doc_id"], r["text"]): r["t"] for r in df.select("doc_id", "text", F.xxhash64(F.col("text").cast("string")).alias("t")).collect()}
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), -tie[r]))
    want = []
    for (i, t), (_, f) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, f = t or "", f or ""
        edited = t[: len(t) - len(t) // 3] + f[: len(t) // 3]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, f))
    got = simhash.fingerprint_documents(df, every, radius, blocks).collect()
    prints = [r["fingerprint"] for r in got]
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted((str(w[0]), w[1], w[2]) for w in want)
    for r in got:
        assert r["n_within"] == (sum(hamming(r["fingerprint"], p) <= radius for p in prints) - 1 if r["doc_id"] is not None and r["doc_id"] % every == 0 else None)
    return got, want


def test_odd_rows(spark, odd_docs):
    got, want = check(odd_docs.repartition(5), every=2)
    of = {(str(w[0]), w[1], w[2]): w for w in want}
    for r in got:
        _, n, _, text, edited, following = of[str(r["doc_id"]), r["n_chars"], r["edited_sha256"]]
        if n < 5000:
            assert r["fingerprint"] == plain_print(text) and r["edited_fingerprint"] == plain_print(edited)
            likeness = [max(0.0, np.cos(np.pi * hamming(r["fingerprint"], plain_print(x)) / simhash.BITS)) for x in (edited, following) if len(x) < 5000]
            assert np.allclose([r["near_edited"], r["near_next"]][: len(likeness)], likeness)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(7, "a b c d e f", 1)], "doc_id int, text string, part int")
    (r,), _ = check(one)
    assert r["near_next"] == r["near_edited"] * 0 + 1.0
    assert simhash.fingerprint_documents(one.limit(0)).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_order_over_tasks(spark, partitions):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got, _ = check(docs)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    near, far = sorted(r["near_edited"] for r in got), sorted(r["near_next"] for r in got)
    assert near[len(near) // 20] > far[-len(far) // 20 - 10]


def test_search_finds_every_partner(spark):
    """Planted fingerprints at each distance, and a crowd around one centre."""
    r = random.Random(3)
    base = [r.getrandbits(128) for _ in range(60)]
    for b in base[:30]:
        for k in range(10):
            x = b
            for j in r.sample(range(128), k):
                x ^= 1 << j
            base.append(x)
    base = sorted(set(base + [base[0] ^ 1 << i ^ 1 << j for i in range(40) for j in range(i)]))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(signed(x & (1 << 64) - 1), signed(x >> 64)) for x in base]
    every = spark.createDataFrame(rows, "hi long, lo long")
    asked = rows[::7]
    for radius, blocks in ((6, 8), (3, 5), (0, 2), (2, 5)):
        found = simhash.within(every, spark.createDataFrame(asked, "hi long, lo long"), radius, blocks).collect()
        got = [tuple(x[c] for c in ("hi", "lo", "to_hi", "to_lo", "distance")) for x in found]
        bits = lambda x, y: ((x[0] ^ y[0]) & (1 << 64) - 1).bit_count() + ((x[1] ^ y[1]) & (1 << 64) - 1).bit_count()
        assert len(got) == len(set(got))
        assert sorted(got) == sorted((*x, *y, bits(x, y)) for x in asked for y in rows if bits(x, y) <= radius)


def test_many_terms_and_weights():
    """Sums go past what one run of lanes holds; heavy terms reach the largest weight."""
    text = " ".join(f"w{i} x" for i in range(6000)) + " y y" * 40_000
    short = " ".join(f"w{i} x" for i in range(50)) + " y y" * 300
    for t in (text, short):
        assert simhash.fingerprints(pa.array([t]))[0].tobytes().hex() == plain_print(t)
    both = simhash.fingerprints(pa.array([text, short, text, None, ""]))
    assert (both[0] == both[2]).all() and not both[3:].any()
