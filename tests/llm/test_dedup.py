import hashlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemark.llm import embed, minhash, substring, words
from tests.llm.conftest import SF, WORD, rows_of

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def brute_near(rows):
    sets = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    links = [(i, j) for (i, s), (j, t) in combinations(sets, 2) if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    return {i: len(s) for i, s in sets}, components({i for i, _ in sets}, links)


def check_near(df, rows):
    sizes, comp = brute_near(rows)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (sizes[r["doc_id"]], comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_odd(spark, odd_docs):
    check_near(minhash.near_duplicates(odd_docs), rows_of(odd_docs))
    assert minhash.near_duplicates(odd_docs.limit(0)).collect() == []


def test_near_duplicates_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_near(minhash.near_duplicates(docs), rows_of(docs))


def test_near_duplicates_large_group(spark):
    rng = np.random.default_rng(5)
    base = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(120):  # each copy differs in one word; copies are often too far from each other
        w = list(base)
        w[int(rng.integers(60))] = f"z{i}"
        if i % 3:
            w[int(rng.integers(60))] = f"y{i}"
        rows.append((i, " ".join(w), "s"))
    check_near(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string")), rows)
    small = spark.createDataFrame(rows, "doc_id long, text string, source string")
    check_near(minhash.near_duplicates(small, limit=400), rows)  # families in blocks


def test_agreeing_counts_all_lists():
    rng = np.random.default_rng(4)
    sig = (np.arange(8) << 32) | rng.integers(0, 3, (60, 8))
    flat = sig.ravel()
    order = np.argsort(flat, kind="stable")
    for p in range(60):
        got = minhash._agreeing(flat[order], order // 8, sig[p], 5, 60)
        assert got.tolist() == np.flatnonzero((sig == sig[p]).sum(axis=1) >= 5).tolist()


def test_recall_of_the_signatures():
    """Pairs at the threshold are found with the chance that the README states."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(400):
        same, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (150, 25, 25))
        a, b = np.concatenate((same, one)), np.concatenate((same, two))
        mul = (words.mix(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1))[:, None]
        missed += int(((a * mul).min(axis=1) == (b * mul).min(axis=1)).sum() < minhash.MATCH)
    assert missed <= 2


def brute_removed(rows, width=13):
    least = {}
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - width + 1):
            if i is not None:
                key = tuple(w[k : k + width])
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t, _ in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(x):
    return (x[0] is None, x[0] or 0, x[1:])


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_remove_repeats(spark, odd_docs, batches):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(odd_docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", "source"))
    got = substring.remove_repeats(docs, batches=batches, fanout=3, bucket_entries=500, chunk_bytes=50_000)
    got = [tuple(r)[:4] for r in got.collect()]
    assert sorted(got, key=key) == sorted(brute_removed(rows_of(docs)), key=key)


def test_remove_repeats_empty(spark, odd_docs):
    assert substring.remove_repeats(odd_docs.limit(0)).collect() == []


def test_index_is_incremental(spark, odd_docs, tmp_path):
    docs = odd_docs.where("doc_id is not null")
    index = substring.FingerprintIndex(spark, f"file://{tmp_path}/i", 4, 4, fanout=2)
    for low, high in ((0, 3), (3, 10), (10, 99)):
        index.append(docs.where((F.col("doc_id") > low) & (F.col("doc_id") <= high)))
    assert len(index.runs) == 1  # compacted
    flagged = {int(x) for r in index.shared().collect() for x in np.frombuffer(r["a"], np.int64)}
    assert {1, 2, 4, 10, 11} <= flagged and 3 not in flagged


def test_word_hashes_pieces(monkeypatch):
    import pyarrow as pa

    texts = ["a bb  ccc\n", "", "dddd", "e f" * 50, "ü ß " * 9, " x", "y" * 300 + " z"]
    data, off = words.text_buffers(pa.array(texts))
    whole = words.word_hashes(data, off)
    for size in (5, 16, 64):
        monkeypatch.setattr(words, "PIECE", size)
        for a, b in zip(whole, words.word_hashes(data, off), strict=True):
            assert (a == b).all()
    flat = [w for t in texts for w in WORD.findall(t)]
    assert len(whole[0]) == len(flat) and len(set(whole[0].tolist())) == len(set(flat))
    assert np.diff(whole[3]).tolist() == [len(WORD.findall(t)) for t in texts]


def test_near_vectors_odd(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    rows = []
    for i in range(160):
        v = base[i % 40] + rng.normal(size=8) * (0.06 if i % 4 else 0.0)
        rows.append((i, [float(np.float32(x)) for x in v * (1 + i % 3)], i % 3 if i % 17 else None, 1))
    rows += [(500, None, 1, 1), (501, [0.0] * 8, 1, 1), (502, [float("nan")] * 8, 1, 1), (503, [None] * 8, 1, 1), (504, [1.0, 2.0], 1, 1), (505, [1.0, 2.0], 1, 1), (506, [], 1, 1), (507, rows[1][1], rows[1][2], 1), (None, rows[1][1], 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n_links int")
    got = {r["vec_id"]: r for r in embed.near_vectors(df).collect()}
    assert len(got) == len(rows)
    fine = [(i, np.array(v, np.float64), g) for i, v, g, _ in rows if i is not None and g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(i, j) for (i, a, g), (j, b, h) in combinations(fine, 2) if g == h and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98]
    assert len(links) > 30
    comp = components([r[0] for r in rows if r[0] is not None], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for i in comp:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], comp[i], comp[i] == i)
    assert embed.near_vectors(df.limit(0)).collect() == []


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(9)
    seen = list(embed.traverse(a, b, 0.9))
    sums = [a[i] + b[j] for i, j in seen]
    assert sums == sorted(sums) and len(set(seen)) == len(seen)
    assert len(seen) == sum(x + y <= 0.9 for x in a for y in b)
