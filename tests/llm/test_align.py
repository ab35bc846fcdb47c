"""Alignment against whole texts encoded at once and all pairs of tokens compared."""

import hashlib
import random
from collections import Counter

import pytest

from lodemark.llm import align

from .conftest import SF

NAMES = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(align.MODEL_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=align.MODEL_B)
    at = align.byte_alphabet()
    token = {i: t for t, i in a.get_vocab().items()}
    return a, b, lambda i: bytes(at[c] for c in token[i]), lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()


def links_of(models, text):
    """Tokens, groups and links of a whole text; None without tokens."""
    a, b, bytes_a, bytes_b = models
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    parts_a, parts_b = [bytes_a(i) for i in ids_a], [bytes_b(i) for i in ids_b]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return None

    def ranges(parts):
        at = 0
        for p in parts:
            yield at, at + len(p)
            at += len(p)

    ra, rb = list(ranges(parts_a)), list(ranges(parts_b))
    links, j0 = [], 0
    for i, (lo, hi) in enumerate(ra):
        while rb[j0][1] <= lo:
            j0 += 1
        j = j0
        while j < len(rb) and rb[j][0] < hi:
            links.append((ids_a[i], ids_b[j]))
            j += 1
    cuts = sorted({hi for _, hi in ra} & {hi for _, hi in rb})
    groups, i, j = [], 0, 0
    for hi in cuts:
        m, n = i, j
        while m < len(ra) and ra[m][1] <= hi:
            m += 1
        while n < len(rb) and rb[n][1] <= hi:
            n += 1
        groups.append(",".join(map(str, ids_a[i:m])) + "|" + ",".join(map(str, ids_b[j:n])))
        i, j = m, n
    return ids_a, ids_b, groups, links


def plain(models, rows):
    found = [(i, links_of(models, t)) for i, t in rows]
    count = Counter(p for _, x in found if x for p in x[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    for i, x in found:
        if x is None:
            yield i, 0, 0, 0, 0, 0, 0, ""
        else:
            yield i, len(x[0]), len(x[1]), len(x[2]), len(x[3]), sum(count[p] == best[p[1]] for p in x[3]), sum(count[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


def rows_of(df):
    return [tuple(r[c] for c in NAMES) for r in df.collect()]


ODD = ["a", "foo", " ", "  ", "\n", "\t", "\r", "é", "é", "　", " ", "ﬁ", "①", "▁", "​", "'s", "1", "12345", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "\x1c", "\x00", "한", "ｶﾞ", " ", "﻿", "😀", "Straße", "...", "(x)"]


def test_odd_texts(spark, models):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(ODD) for _ in range(r.randint(0, 24)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, " "), (2003, "x "), (2004, " x"), (2005, "x" * 3000), (None, "a b"), (2006, "a b"), (2006, "a b")]
    got = rows_of(align.align(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    same(got, plain(models, rows))
    assert sum(x[1] > 0 for x in got) > 500


def test_whole_table(spark, models, odd_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "text", "source AS groups", "n_chars AS n_a")
    same(rows_of(align.align(docs)), plain(models, [(r["doc_id"], r["text"]) for r in docs.collect()]))
    same(rows_of(align.align(odd_docs)), plain(models, [(r["doc_id"], r["text"]) for r in odd_docs.collect()]))
    assert align.align(docs.limit(0)).count() == 0


def test_small_bounds_change_nothing(spark, models, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    index = align.PairCounts.build(docs.repartition(3), limit=300)
    again = align.PairCounts.open(spark, index.folder)
    assert again.shards and sorted(again.shards) == sorted(index.shards)
    same(rows_of(align.align(docs, index=again)), plain(models, [(r["doc_id"], r["text"]) for r in docs.collect()]))


def test_groups_and_shards(spark):
    docs = spark.createDataFrame([(1, "to be or not to be")], "doc_id long, text string")
    row = align.align(docs, with_groups=True).first()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"] and row["groups"].count(";") == row["n_groups"] - 1
    index = align.PairCounts.build(docs)
    tok = align.Tokenizers()
    shards = align.Shards(index.folder, index.shards, len(tok.bytes_b))
    tok.learn({"be"})
    (keys,) = tok.table()[1:]
    assert shards.find(keys).tolist() == [2] and shards.find(keys + 1).tolist() == [0]
    assert sum(s[3] for s in index.shards) == 4
