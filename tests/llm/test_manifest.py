"""The manifest against hashlib, on odd rows and on groups of many sizes."""

import hashlib
import zlib

import duckdb
import pytest

from lodemark.llm import merkle

from .conftest import SF


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(level):
    """All levels of a tree, by hand."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def path(levels, at):
    for level in levels[:-1]:
        lo = at - at % 3
        yield level[lo:at], level[at + 1 : lo + 3]
        at //= 3


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r, text: h(*[framed(v) for v in (*r[:4], text)])
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda x: x[:3])
        trees[s] = climb([x[2] for x in groups[s]])
    top = climb([trees[s][-1][0] for s in names]) if names else []
    for k, s in enumerate(names):
        for i, (_, _, leaf_h, r) in enumerate(groups[s]):
            odd = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            acc, proof = leaf(r, r[4].replace("\n", "")) if odd else leaf_h, ""
            for before, after in [*path(trees[s], i), *path(top, k)]:
                acc, proof = h(*before, acc, *after), proof + "".join(before + after)
            root = top[-1][0]
            yield r[0], leaf_h, trees[s][-1][0], root, h(proof), acc, acc == root


NAMES = "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"


def check(df, rows):
    got = sorted((tuple(r[c] for c in NAMES) for r in merkle.prove(df).collect()), key=str)
    assert got == sorted(plain(rows), key=str)


def test_odd_rows(spark, odd_docs):
    df = odd_docs.selectExpr("*", "if(doc_id > 9, 'en', null) AS lang", "length(text) AS n_chars")
    check(df, [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()])


def test_many_sizes(spark):
    rows = [(i * 7 % 1000 + 1000 * k, f"s{k}" if k else None, "en", 3, f"a\nb{i}" if i % 3 else "c") for k, n in enumerate((1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 83, 243, 250, 700)) for i in range(n)]
    check(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"), rows)


def test_one_source_and_none(spark):
    schema = "doc_id int, source string, lang string, n_chars int, text string, idx string, steps string"
    rows = [(5, "only", None, 1, "x\ny", "a", "b")]
    check(spark.createDataFrame(rows, schema), [r[:5] for r in rows])
    assert merkle.prove(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("sf", [SF])
def test_same_as_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, merkle.prove(docs).collect())) == sorted(con.execute(merkle.ORACLE_SQL).fetchall())


def test_proof_finds_a_changed_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20).selectExpr("*")
    tree = merkle.manifest(docs, merkle.row_digest(docs["text"]), docs["source"], "doc_id", docs["doc_id"])
    rows = tree.proofs()
    from pyspark.sql import functions as F

    assert rows.where(merkle.fold(F.col("steps"), F.col("h")) != tree.root).count() == 0
    assert rows.where(merkle.fold(F.col("steps"), F.sha2(F.col("h"), 256)) == tree.root).count() == 0
