"""Queries against their SQL on the smallest data: a sample of each kind (the full set is in the driver's gate)."""

import pytest

from lodemark.plans import evidence, registry, texts  # noqa: F401

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["reputation_index", "daily_series", "driver_rows", "top_mentions", "text_fold", "clean_decision", "decision_partitions", "array_uniq", "collision_bigrams", "flatten_threads", "series_change", "stratified_sample", "upsert_append", "indicator_inventory"]


def plain(v):
    return None if v is None or v != v else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(registry.ORACLE[name])
    cols = [d[0] for d in rel.description]
    df = registry.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    got = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall()), key=str)
    assert got == want


def test_plan_reaches_all_decisions(spark):
    rows = registry.QUERIES["decision_partitions"](spark, "/root/testdata/sf0.01").collect()
    assert {r["decision"] for r in rows} == {"trusted", "review", "excluded"}
