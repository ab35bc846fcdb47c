"""Review state, evidence and raw-row rules on small cases."""

import pytest
from pyspark.sql import functions as F

from lodemark.operators import inventory as I
from lodemark.operators import normalize as N
from lodemark.operators import review as R


def test_latest_decision_wins_and_clear_takes_back(spark):
    records = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    rows = [("a", "keep", "x", 1, 1), ("a", "exclude", "y", 2, 2), ("b", "keep", "x", 1, 3), ("b", "clear", "x", 1, 4), ("c", "clear", "x", 1, 5), ("c", "keep", "z", 1, 6), ("gone", "keep", "x", 9, 7)]
    out = R.decided(records, spark.createDataFrame(rows, "id string, action string, reviewer string, at int, seq int"))
    assert {r["id"]: (r["verdict"], r["reviewer"], r["n_reviews"]) for r in out.collect()} == {"a": ("exclude", "y", 2), "b": (None, None, 0), "c": ("keep", "z", 1), "d": (None, None, 0)}


def test_investigations_are_checked(spark):
    items = spark.createDataFrame([("t", 1, 5.0, 2.0, 1), ("t", 1, 9.0, 2.0, 2), ("s", 1, 7.0, 1.0, 3)], "type string, day int, priority double, confidence double, ord int")
    assert [(r["investigation_id"], r["type"], r["priority"]) for r in R.numbered(items, ["type", "day"]).orderBy("investigation_id").collect()] == [("INV-001", "s", 7.0), ("INV-002", "t", 5.0)]
    with pytest.raises(ValueError, match="more than 1"):
        R.numbered(items, ["type", "day"], limit=1)


def test_equal_investigations_are_numbered_by_their_keys(spark):
    items = spark.createDataFrame([("t", "b", 5.0, 2.0, 1), ("t", "a", 5.0, 2.0, 3), ("s", "c", 5.0, 2.0, 2)], "type string, about string, priority double, confidence double, ord int")
    assert [(r["type"], r["about"]) for r in R.numbered(items, ["about", "type"]).orderBy("investigation_id").collect()] == [("s", "c"), ("t", "a"), ("t", "b")]


def test_raw_rows(spark):
    cases = [('{"id":"diag:1","text":"x"}', True), ('{"status":"ABORTED"}', True), ('{"error":"no_items"}', True), ('{"error":"no_items","caption":"x"}', False), ('{"error":""}', False), (None, False), ("[1]", False), ("x", False)]
    got = spark.createDataFrame(cases, "raw string, want boolean").select("want", R.is_diagnostic(F.col("raw")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)
    deep = spark.createDataFrame([('{"a":1,"b":{"c":"x","d":null},"e":[1]}',), ("no",), (None,)], "raw string")
    assert sorted((r["path"], r["value"]) for r in N.scalar_paths(deep, "raw").where("value IS NOT NULL").collect()) == [("$.a", "1"), ("$.b.c", "x")]


def test_upsert_keeps_the_last(spark):
    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 5), ("b", 3, 1)], "id string, v int, o int")
    new = spark.createDataFrame([("b", 4, 9), ("b", 5, 2), ("c", 6, 1)], "id string, v int, o int")
    assert {r["id"]: r["v"] for r in N.upsert(old, new, ["id"], "o").collect()} == {"a": 2, "b": 4, "c": 6}
    assert [r["id"] for r in N.added(old, new, ["id"]).collect()] == ["c"]


def test_terms(spark):
    df = spark.createDataFrame([(["a", ' b "c" '],), ([],)], "x array<string>")
    assert [tuple(r) for r in df.select(R.or_group(F.col("x")), R.negatives(F.col("x"))).collect()] == [('(a OR "b c")', '-a -"b c"'), ("", "")]


def test_figures_round_as_doubles_do_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    values = [21.40385, 1.00005, 2.67515, -21.40385, 1.005, 0.0, 12345678.00005, 0.5]
    want = [duckdb.connect().execute("SELECT round(CAST(? AS DOUBLE), 4)", [v]).fetchone()[0] for v in values]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(I._num(F.col("v")).cast("double").alias("x")).collect()
    assert [r["x"] for r in got] == want != [float(r["x"]) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(F.round("v", 4).alias("x")).collect()]


def test_inventory_of_nothing_and_of_nulls(spark):
    """Every indicator once, whatever the data; nothing is available without records."""
    from lodemark.sources import fixtures as X

    w = X.weighted(spark, "/root/testdata/sf0.001").withColumn("market_score", F.lit(None).cast("double")).withColumn("decision", F.lit("trusted"))
    labels = [("positive", "neutral", "negative"), X.EMOTIONS, ("supportive", "critical"), ("person", "media")]
    none = I.inventory(w.where("false"), *labels).collect()
    assert sorted(r["indicator_id"] for r in none) == sorted(i for i, _ in I.INDICATORS) and len(I.INDICATORS) == 25
    assert not any(r["available"] or r["value"] for r in none)
    gone = w.select(*[(F.lit(None).cast(f.dataType) if f.name != "id" else F.col("id")).alias(f.name) for f in w.schema.fields]).limit(3)
    nulls = {r["indicator_id"]: r for r in I.inventory(gone, *labels).collect()}
    assert len(nulls) == 25 and nulls["sample_volume"]["available"] and not nulls["brand_reputation"]["available"] and not nulls["market_relevance"]["available"]
