"""Investigations: local evidence by brute force, order and ids, and what the contract refuses."""

import pytest

from lodemark.operators import investigate as I

SCHEMA = "id string, platform string, author string, evidence_confidence double, impact_confidence double, weight double, day string, narrative string"


def records(spark):
    rows = [(f"r{i}", f"p{i % 3}", f"a{i % 7}", 0.5 + i % 5 / 10, float(i % 2), i % 11 / 10, f"d{i % 4}" if i % 9 else None, "n0" if i % 3 else "n1") for i in range(120)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_assemble(spark):
    rows, df = records(spark)
    asked = [("numeric_anomaly", "day", "d1", 61.0, 0.2), ("numeric_anomaly", "day", "d1", 50.0, 0.9), ("emerging_narrative", "narrative", "n1", 61.0, 0.1), ("period_shift", "all", None, 120.0, 0.0), ("source_divergence", "day", "none", 12.0, 0.0)]
    trig = spark.createDataFrame(asked, "type string, dimension string, value string, priority double, strength double")
    got = sorted(I.assemble(df, trig, ["day", "narrative"], 80.0, 70.0, 0.9, 0.5).collect(), key=lambda r: r["investigation_id"])
    assert [(r["type"], r["value"], r["priority"], r["level"]) for r in got] == [("period_shift", "", 100.0, "high"), ("numeric_anomaly", "d1", 61.0, "medium"), ("emerging_narrative", "n1", 61.0, "medium"), ("source_divergence", "none", 12.0, "low")]
    assert got[1]["confidence"] > got[2]["confidence"]  # decides between equal priorities
    assert [r["investigation_id"] for r in got] == ["INV-001", "INV-002", "INV-003", "INV-004"]
    of = {r["type"]: r for r in got}
    for kind, keep in (("numeric_anomaly", lambda r: r[6] == "d1"), ("emerging_narrative", lambda r: r[7] == "n1"), ("period_shift", lambda r: True)):
        local = [r for r in rows if keep(r)]
        assert of[kind]["n"] == len(local)
        assert of[kind]["evidence_ids"] == [r[0] for r in sorted(local, key=lambda r: (-r[5], r[0]))[:5]]
        assert "sample_shortfall" in of[kind]["caveats"] and "incomplete_source_coverage" not in of[kind]["caveats"]
        assert of[kind]["indicators"] == list(I.TYPES[kind])
    empty = of["source_divergence"]
    assert empty["n"] == 0 and empty["evidence_ids"] == [] and empty["status"] == "limited_evidence" and not empty["candidate"] and "small_local_evidence_base" in empty["caveats"]


def test_contract(spark):
    _, df = records(spark)
    columns = ["id", "day", "weight"]
    made = I.input_hash(df, columns)
    items = spark.createDataFrame([("INV-001",)], "investigation_id string")
    stale = lambda now: I.with_lineage(items, made, I.input_hash(now, columns)).first()["stale"]
    assert not stale(df.repartition(7, "day")) and stale(df.where("id <> 'r5'")) and stale(df.selectExpr("id", "if(id = 'r5', 'other', day) AS day", "weight")) and stale(df.union(df.limit(1)))
    assert I.input_hash(df.limit(0), columns).first()["n"] == 0
    I.check_frame({"topic": "a", "market": ""}, {"topic": "a", "market": "x"})
    with pytest.raises(ValueError, match="another topic"):
        I.check_frame({"topic": "a"}, {"topic": "b"})
    I.check_ids(df)
    for bad in (df.union(df.limit(1)), df.selectExpr("if(id = 'r1', null, id) AS id")):
        with pytest.raises(ValueError, match="id"):
            I.check_ids(bad)
    with pytest.raises(ValueError, match="unknown kind"):
        I.trigger("guess", "day", df, df["id"].isNotNull(), df["day"], df["weight"], df["weight"])


def test_triggers_weigh_the_evidence_once(spark, monkeypatch):
    from lodemark.functions import scores
    from lodemark.plans import investigations as P
    from lodemark.sources import fixtures as X

    seen, plain = [], scores.with_impact
    monkeypatch.setattr(scores, "with_impact", lambda *a: seen.append(1) or plain(*a))
    t = P.triggers(spark, "/root/testdata/sf0.001")
    assert len(seen) == 1 and t.count() > 5
    other = X.weighted(spark, "/root/testdata/sf0.001")  # afterwards each call stands for itself again
    assert len(seen) == 2 and "props" in other.columns
    with X.weighted_once(spark, "/root/testdata/sf0.001") as held:
        assert X.weighted(spark, "/root/testdata/sf0.001") is held and X.weighted(spark, "/root/testdata/sf0.01") is not held
        assert sorted(map(str, held.collect())) == sorted(map(str, other.drop("props").collect()))
