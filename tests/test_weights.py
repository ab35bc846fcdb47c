"""Weights of records against the SQL that says the same."""

import pytest
from pyspark.sql import functions as F

from lodemark.functions import scores


def test_weights_round_as_doubles_do_in_sql(spark):
    """Products that end in a five after the eighth place: their doubles lie on either side of it."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, 1.0 / (1 + i % 4), (100 - i % 31) / 100, 0.6 + (i % 40) / 100, round((i * 7919 % 1_000_000) / 1e6, 6)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "ord long, independent_voice_weight double, authenticity double, evidence_confidence double, impact_score double")
    df = df.select("*", F.lit("organic").alias("content_class"), F.lit("supportive").alias("target_stance"), F.lit(True).alias("opinion_eligible"))
    got = {r["ord"]: (r["attention_multiplier"], r["reputation_weight"]) for r in scores.with_weights(df).collect()}
    con = duckdb.connect()
    t = df.toPandas()  # noqa: F841  read by name
    want = con.execute("SELECT ord, round(0.4 + 0.6 * impact_score, 6), round(independent_voice_weight * authenticity * evidence_confidence * (0.4 + 0.6 * impact_score), 8) FROM t").fetchall()
    assert got == {o: (m, w) for o, m, w in want}
