"""The pipeline against its operators' plain versions, on a small table."""

from collections import Counter
from itertools import pairwise

import corpus_pipeline
from pyspark.sql import functions as F

from lodemark.llm import mixing, pii
from lodemark.session import cut
from tests.llm.conftest import SF, rows_of
from tests.llm.test_dedup import brute_near
from tests.llm.test_rows import figures


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_near_dedup", "pii", "mix_sources", "sentencepiece"]
    one = corpus_pipeline.quality_stage(spark, docs, SF).persist()
    assert one.columns == docs.columns
    kept = {r["doc_id"] for r in one.collect()}
    assert kept <= {i for i, t, _ in rows_of(docs) if not figures(t)[5]} and len(kept) > 100
    two = corpus_pipeline.near_dedup_stage(spark, one, SF).persist()
    _, comp = brute_near(rows_of(one))
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == set(comp.values())
    three = corpus_pipeline.pii_stage(spark, two, SF).persist()
    assert three.columns == docs.columns and three.count() == two.count()
    assert three.where("n_chars <> length(text)").count() == 0
    assert three.where(f"text RLIKE {pii._lit(pii.PATTERNS['email'])}").count() == two.where(f"text RLIKE {pii._lit(pii.PATTERNS['email'])}").count()
    four = corpus_pipeline.mixing_stage(spark, three, SF)
    assert four.columns == docs.columns and sorted(map(str, four.collect())) == sorted(map(str, three.collect()))
    five = corpus_pipeline.encoding_stage(spark, four, SF)
    assert five.select("doc_id").distinct().count() == three.count() and five.where("NOT decoded").count() == 0


def test_result_is_in_the_order_of_the_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    source = {i: s for i, _, s in rows_of(docs)}
    four = cut(cut(corpus_pipeline.mixing_stage(spark, docs, SF)).repartition(5))  # as if read in another order
    out = corpus_pipeline.encoding_stage(spark, four, SF).collect()
    assert all(a["position"] <= b["position"] for a, b in pairwise(out))
    at = {r["position"]: r["doc_id"] for r in out}
    assert sorted(at) == list(range(len(source))) and len({(r["doc_id"], r["position"]) for r in out}) == len(source)
    counts = Counter(source.values())
    names, weights = sorted(counts), mixing.target_weights(counts)
    plan = mixing.pfair([counts[s] for s in names], [weights[s] for s in names])  # blocks of one row
    assert [source[at[p]] for p in sorted(at)] == [names[i] for i, *_ in plan]


def test_encoding_takes_the_positions_of_the_mix(spark, odd_docs, monkeypatch):
    docs = odd_docs.where("doc_id IS NULL OR doc_id NOT IN (10, 11)")
    n = docs.count()
    assert {r["position"] for r in corpus_pipeline.encoding_stage(spark, docs, SF).collect()} == {None}  # never mixed
    plain = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda d: plain(d).withColumn("position", F.lit(10 * n) - 10 * F.col("position")))
    four = cut(cut(corpus_pipeline.mixing_stage(spark, docs, SF)).repartition(3))
    monkeypatch.setattr(mixing, "mix", None)  # the mix is not drawn up again
    out = corpus_pipeline.encoding_stage(spark, four, SF).where("sample = 0").collect()
    assert [r["position"] for r in out] == [10 * i for i in range(1, n + 1)]
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())


def test_odd_rows(spark, odd_docs):
    docs = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd_docs.columns
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() > 0
    empty = odd_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
        if "text" not in empty.columns:
            break


def test_clashing_columns_keep_their_values(spark, odd_docs):
    names = ["w_", "g_", "text_", "n_lines", "n_words", "kept", "_m", "_e", "_row", "row", "tweak", "_s", "block", "position", "n_entities", "kinds", "kept_id", "_id"]
    plain = odd_docs.select("doc_id", "text", "source").where("doc_id < 20")
    docs = plain.select("*", *[F.concat(F.lit(f"{n}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF))
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}/{r['doc_id']}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
