"""Properties of the library's own operators on small data; sums against plain re-computation."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lodemark.functions import cleaning, scores, text
from lodemark.operators import aggregate, normalize, similarity
from lodemark.operators.components import connected_components
from lodemark.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def weighted(spark):
    df = fixtures.weighted(spark, SF).persist()
    yield df
    df.unpersist()


def index(df):
    return aggregate.reputation(df.withColumn("k", F.lit(1)), "k").first()


@pytest.mark.parametrize("score,expected", [(0.0, 50.0), (1.0, 100.0), (-1.0, 0.0)])
def test_index_of_uniform_sentiment(weighted, score, expected):
    assert index(weighted.withColumn("sentiment_score", F.lit(score)))["index"] == expected


def test_no_evidence_has_no_index(weighted):
    r = index(weighted.withColumn("eligible", F.lit(False)))
    assert r["index"] is None and r["interpretation"] == "insufficient_evidence" and r["eligible_records"] == 0


def test_contributions_add_up(weighted):
    total = aggregate.contributions(weighted, "narrative").agg(F.sum("points")).first()[0]
    mean = index(weighted)["weighted_sentiment"]
    assert abs(total - 50 * mean) < 1e-2


def test_row_order_does_not_matter(weighted):
    assert index(weighted.repartition(7, "author")) == index(weighted.coalesce(1))


def test_distribution_keeps_absent_labels(weighted):
    rows = aggregate.distribution(weighted, "sentiment_label", ("positive", "absent"), "reputation_weight").collect()
    assert {r["label"]: r["n"] > 0 for r in rows} == {"positive": True, "absent": False}


def test_unknown_metrics_are_not_zero(spark):
    rows = [("x", None, None, None, None, None), ("x", 100.0, 5.0, 1.0, 0.0, 10.0), ("x", 0.0, 0.0, 0.0, 0.0, 0.0), ("x", 1e100, 1e100, 1e100, 1e100, 1e100)]
    df = spark.createDataFrame(rows, "platform string, views double, likes double, comments double, shares double, followers double")
    got = scores.with_impact(df, scores.metric_reference(df)).orderBy(F.col("views").asc_nulls_first()).collect()
    assert (got[0]["impact_score"], got[0]["impact_confidence"]) == (0.5, 0.0)
    assert got[1]["impact_score"] == 0.0 and got[1]["impact_confidence"] == 1.0
    assert all(0 <= r["impact_score"] <= 1 for r in got)


def test_fold(spark):
    rows = [("Crème BRÛLÉE https://x.y/z!", "creme brulee"), ("ΣΑΣ Ελλάδα", "σασ ελλαδα"), ("Straße #Tag @me", "strasse #tag @me"), (None, ""), ("𝗘𝘂𝗿𝗼 jackpot", None)]
    got = spark.createDataFrame(rows, "t string, w string").select("t", "w", text.fold(F.col("t")).alias("n"), text.fold_exact(F.col("t")).alias("e")).collect()
    for r in got:
        if r["w"] is not None:
            assert r["n"] == r["e"] == r["w"]
    assert got[-1]["e"] == "euro jackpot"


def test_terms_and_handles(spark):
    df = spark.createDataFrame([("the αopap wins",), ("opap wins the",)], "t string")
    got = df.select(text.has_term(text.fold(F.col("t")), "opap").alias("x"), text.has_term(text.fold(F.col("t")), "wins the").alias("y")).collect()
    assert [tuple(r) for r in got] == [(False, False), (True, True)]
    names = [("in.gr", True), ("laertis1972", False), ("ert", True), ("ΤΟ ΒΗΜΑ", True), ("ta_nea", True), ("maria", False), ("", False), (None, False)]
    got = spark.createDataFrame(names, "a string, w boolean").select("w", text.looks_like_media(F.col("a")).alias("m")).collect()
    assert all(r["w"] == r["m"] for r in got)


def test_translit(spark):
    rows = [("den aksizoun ta lefta kai pali", True), ("kai the and for", False), ("καλημέρα kai den", False), ("den", False), (None, False)]
    got = spark.createDataFrame(rows, "t string, w boolean").select("w", text.translit_score(F.col("t")).alias("s")).collect()
    assert all((r["s"] > 0) == r["w"] for r in got)


def test_cleaning_gates(spark):
    plan = cleaning.Plan(client="acme", topic="acme", core_terms=("acme",), exclusions=("other acme",))
    rows = [("x", "u1", "Η acme στην Ελλάδα και για την Αθήνα"), ("x", "u2", "hello"), ("x", "u3", "other acme in greece"), ("news", "n", "acme greece και στην"), ("x", "acme official", "acme και στην ελλαδα"), ("x", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, platform string, author string, text string")
    got = {r["ord"]: r for r in cleaning.clean(df, plan).collect()}
    assert got[0]["decision"]["decision"] == "trusted" and got[0]["content_class"] == "organic"
    assert got[1]["decision"]["reasons"] == ["subject_not_mentioned"]
    assert got[2]["decision"]["reasons"] == ["explicit_exclusion_context"]
    assert (got[3]["account_type"], got[3]["content_class"], got[4]["content_class"]) == ("media", "news", "owned")
    assert got[5]["decision"]["decision"] == "excluded"


def test_cleaning_duplicates_and_authors(spark):
    plan = cleaning.Plan(client="acme", topic="acme widgets", core_terms=("acme",))
    long = "acme στην ελλαδα " + " ".join(f"word{i}" for i in range(20))
    rows = [("x", "u1", long), ("x", "u1", long.upper()), ("x", "u2", long + " " + long), ("x", "u3", None), ("x", "u4", "acme και στην ελλαδα ok yes"), ("x", "", long)]
    rows += [("x", "u5", f"acme στην ελλαδα alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mi ni xi {'z' * k}") for k in range(1, 7)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, platform string, author string, text string")
    got = {r["ord"]: r for r in cleaning.clean(df, plan).collect()}
    assert len(got) == len(rows)
    assert got[1]["flags"].count("exact_duplicate") == 1 and got[1]["duplicate_of"] == 0
    assert got[2]["flags"].count("syndicated_duplicate_content") == 1 and got[2]["duplicate_of"] == 0
    assert got[1]["decision"]["reasons"] == got[2]["decision"]["reasons"] == ["duplicate_not_independent_evidence"]
    assert got[4]["organic_eligible"] and got[4]["independent_voice_weight"] == 1.0
    assert {r["reason"] for r in got[6]["bot_reasons"]} == {"repeated_near_identical_author_content"}
    near = spark.createDataFrame([(7, 6), (1, 0)], "id long, leader long")
    got = {r["ord"]: r for r in cleaning.clean(df, plan, near=near).collect()}
    assert got[7]["flags"].count("near_duplicate_same_author") == 1 and got[1]["flags"].count("exact_duplicate") == 1


def test_cleaning_comments(spark):
    plan = cleaning.Plan(client="acme", topic="acme widgets", core_terms=("acme",))
    schema = "ord long, platform string, author string, text string, layer string, parent_text string, parent_tier string, parent_qualified boolean, parent_market double"
    rows = [
        (0, "x", "u1", "so good, thanks", "comment", "Η acme στην Ελλάδα", None, None, None),
        (1, "x", "u2", "so good, thanks", "primary", "Η acme στην Ελλάδα", None, None, None),
        (2, "x", "u3", "so good, thanks", "reply", "nothing here", "search", True, 0.5),
        (3, "x", "u4", "Wygralem 50 euro", "comment", "acme jest super", None, None, None),
        (4, "x", "u5", "so good, thanks", "comment", None, None, None, None),
    ]
    got = {r["ord"]: r for r in cleaning.clean(spark.createDataFrame(rows, schema), plan).collect()}
    assert "contextual_parent_match" in got[0]["flags"] and "parent_market_context" in got[0]["flags"]
    assert got[1]["decision"]["reasons"] == ["subject_not_mentioned"] == got[4]["decision"]["reasons"]
    assert "parent_subject_inherited_from_search_provenance" in got[2]["decision"]["reasons"]
    assert got[3]["decision"]["reasons"] == ["outside_target_market"]


def test_uniq(spark):
    df = spark.createDataFrame([(["+1", " 555-3824", "A", "b", "a ", "", "141.168.246.231", "B"],), ([],), (None,)], "x array<string>")
    got = [r["u"] for r in df.select(text.uniq(F.col("x")).alias("u")).collect()]
    assert got == [["+1", "555-3824", "A", "b", "141.168.246.231"], [], None]


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(5, x) for x in range(6, 90)]
    df = spark.createDataFrame([*chain, *star, (1, 2), (2, 1), (3, 3), (None, 4)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 90)}, 1: 1, 2: 1}
    assert connected_components(df.limit(0)).collect() == []


def test_near_copies(spark):
    import random

    rng = random.Random(2)
    rows = []
    for i in range(60):
        base = [f"w{k}" for k in range(20)] if i % 2 else [f"v{k}" for k in range(20)]
        words = [w if rng.random() > 0.04 else f"z{rng.randrange(9)}" for w in base]
        rows.append((i, f"a{i % 3}", words))
    df = spark.createDataFrame(rows, "ord long, author string, toks array<string>")
    kept, want = [], {}
    for i, a, t in rows:
        near = [j for j, b, u in kept if a == b and len(set(t) & set(u)) / len(set(t) | set(u)) >= 0.85]
        if near:
            want[i] = min(near)
        else:
            kept.append((i, a, t))
    got = {r["id"]: r["leader"] for r in similarity.near_copies(df, "ord", "toks", "author", 0.85).collect()}
    assert got == want and len(want) > 10


def test_long_chains_are_settled(spark):
    n = 450
    chain = [(i, i + 1) for i in range(n)]
    star = [(1000, 1000 + i) for i in range(1, 30)] + [(1000 + i, 1001 + i) for i in range(1, 29)]
    got = {r["id"]: r["leader"] for r in similarity.first_kept(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {i: i - 1 for i in range(1, n + 1, 2)} | {1000 + i: 1000 for i in range(1, 30)}


def test_coordination_edges(spark):
    copy = "one text that many authors share word for word"
    press = "an agency report that only newspapers have printed"
    near = [f"word{i:02d}" for i in range(20)]
    rows = [(1, "a", copy, False, 0), (2, "b", press, True, 0), (3, "c", press, True, 0), (4, "d", " ".join(near), False, 0), (5, "e", " ".join([*near, "more"]), False, 6 * 3600), (6, "f", " ".join([*near, "else"]), False, 13 * 3600)]
    rows += [(7, "m", " ".join([*near, "press"]), True, 3600), (8, "n", " ".join([*near, "paper"]), True, 3600), (9, "d", " ".join([*near, "again"]), False, 60), (10, "g", " ".join([*near, "none"]), False, None)]
    rows += [(100 + i, f"x{i}", " ".join([w, "filler"]), False, None) for i, w in enumerate(copy.split() * 90)]  # push the first copy out of each token's window
    rows += [(2000, "z", copy, False, 10**7), (2001, "a", copy, False, None)]
    df = spark.createDataFrame([(o, a, f, f.split(), m, t) for o, a, f, m, t in rows], "ord long, author string, folded string, toks array<string>, media boolean, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    got = {tuple(r) for r in similarity.coordination_edges(df, 0.82, 0.72, 6).collect()}
    assert got == {(1, 2000), (1, 2001), (4, 5), (4, 7), (4, 8), (5, 7), (5, 8), (5, 9), (7, 9), (8, 9)}


def test_recent_pairs(spark):
    rows = [(i, [f"tok{i % 3}", "common", f"own{i}"]) for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, toks array<string>")
    got = {tuple(r) for r in similarity.recent_pairs(df, "ord", "toks", window=4).collect()}
    want = {(a, b) for a, b in combinations(range(40), 2) if b - a <= 4 or (b - a) % 3 == 0 and (b - a) // 3 <= 4}
    assert got == want


def test_dates(spark):
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    rows = [("1704067200", "2024-01-01 00:00:00"), ("1704067200000", "2024-01-01 00:00:00"), ("2024-01-01T02:00:00+02:00", "2024-01-01 00:00:00"), ("01/02/2024", "2024-02-01 00:00:00"), ("3 days ago", "2024-03-07 12:00:00"), ("Mon, 01 Jan 2024 00:00:00 +0000", "2024-01-01 00:00:00"), ("rubbish", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, w string").select("w", F.date_format(normalize.parse_date(F.col("t"), now), "yyyy-MM-dd HH:mm:ss").alias("g")).collect()
    assert [r["g"] for r in got] == [r["w"] for r in got]
    assert spark.createDataFrame([("2026-08-15T23:30:00-05:00",)], "t string").select(normalize.local_day(F.col("t"))).first()[0] == "2026-08-15"


def test_upsert_and_counts(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {tuple(r) for r in normalize.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    rows = [("n/a", 0), ("-3", 0), ("12.9", 12), ("1e3", 1000), (None, 0), ("NaN", 0)]
    got = spark.createDataFrame(rows, "v string, w long").select("w", scores.safe_count(F.col("v")).alias("g")).collect()
    assert all(r["w"] == r["g"] for r in got)


def test_apportion_and_greedy(spark):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "k string, w int")
    assert {r["k"]: r["allocated"] for r in aggregate.apportion(df, "k", "w", 7).collect()} == {"a": 4, "b": 2, "c": 1}
    assert [r["allocated"] for r in aggregate.greedy(df, [F.col("k")], "w", 6).orderBy("k").collect()] == [5, 1, 0]


def test_robust_z(spark):
    series = spark.createDataFrame([(f"d{i}", float(v)) for i, v in enumerate([5, 5, 5, 5, 50])], "day string, v double")
    z = {r["day"]: r["v_z"] for r in aggregate.robust_scores(series, ["v"]).collect()}
    assert z["d0"] == 0 and z["d4"] == 10 * 45 / 5
    assert all(r["v_z"] == 0 for r in aggregate.robust_scores(series.limit(4), ["v"]).collect())


def test_near_copies_by_brute_force(spark):
    """The greedy rule over all pairs of an author, on the documents themselves."""
    from lodemark.plans.texts import corpus

    rows = corpus(spark, "/root/testdata/sf0.01").select("ord", "author", "toks")
    kept, want = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r["ord"]):
        x = frozenset(r["toks"])
        near = [o for o, y in kept.setdefault(r["author"], []) if x and 100 * len(x & y) >= 85 * len(x | y)]
        if near:
            want[r["ord"]] = near[0]
        else:
            kept[r["author"]].append((r["ord"], x))
    got = {r["id"]: r["leader"] for r in similarity.near_copies(rows, "ord", "toks", "author", 0.85).collect()}
    assert got == want and len(want) > 2


def test_long_sets_meet_by_sketches_that_fit_them(spark, monkeypatch):
    import random

    r = random.Random(8)
    sets = []
    for n in (3, 30, 60, 64, 70, 75, 80, 100, 300, 300, 900):
        base = [f"w{r.randint(0, 5000)}" for _ in range(n)]
        sets += [base, [x for x in base if r.random() < 0.93], base + [f"z{i}" for i in range(n // 8)], [f"w{r.randint(0, 5000)}" for _ in range(n)]]
    df = spark.createDataFrame([(i, "gh"[i % 3 == 2], x) for i, x in enumerate(sets)] + [(1000 + i, None, sets[-2]) for i in range(2)], "ord long, g string, toks array<string>")
    x = [(i, "gh"[i % 3 == 2], frozenset(s)) for i, s in enumerate(sets)]
    first = {}
    for i, g, s in x:
        first.setdefault((g, s), i)
    want = {(i, j) for (g, s), i in first.items() for (h, t), j in first.items() if g == h and i < j and 100 * len(s & t) >= 85 * len(s | t)}
    monkeypatch.setattr(similarity, "LONG", 64)
    pairs, _ = similarity.set_join(df, "ord", "toks", "g", 0.85)
    assert {(p["a"], p["b"]) for p in pairs.collect()} == want and any(len(sets[i]) > 200 for i, _ in want) and any(len(sets[i]) < 64 for i, _ in want)
    rows = df.where("g = 'g'").select("g", F.col("ord").alias("o"), similarity.hashed("toks").alias("x")).where(F.size("x") > 64)
    at_once = {(p["a"], p["b"]) for p in similarity.long_pairs(rows, 0.85).collect()}
    assert at_once == {(p["a"], p["b"]) for p in similarity.long_pairs(rows, 0.85, 100).collect()}  # in many blocks
    assert {p for p in want if sets[p[0]] and x[p[0]][1] == "g" and min(len(x[p[0]][2]), len(x[p[1]][2])) > 64} <= at_once
    unlike = spark.createDataFrame([(i, "g", [f"w{r.randint(0, 50_000)}" for _ in range(3000)]) for i in range(12)], "o long, g string, toks array<string>")
    assert similarity.long_pairs(unlike.select("g", "o", similarity.hashed("toks").alias("x")), 0.85).count() == 0  # 512 bits let all of them through


def test_sketches_lose_no_pair(spark):
    import random

    r = random.Random(6)
    sets = []
    for _ in range(60):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([3, 20, 150, 400]))]
        sets += [base, [x for x in base if r.random() < 0.9] + ["z"], base[: len(base) // 2]]
    df = spark.createDataFrame([(i, "g", x) for i, x in enumerate(sets)], "ord int, g string, toks array<string>")
    pairs, copies = similarity.set_join(df, "ord", "toks", "g", 0.7)
    first = {}
    for i, x in enumerate(sets):
        first.setdefault(frozenset(x), i)
    uniq = sorted((i, s) for s, i in first.items())
    want = {(i, j) for i, x in uniq for j, y in uniq if i < j and 10 * len(x & y) >= 7 * len(x | y)}
    assert {(p["a"], p["b"]) for p in pairs.collect()} == want and want
    assert {(c["rep"], c["id"]) for c in copies.collect()} == {(first[frozenset(x)], i) for i, x in enumerate(sets) if first[frozenset(x)] != i}


def test_numbered(spark):
    from lodemark.operators.ranks import numbered

    df = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('g', id % 5))) AS g", "(id * 7919) % 3001 AS o", "id AS rank_")
    got = numbered(df.repartition(7), ["g"], ["o"], written=True).collect()
    want = {}
    for g in {r["g"] for r in got}:
        for k, o in enumerate(sorted(r["o"] for r in got if r["g"] == g)):
            want[g, o] = k + 1
    assert len(got) == 3000 and all(want[r["g"], r["o"]] == r["rank"] for r in got)
    assert numbered(df.limit(0), [], ["o"]).count() == 0


def test_exact_quantile(spark):
    """Against numpy: a group with most rows, ties, values close together, negative and missing ones, empty groups."""
    import numpy as np

    from lodemark.functions.scores import metric_reference
    from lodemark.operators.ranks import exact_quantile

    rng = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        g = "hot" if i % 3 else ["a", "b", "few", None][i % 4] if i % 400 else "empty"
        rows.append((g, float(rng.integers(-3, 12)), float(1000 + rng.random() / 1e6) if i % 5 else None, None if g == "empty" else float(rng.lognormal(3, 4))))
    df = spark.createDataFrame(rows, "platform string, x double, y double, z double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {(r["platform"], r["all_"]): r for r in exact_quantile(df.repartition(5), "platform", ["x", "y", "z"], q).collect()}
        for (g, whole), r in got.items():
            for k, c in enumerate("xyz"):
                v = np.array([row[k + 1] for row in rows if (whole or row[0] == g) and row[k + 1] is not None and row[k + 1] > 0])
                assert r[f"{c}_n"] == len(v) and (np.isclose(r[f"{c}_p"], np.quantile(v, q), rtol=1e-12) if len(v) else r[f"{c}_p"] is None)
        assert sum(w for _, w in got) == 1
    metrics = ("x", "y", "z")
    exact, old = metric_reference(df, metrics), df.where("platform = 'hot'").selectExpr("percentile(if(z > 0, z, null), 0.95) AS p").first()["p"]
    refs = {r["platform"]: r for r in exact.collect()}
    assert refs["hot"]["z_r"] == pytest.approx(old, rel=1e-12) and set(refs) == {r[0] for r in rows} and refs["empty"]["z_r"] is not None
    assert "percentile" not in exact._jdf.queryExecution().optimizedPlan().toString()
    assert metric_reference(df.limit(0), metrics).count() == 0
    assert [r["x_r"] for r in metric_reference(df.select("platform", *[F.lit(None).cast("double").alias(m) for m in metrics]), metrics).collect()] == [None] * len(refs)


def test_recent_pairs_of_divided_lists(spark):
    """Lists that are divided among groups give the pairs of whole ones, copies and groups smaller than the window included."""
    import random

    rnd = random.Random(5)
    rows = [(i * 3, [w for w in ("aaaa", "bbbb", "cccc", "dddd") if rnd.random() < 0.6]) for i in range(300)]
    lists = {}
    for o, toks in rows:
        for t in toks:
            lists.setdefault(t, []).append(o)
    want = {(a, b) for x in lists.values() for k, b in enumerate(x) for a in x[max(0, k - 7) : k]}
    df = spark.createDataFrame(rows, "ord long, toks array<string>")
    for block_rows in (3, 20, 1000):
        assert {tuple(r) for r in similarity.recent_pairs(df, "ord", "toks", window=7, block_rows=block_rows).collect()} == want
    sets = dict(rows)
    near = {(a, b) for a, b in want if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.7}
    pairs = similarity.recent_pairs(df, "ord", "toks", window=7, threshold=0.7, block_rows=20)
    assert {(r["a"], r["b"]) for r in similarity.with_similarity(pairs, df, "ord", "toks").where("similarity >= 0.7").collect()} == near


def test_one_row_group_is_dealt_over_the_cores(spark, tmp_path):
    from lodemark.session import SPREAD_BYTES, spread

    path = f"file://{tmp_path}/t.parquet"
    spark.range(0, 1000, 1, 1).write.parquet(path)
    df = spark.read.parquet(path)
    assert df.rdd.getNumPartitions() == 1 and spread(df, 8 * SPREAD_BYTES).rdd.getNumPartitions() == 8
    assert spread(df, SPREAD_BYTES).rdd.getNumPartitions() == 1
    assert spread(df, 8 * SPREAD_BYTES).count() == 1000


def test_texts_without_times_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(similarity, "recent_pairs", lambda *a, **k: pytest.fail("compared"))
    df = spark.createDataFrame([(i, a, "the same words in all of these rows", ["same", "words"], False) for i, a in enumerate("aab")], "ord long, author string, folded string, toks array<string>, media boolean").selectExpr("*", "CAST(NULL AS TIMESTAMP) AS ts")
    assert sorted(tuple(r) for r in similarity.coordination_edges(df, 0.82, 0.72, 6).collect()) == [(0, 1), (0, 2)]


@pytest.mark.parametrize("text", ["a b", "see https://news.gr/x now", "greece.com athens", "#greece", "http:// www.x.gr/y", "x.infos", ".com"])
def test_prose_of_marked_and_plain_texts(spark, text):
    from lodemark.functions import cleaning, text as T

    df = cleaning.with_prose(cleaning.features(spark.createDataFrame([(text,)], "text string")))
    plain = F.regexp_replace(F.regexp_replace("text", r"https?://\S+|\bwww\.\S+|#[A-Za-z0-9_]+", " "), r"\b[\w-]+\.(?:com|net|org|gr|co|io|eu|za|info|de|it)(?:\.[a-z]{2})?(?:/\S*)?", " ")
    r = df.select("prose", "prose_words", T.fold(plain).alias("want"), T.words(T.fold(plain)).alias("words_")).first()
    assert r["prose"] == r["want"] and r["prose_words"] == r["words_"]
