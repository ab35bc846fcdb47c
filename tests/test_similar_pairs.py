"""The similarity join against all pairs compared one by one."""

import random
from itertools import combinations

import pytest

from lodemark.operators import similarity
from lodemark.plans import registry, texts  # noqa: F401


def brute(sets, threshold):
    out = {}
    for (a, x), (b, y) in combinations(sorted(sets.items()), 2):
        if (x or y) and len(x & y) / len(x | y) >= threshold:
            out[a, b] = round(len(x & y) / len(x | y), 6)
    return out


def test_query_finds_partners_behind_any_number_of_rows_and_tokens(spark, tmp_path):
    """Partners more than 80 rows apart in each token's list, such as share none of their first 40 tokens, and such as have short tokens only."""
    docs = {0: "alpha beta gamma delta", 1: " ".join([f"aa{i:03d}" for i in range(42)] + [f"zz{i:03d}" for i in range(400)])}
    docs |= {2 + i: f"alpha beta gamma delta own{i} other{i} third{i}" for i in range(120)}
    docs |= {200: "alpha beta gamma delta more", 201: " ".join([f"bb{i:03d}" for i in range(42)] + [f"zz{i:03d}" for i in range(400)]), 202: "ab cd ef", 203: "ef cd ab ab", 204: "", 205: None, 206: "!!"}
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {(r["a"], r["b"]): r["similarity"] for r in registry.QUERIES["similarity_join"](spark, f"file://{tmp_path}").collect()}
    want = brute({i: set((t or "").replace("!", "").split()) for i, t in docs.items()}, 0.68)
    assert got == want and {(0, 200), (1, 201), (202, 203)} <= set(got)


@pytest.mark.parametrize(("threshold", "cell_rows", "small"), [(0.68, 1 << 20, False), (0.68, 40, True), (0.5, 15, True), (0.9, 200, True)])
def test_similar_pairs_are_all_pairs(spark, monkeypatch, threshold, cell_rows, small):
    """Sets of many sizes with near copies, copies and a crowd, whatever the number of parts and blocks."""
    if small:  # many blocks of sketches and of sets, tables that are not broadcast
        for name, value in (("CELL_BYTES", 2000), ("BLOCK_BYTES", 2000), ("SENT", 10), ("RANKED", 20), ("CELL_PAIRS", 50)):
            monkeypatch.setattr(similarity, name, value)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(600)]
    sets = {}
    for i in range(220):
        if i % 3 and sets:
            x = set(rnd.choice(list(sets.values())))
            for _ in range(rnd.randint(0, len(x) // 4 + 1)):
                x ^= {rnd.choice(words)}
        else:
            x = set(rnd.choices(words, [1 / (k + 1) for k in range(600)], k=rnd.choice([0, 1, 2, 4, 9, 30, 90, 250])))
        sets[i * 7] = x
    crowd = set(words[100:130])
    sets |= {5000 + i: crowd ^ {rnd.choice(words)} for i in range(40)} | {6000 + i: set(crowd) for i in range(12)}
    df = spark.createDataFrame([(o, rnd.sample(sorted(x) * 2, 2 * len(x))) for o, x in sets.items()], "ord long, toks array<string>").repartition(3)
    rows = similarity.similar_pairs(df, "ord", "toks", threshold, cell_rows).collect()
    got = {(r["a"], r["b"]): round(r["similarity"], 6) for r in rows}
    assert len(rows) == len(got) and got == brute(sets, threshold)


def test_rows_of_one_set_meet_over_blocks(spark):
    pairs = spark.createDataFrame([(1, 2, 0.75)], "u long, v long, similarity double")
    members = spark.createDataFrame([(1, i) for i in range(0, 50, 2)] + [(2, i) for i in range(1, 20, 2)] + [(3, 99)], "d long, o long")
    got = [tuple(r) for r in similarity._expanded(pairs, members, copies=4).collect()]
    one, two = range(0, 50, 2), range(1, 20, 2)
    want = [(a, b, 1.0) for x in (one, two) for a, b in combinations(x, 2)] + [(min(a, b), max(a, b), 0.75) for a in one for b in two]
    assert sorted(got) == sorted(want)


def test_near_copies_are_compared_in_one_block(spark):
    """Each set of a crowd travels once, and once for each part of a crowd beyond the bound, not once for each of many blocks."""
    crowd = [(u, v) for u, v in combinations(range(60), 2)] + [(u, v) for u, v in combinations(range(100, 103), 2)]
    pairs = spark.createDataFrame(crowd, "u long, v long")
    for bound, most in ((512, 1), (15, 4)):
        rows = similarity._neighbours_together(pairs, 1000, bound).collect()
        assert sorted((r["u"], r["v"]) for r in rows) == sorted(crowd)
        cells = {d: {(r["i"], r["j"]) for r in rows if d in (r["u"], r["v"])} for d in range(60)}
        assert max(map(len, cells.values())) <= most and (most == 1 or len(set().union(*cells.values())) > 1)
