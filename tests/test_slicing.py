"""Windows against plain recursion."""

import random
from datetime import date, timedelta

from lodemark.operators import slicing as SL

FIRST = date(2024, 1, 1)


def plain(days, limit, shortest):
    """[(start, end, n, full)] of sorted day numbers."""

    def cut(s, t):
        n = sum(s <= d <= t for d in days)
        if n >= limit and t - s + 1 >= 2 * shortest:
            m = s + (t - s + 1) // 2 - 1
            return cut(s, m) + cut(m + 1, t)
        return [(s, t, n, n >= limit)]

    return cut(min(days), max(days)) if days else []


def test_windows(spark):
    r = random.Random(9)
    keys = {"one": [5], "two": [3, 4] * 30, "gap": [0] * 9 + [400] * 3, "many": [int(r.gauss(100, 20)) for _ in range(900)], "flat": [r.randint(0, 64) for _ in range(300)]}
    rows = [(k, FIRST + timedelta(d)) for k, ds in keys.items() for d in ds] + [(None, FIRST), ("none", None)]
    df = spark.createDataFrame(rows, "k string, d date")
    for limit, shortest in ((10, 1), (40, 2), (1, 1), (10**6, 1)):
        got = {}
        for w in SL.split_windows(df, "k", "d", limit, shortest).collect():
            got.setdefault(w["k"], []).append(((w["start"] - FIRST).days, (w["end"] - FIRST).days, w["n"], w["full"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: plain(ds, limit, shortest) for k, ds in keys.items()}
    assert SL.split_windows(df.limit(0), "k", "d", 5).count() == 0


def test_ceilings(spark):
    calls = {"a": [9, 5, 0, 5, None, 5], "b": [5, 5, 4], "c": [2, 2], "d": [0, 0, 0, 0], "e": [1, 7, 7, 7]}
    df = spark.createDataFrame([(k, i, n) for k, ns in calls.items() for i, n in enumerate(ns)], "k string, o int, n int")
    assert {r["k"]: r["ceiling"] for r in SL.ceilings(df, "k", "o", "n").collect()} == {"a": 5, "b": None, "c": None, "d": None, "e": 7}
