"""The paged source, runs, schemas and deep paths."""

import json
import random
import shutil

import pytest
from pyspark.sql import functions as F

from lodemark.operators import schemas as R
from lodemark.sources import io, paged


def put(path, number, items):
    (path / f"page={number}").mkdir(parents=True)
    (path / f"page={number}" / "part-0.txt").write_text(items if isinstance(items, str) else json.dumps({"page": number, "items": items}))


def test_pages_and_filters(spark, tmp_path):
    paged.register(spark)
    for n in range(40):
        put(tmp_path, n, [{"i": n * 10 + k} for k in range(n % 4)] if n < 30 else "not json at all")
    (tmp_path / "_SUCCESS").write_text("")
    read = lambda: spark.read.format("paged").option("path", str(tmp_path)).option("files", 3).load()
    got = read().where("page < 30 AND position >= 1").collect()  # pages from 30 on cannot be parsed: they are not opened
    assert sorted((r["page"], r["position"], json.loads(r["item"])["i"]) for r in got) == [(n, k, n * 10 + k) for n in range(30) for k in range(1, n % 4)]
    assert read().where("page IN (1, 2, 3) AND page <> 2").count() == 4
    assert read().where("page > 1000").count() == 0
    with pytest.raises(Exception, match="JSON|Expecting"):
        read().where("page >= 29").collect()
    assert spark.read.format("paged").option("path", f"{tmp_path}/none").load().count() == 0


def test_written_pages_come_back(spark, tmp_path):
    paged.register(spark)
    df = spark.range(95).selectExpr("id div 10 AS page", "id", "concat('é\"', id) AS t")
    paged.write_pages(df, f"{tmp_path}/p", "page", "id")
    got = spark.read.format("paged").option("path", f"{tmp_path}/p").load().selectExpr("page * 10 + position AS n", "get_json_object(item, '$.id') AS id", "get_json_object(item, '$.t') AS t").collect()
    assert sorted((r["n"], int(r["id"]), r["t"]) for r in got) == [(i, i, f'é"{i}') for i in range(95)]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Stopped between batches and started again: each page once; a page behind a gap waits."""
    paged.register(spark)
    src = tmp_path / "in"

    def run():
        stream = spark.readStream.format("paged").option("path", str(src)).load()
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return sorted(r["item"] for r in spark.read.schema(paged.SCHEMA).parquet(f"{tmp_path}/out").collect())

    for n in (0, 1, 3):
        put(src, n, [f"{n}a", f"{n}b"])
    assert run() == sorted(f'"{n}{x}"' for n in (0, 1) for x in "ab")
    assert run() == sorted(f'"{n}{x}"' for n in (0, 1) for x in "ab")
    put(src, 2, ["2a"])
    shutil.rmtree(src / "page=0")  # what is committed is not read again
    assert run() == sorted(['"0a"', '"0b"', '"1a"', '"1b"', '"2a"', '"3a"', '"3b"'])


def test_run_catalog(spark, tmp_path):
    path = f"{tmp_path}/runs"
    for k in range(5):
        io.write_run(spark.range(k + 1), path, f"r{k}")
    plans = spark.createDataFrame([("r4", "newest"), ("r9", "absent")], "run_id string, title string")
    got = io.run_catalog(spark, path, plans, newest=3).collect()
    assert [(r["run_id"], r["n_rows"], r["title"], r["place"]) for r in sorted(got, key=lambda r: r["place"])] == [("r4", 5, "newest", 1), ("r3", 4, None, 2), ("r2", 3, None, 3)]
    assert all(r["bytes"] > 0 and r["n_files"] >= 1 and r["modified"] for r in got)


def test_deep_paths(spark):
    def walk(v, path, depth):
        for _ in range(2):
            v = (v[0] if v else None) if isinstance(v, list) else v
        if isinstance(v, dict):
            for k, x in v.items() if depth < R.DEPTH else ():
                yield from walk(x, f"{path}.{k}", depth + 1)
        elif v is not None and not isinstance(v, list):
            yield path, str(v).lower() if isinstance(v, bool) else str(v)

    r = random.Random(8)

    def value(depth):
        kind = r.random()
        if depth and kind < 0.45:
            return {r.choice("abcde"): value(depth - 1) for _ in range(r.randint(0, 3))}
        if depth and kind < 0.7:
            return [value(depth - 1) for _ in range(r.randint(0, 2))]
        return r.choice([1, "x", None, True, "", 2.5])

    raws = [{"k": value(8)} for _ in range(150)]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(raws)] + [(900, "[1]"), (901, "{"), (902, None), (903, "{}")], "i int, raw string")
    got = sorted((r["i"], r["path"], r["value"]) for r in R.scalar_paths(df, "raw", carry=["i"]).collect())
    assert got == sorted((i, p, v) for i, x in enumerate(raws) for p, v in walk(x, "$", 0)) and max(p.count(".") for _, p, _ in got) == R.DEPTH


def test_schema_merges_in_any_order(spark):
    rows = ['{"a":1,"b":{"c":[{"d":"x"}]}}', '{"a":2.5e0}', '{"b":{"c":[]},"e":true}', '{"a":null,"f":1.25}', '{"b":{"c":[{"d":1,"g":{"h":2}}]}}']
    seen = set()
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        for parts in (1, 2, 5):
            seen.add(R.schema_of(spark.createDataFrame([(x,) for x in order], "raw string").repartition(parts), "raw").first()["schema"])
    (schema,) = seen
    got = {r["path"]: r["type"] for r in R.paths_of(spark.createDataFrame([(schema,)], "schema string")).collect()}
    assert got == {"$.a": "DOUBLE", "$.b.c.d": "VARIANT", "$.b.c.g.h": "BIGINT", "$.e": "BOOLEAN", "$.f": "DECIMAL(3,2)"}
    back = {r["field"]: (r["path"], r["status"]) for r in R.recover_mapping(R.paths_of(spark.createDataFrame([(schema,)], "schema string")), {"x": "$.e", "y": "$.h", "z": "$.nope"}).collect()}
    assert back == {"x": ("$.e", "kept"), "y": ("$.b.c.g.h", "recovered"), "z": (None, "missing")}
    assert R.schema_of(spark.createDataFrame([], "raw string"), "raw").select(F.col("schema")).count() == 1
