"""Bursts of a stream in any order equal those of the batch rule; a stopped stream goes on without loss or repeats."""

import random

import pytest
from pyspark.sql import functions as F

from lodemark.streaming import gaps

START = 1_704_067_200  # 2024-01-01


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_batch_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = []
    for a in range(8):
        t = START
        for _ in range(r.randint(1, 40)):
            t += r.choice([0, 1, 60, 180, 181, 400, 900])
            rows.append((f"a{a}", t))
    rows.sort(key=lambda x: x[1] + r.randint(0, 1500))  # out of order by at most 25 minutes
    schema = "author string, s long"
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:

        def feed(part, rows):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{part:02d}")

        def run():
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").select("author", F.timestamp_seconds("s").alias("ts"))

            def keep(batch, number):
                batch.withColumn("b", F.lit(number)).write.mode("overwrite").parquet(f"{tmp_path}/out/b={number}")

            q = gaps.stream_bursts(stream, "30 minutes").writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").start()
            try:
                q.processAllAvailable()
            finally:
                q.stop()

        size = len(rows) // 4 + 1
        for k in range(2):
            feed(k, rows[k * size : (k + 1) * size])
        run()
        for k in range(2, 4):  # stopped, and started again with more
            feed(k, rows[k * size : (k + 1) * size])
        run()
        feed(8, [("late comer", START + 10**7)])  # the watermark passes everything
        run()
        feed(9, [("late comer", START + 10**7 + 1)])
        run()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    out = spark.read.parquet(*[str(p) for p in sorted((tmp_path / "out").iterdir())])
    last = out.groupBy("author").agg(F.max_by(F.struct("posts", "rapid", "burst"), "b").alias("x")).where("author <> 'late comer'").select("author", "x.*")
    want = gaps.batch_bursts(spark.createDataFrame(rows, schema).select("author", F.timestamp_seconds("s").alias("ts")))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))
    assert out.groupBy("author", "posts").count().where("count > 1").count() == 0
    assert {r["burst"] for r in want.collect()} == {True, False}


def test_batch_rule(spark):
    rows = [("a", START + 100 * i) for i in range(5)] + [("b", START + 181 * i) for i in range(9)] + [("c", START)] * 4 + [(None, START), ("d", None)]
    df = spark.createDataFrame(rows, "author string, s long").select("author", F.timestamp_seconds("s").alias("ts"))
    assert {r["author"]: (r["posts"], r["rapid"], r["burst"]) for r in gaps.batch_bursts(df).collect()} == {"a": (5, 4, True), "b": (9, 0, False), "c": (4, 3, False)}
