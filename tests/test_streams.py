from pyspark.sql import functions as F

from lodemark.sources import io
from lodemark.streaming import evidence as S


def test_streams(spark, tmp_path):
    rows = [(i, f"a{i % 2}", "x", f"2024-01-0{1 + i // 6} 00:{i % 6:02d}:00") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, author string, platform string, t string").select("id", "author", "platform", F.to_timestamp("t").alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = S.windowed_counts(stream).writeStream.format("memory").queryName("w1").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r["records"] for r in spark.table("w1").collect()} == {6}
    assert S.bursts(df, least=3).count() == 4
    q = S.append_batches(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination(60)
    assert S.latest(spark.read.parquet(f"{tmp_path}/out")).count() == 12


def test_cached_annotations(spark):
    records = spark.createDataFrame([("k1", "good"), ("k2", "bad")], "fingerprint string, text string")
    cache = spark.createDataFrame([("k1", 1.0)], "fingerprint string, score double")
    schema = "fingerprint string, score double"

    def provider(batch):
        return batch.assign(score=-1.0)[["fingerprint", "score"]]

    got = {r["fingerprint"]: r["score"] for r in io.annotate_missing(records, cache, provider, schema).collect()}
    assert got == {"k1": 1.0, "k2": -1.0}


def test_near_in_time(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "k"), (2, "2024-01-01 05:59:00", "k"), (3, "2024-01-01 06:01:00", "k"), (4, "2024-01-01 01:00:00", "m"), (5, None, "k")]
    df = spark.createDataFrame(rows, "id int, ts string, k string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = S.near_in_time(read(), read(), "k").where("id_a < id_b").writeStream.format("memory").queryName("near_in_time").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["id_a"], r["id_b"]) for r in spark.table("near_in_time").collect()} == {(1, 2), (2, 3)}
