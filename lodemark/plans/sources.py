"""Queries over sources that Spark writes from the given tables: paged datasets, snapshots of runs, raw schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.operators import schemas as R
from lodemark.operators import slicing as SL
from lodemark.plans.registry import query
from lodemark.session import table, work_dir
from lodemark.sources import io, paged


@query("""SELECT event_id // 500 AS page, event_id % 500 AS position, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id // 500 BETWEEN 3 AND 11""")
def paged_source(spark, sf):
    """Events written as pages of 500 and read through the data source; the range of pages reaches the files."""
    events = table(spark, sf, "events").select((F.floor(F.col("event_id") / 500)).alias("page"), "event_id", "event_type", "props")
    path = work_dir(spark, "pages")
    paged.write_pages(events, path, "page", "event_id")
    paged.register(spark)
    item = lambda p, t: F.get_json_object("item", p).cast(t)
    rows = spark.read.format("paged").option("path", path).load().where("page BETWEEN 3 AND 11")
    return rows.select("page", "position", item("$.event_id", "long").alias("event_id"), item("$.event_type", "string").alias("event_type"), F.get_json_object(item("$.props", "string"), "$.k").cast("long").alias("k"))


@query("""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, count(*) AS n_rows, count(DISTINCT o_custkey) AS planned FROM orders GROUP BY 1)
SELECT run_id, n_rows, true AS has_bytes, 'run ' || run_id AS title, planned, CAST(row_number() OVER (ORDER BY run_id DESC) AS BIGINT) AS place FROM r QUALIFY place <= 100""")
def run_catalog(spark, sf):
    """The newest hundred runs: snapshots by month of order, listed from names, sizes and footers, with their plans."""
    orders = table(spark, sf, "orders").withColumn("run_id", F.date_format("o_orderdate", "yyyy-MM"))
    path = work_dir(spark, "runs")
    orders.repartition("run_id").write.partitionBy("run_id").parquet(path)
    plans = orders.groupBy("run_id").agg(F.count_distinct("o_custkey").alias("planned")).withColumn("title", F.concat(F.lit("run "), "run_id"))
    return io.run_catalog(spark, path, plans, 100).select("run_id", "n_rows", (F.col("bytes") > 0).alias("has_bytes"), "title", "planned", "place")


_NESTED = """to_json(named_struct('id', event_id, 'kind', event_type, 'user', named_struct('id', user_id, 'tags', array(event_type, 'x'), 'home', named_struct('at', array(named_struct('lat', value, 'deep', named_struct('er', named_struct('most', 1)))))),
 'none', array(), 'props', array(named_struct('k', cast(get_json_object(props, '$.k') as int)), named_struct('k', -1))))"""


@query("""WITH v AS (SELECT event_id, event_type, user_id, value, json_extract_string(props, '$.k') AS k FROM events),
p AS (SELECT event_id, unnest([{'path': '$.id', 'value': CAST(event_id AS VARCHAR)}, {'path': '$.kind', 'value': event_type}, {'path': '$.user.id', 'value': CAST(user_id AS VARCHAR)}, {'path': '$.user.tags', 'value': event_type},
 {'path': '$.user.home.at.lat', 'value': CAST(value AS VARCHAR)}, {'path': '$.props.k', 'value': k}]) AS x FROM v)
SELECT x.path AS path, count(*) AS n, count(DISTINCT x.value) AS n_values FROM p GROUP BY 1""")
def flatten_deep(spark, sf):
    """Scalars of raw rows with objects in lists in objects, down to five levels; of a list its first element."""
    raw = table(spark, sf, "events").select("event_id", F.expr(_NESTED).alias("raw"))
    return R.scalar_paths(raw, "raw", carry=["event_id"]).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))


@query("""WITH e AS (SELECT event_id % 4 AS g, CASE event_id % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'STRING' WHEN 2 THEN 'DOUBLE' ELSE 'BOOLEAN' END AS t FROM events)
SELECT * FROM (SELECT 'title' AS field, '$.name' AS path, 'STRING' AS type, 'kept' AS status UNION ALL SELECT 'score', '$.inner.score', CASE WHEN count(DISTINCT t) > 1 THEN 'VARIANT' ELSE min(t) END, 'recovered' FROM e
UNION ALL SELECT 'amount', '$.amount', CASE WHEN bool_or(g = 2) THEN 'DOUBLE' ELSE 'BIGINT' END, 'kept' FROM e WHERE g IN (0, 2) UNION ALL SELECT 'gone', NULL, NULL, 'missing') WHERE (SELECT count(*) FROM events) > 0""")
def mapping_recovery(spark, sf):
    """A mapping held against the schema of all raw rows: fields that are still there, moved, or gone."""
    raw = table(spark, sf, "events").select(F.expr("""to_json(named_struct('name', event_type, 'amount', IF(event_id % 4 = 0, cast(cast(value as bigint) as string), IF(event_id % 4 = 2, concat(cast(value + 0.001 as string), 'e0'), null)),
      'inner', concat('#', CASE event_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '"a"' WHEN 2 THEN '1.5e0' ELSE 'true' END, '#')))""").alias("raw"))
    text = F.regexp_replace(F.regexp_replace(F.replace(F.col("raw"), F.lit('\\"'), F.lit('"')), '"#([^#]*)#"', '{"score":$1}'), '"amount":"([^"]*)"', '"amount":$1')
    schema = R.schema_of(raw.select(text.alias("raw")), "raw")
    mapping = {"title": "$.name", "score": "$.score", "amount": "$.amount", "gone": "$.nothing"}
    return R.recover_mapping(R.paths_of(schema), mapping)


@query("""WITH RECURSIVE e AS (SELECT event_type AS k, CAST(ts AS DATE) AS d FROM events WHERE ts IS NOT NULL),
w AS (SELECT k, min(d) AS s, max(d) AS t, count(*) AS n FROM e GROUP BY 1
 UNION ALL SELECT h.k, h.s, h.t, (SELECT count(*) FROM e WHERE e.k = h.k AND e.d BETWEEN h.s AND h.t) FROM (SELECT w.k, CASE WHEN i = 0 THEN w.s ELSE w.s + CAST((w.t - w.s + 1) // 2 AS INTEGER) END AS s, CASE WHEN i = 0 THEN w.s + CAST((w.t - w.s + 1) // 2 - 1 AS INTEGER) ELSE w.t END AS t
 FROM w, (SELECT unnest([0, 1]) AS i) WHERE w.n >= 150 AND w.t - w.s + 1 >= 2) h)
SELECT k AS event_type, strftime(s, '%Y-%m-%d') AS first_day, strftime(t, '%Y-%m-%d') AS last_day, n, n >= 150 AS is_full FROM w WHERE n < 150 OR t - s + 1 < 2""")
def window_halving(spark, sf):
    """The span of each type of event in windows of fewer than 150 events, or as short as they get."""
    w = SL.split_windows(table(spark, sf, "events").select("event_type", F.col("ts").cast("date").alias("d")), "event_type", "d", 150)
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return w.select("event_type", day("start").alias("first_day"), day("end").alias("last_day"), "n", F.col("full").alias("is_full"))


@query("""WITH c AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN 5 ELSE event_id % 4 END AS n FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM c WHERE n > 0),
s AS (SELECT user_id, CASE WHEN count(*) = 3 AND min(n) = max(n) THEN max(n) END AS ceiling FROM r WHERE r <= 3 GROUP BY 1)
SELECT DISTINCT c.user_id, CAST(s.ceiling AS BIGINT) AS ceiling FROM c LEFT JOIN s USING (user_id)""")
def call_ceilings(spark, sf):
    """Users whose last three counts agree."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.when(F.col("user_id") % 3 == 0, 5).otherwise(F.col("event_id") % 4).alias("n"))
    return SL.ceilings(e, "user_id", "event_id", "n")
