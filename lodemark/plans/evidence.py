"""Queries over weighted evidence: aggregates, series, rankings, investigations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodemark.functions import scores
from lodemark.operators import aggregate as A
from lodemark.operators import inventory as I  # noqa: E741
from lodemark.plans.registry import query
from lodemark.sources import fixtures as X
from lodemark.sources.fixtures import EMOTIONS

EV, EW, RUNS = X.SQL["evidence"], X.SQL["weighted"], X.SQL["runs"]
SENTIMENTS, STANCES = ("positive", "neutral", "negative"), ("supportive", "neutral", "critical", "not_applicable")
GROUPS = ("person", "media", "brand_owned", "organization", "unknown")
_W = "CASE WHEN eligible THEN reputation_weight ELSE 0 END"
_MEAN = "sum(reputation_weight * sentiment_score) FILTER (WHERE eligible) / nullif(sum(reputation_weight) FILTER (WHERE eligible), 0)"
_IDX = f"(CASE WHEN ({_MEAN}) IS NOT NULL THEN least(greatest((({_MEAN}) + 1) / 2, 0), 1) * 100 END)"
_ESS = "coalesce(pow(sum(reputation_weight) FILTER (WHERE eligible), 2) / nullif(sum(reputation_weight * reputation_weight) FILTER (WHERE eligible), 0), 0)"
_NEG = "sum(CASE WHEN sentiment_label = 'negative' THEN reputation_weight ELSE 0 END) FILTER (WHERE eligible) / nullif(sum(reputation_weight) FILTER (WHERE eligible), 0)"


def _emo(e: str) -> str:
    return f"sum(CASE WHEN primary_emotion = '{e}' THEN opinion_weight ELSE 0 END) / nullif(sum(opinion_weight), 0)"


def _reputation_sql(key: str) -> str:
    return f"""{EW} SELECT {key}, round({_IDX}, 2) AS "index", round({_MEAN}, 6) AS weighted_sentiment,
  CASE WHEN ({_MEAN}) IS NULL THEN 0 ELSE count(*) FILTER (WHERE eligible) END AS eligible_records,
  round(coalesce(sum(reputation_weight) FILTER (WHERE eligible), 0), 6) AS effective_weight, round({_ESS}, 2) AS effective_sample_size,
  CASE WHEN ({_MEAN}) IS NULL THEN 'insufficient_evidence' WHEN {_IDX} < 45 THEN 'negative' WHEN {_IDX} > 55 THEN 'positive' ELSE 'neutral_band' END AS interpretation
FROM weighted GROUP BY {key}"""


@query(_reputation_sql("platform"))
def reputation_index(spark: SparkSession, sf: str) -> DataFrame:
    return A.reputation(X.weighted(spark, sf), "platform")


@query(f"{EW} SELECT narrative, round(sum(CASE WHEN reputation_weight > 0 THEN reputation_weight * sentiment_score END) / nullif(sum(CASE WHEN reputation_weight > 0 THEN reputation_weight END), 0), 6) AS mean FROM weighted GROUP BY 1")
def weighted_mean(spark, sf):
    return X.weighted(spark, sf).groupBy("narrative").agg(A.r(A.weighted_mean(A.S, A.W), 6).alias("mean"))


@query(f"{EW} SELECT platform, round({_ESS}, 3) AS ess FROM weighted GROUP BY 1")
def effective_sample_size(spark, sf):
    return X.weighted(spark, sf).groupBy("platform").agg(A.r(A.effective_sample_size(A.rep_weight()), 3).alias("ess"))


@query(f"""{EW}, a AS (SELECT {_ESS} AS ess, coalesce(avg(evidence_confidence) FILTER (WHERE eligible), 0) AS ev, count(*) FILTER (WHERE eligible) AS n FROM weighted)
SELECT round(CASE WHEN n = 0 THEN 0 ELSE 100 * (0.35 * least(1, sqrt(ess / 100)) + 0.30 * 0.8 + 0.20 * 1.0 + 0.15 * ev) END + 1e-9, 2) AS score,
 CASE WHEN 100 * (0.35 * least(1, sqrt(ess / 100)) + 0.30 * 0.8 + 0.20 * 1.0 + 0.15 * ev) >= 75 THEN 'high' WHEN 100 * (0.35 * least(1, sqrt(ess / 100)) + 0.30 * 0.8 + 0.20 * 1.0 + 0.15 * ev) >= 50 THEN 'medium' ELSE 'low' END AS label,
 round(ess, 2) AS effective_sample_size, round(ev, 4) AS average_evidence_confidence FROM a""")
def confidence_report(spark, sf, quality: float = 0.8, coverage: float = 1.0):
    a = X.weighted(spark, sf).agg(A.effective_sample_size(A.rep_weight()).alias("ess"), F.coalesce(F.avg(F.when(A.ELIGIBLE, F.col("evidence_confidence"))), F.lit(0.0)).alias("ev"), F.count_if(A.ELIGIBLE).alias("n"))
    score = 100 * (0.35 * F.least(F.lit(1.0), F.sqrt(F.col("ess") / 100)) + 0.30 * quality + 0.20 * coverage + 0.15 * F.col("ev"))
    score = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(score)
    return a.select(A.r(score + 1e-9, 2).alias("score"), F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low").alias("label"), A.r(F.col("ess"), 2).alias("effective_sample_size"), A.r(F.col("ev")).alias("average_evidence_confidence"))


def _dist_sql(field: str, labels: tuple[str, ...], weight: str, only: str) -> str:
    vals = ", ".join(f"('{x}')" for x in labels)
    return f"""{EW}, l AS (SELECT * FROM (VALUES {vals}) t(label)),
g AS (SELECT {field} AS label, count(*) AS n, sum({weight}) AS w FROM weighted WHERE {only} AND {field} IN ({", ".join(f"'{x}'" for x in labels)}) GROUP BY 1)
SELECT label, coalesce(n, 0) AS n, round(coalesce(100.0 * n / nullif(sum(n) OVER (), 0), 0), 2) AS percent, round(coalesce(100.0 * w / nullif(sum(w) OVER (), 0), 0), 2) AS weighted_percent FROM l LEFT JOIN g USING (label)"""


@query(_dist_sql("sentiment_label", SENTIMENTS, "reputation_weight", "eligible"))
def sentiment_distribution(spark, sf):
    return A.distribution(X.weighted(spark, sf), "sentiment_label", SENTIMENTS, "reputation_weight", A.ELIGIBLE)


@query(_dist_sql("primary_emotion", (*EMOTIONS, "none"), "opinion_weight", "opinion_eligible"))
def emotion_distribution(spark, sf):
    return A.distribution(X.weighted(spark, sf), "primary_emotion", (*EMOTIONS, "none"), "opinion_weight", F.col("opinion_eligible"))


@query(_dist_sql("target_stance", STANCES, "independent_voice_weight", "true"))
def stance_distribution(spark, sf):
    return A.distribution(X.weighted(spark, sf), "target_stance", STANCES, "independent_voice_weight")


_DRIVERS = """{ew}, g AS (SELECT {key} AS name, count(*) AS n, sum(reputation_weight) AS w, sum(reputation_weight * sentiment_score) AS ws, avg(impact_score) AS impact FROM weighted WHERE eligible GROUP BY 1),
d AS (SELECT name, n AS mention_count, round(w, 4) AS effective_weight, round(ws / w, 4) AS average_sentiment, round(50 * ws / sum(w) OVER (), 4) AS points, round(impact, 4) AS average_impact FROM g)"""


@query(_DRIVERS.format(ew=EW, key="narrative") + " SELECT * FROM d")
def driver_contributions(spark, sf):
    return A.contributions(X.weighted(spark, sf), "narrative")


@query(
    _DRIVERS.format(ew=EW, key="narrative || '/' || topic")
    + """, t AS (SELECT * FROM d ORDER BY abs(points) DESC, effective_weight DESC, name LIMIT 40),
 p AS (SELECT *, 'positive' AS side, row_number() OVER (ORDER BY points DESC, name) AS k FROM t WHERE points > 0),
 n AS (SELECT *, 'negative' AS side, row_number() OVER (ORDER BY points, name) AS k FROM t WHERE points < 0)
 SELECT side, k AS rank, name, points FROM (SELECT * FROM p UNION ALL SELECT * FROM n) WHERE k <= 7"""
)
def driver_rows(spark, sf):
    """Cut to the 40 largest first, then split by sign: the order of cuts matters."""
    w = X.weighted(spark, sf).withColumn("driver", F.concat_ws("/", "narrative", "topic"))
    top = A.contributions(w, "driver", 40).where("points <> 0").withColumn("side", F.when(F.col("points") > 0, "positive").otherwise("negative"))
    return A.top_by(top, ["side"], [F.abs("points").desc(), F.col("name")], 7).select("side", "rank", "name", "points")


@query(f"""{EW} SELECT platform, count(*) AS records, count(*) FILTER (WHERE eligible) AS reputation_eligible, round({_IDX}, 2) AS "index", round(avg(impact_score), 4) AS average_impact,
 count(*) FILTER (WHERE opinion_eligible) AS organic_opinion_records FROM weighted GROUP BY 1""")
def source_breakdown(spark, sf):
    g = X.weighted(spark, sf).groupBy("platform").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(A.ELIGIBLE).alias("reputation_eligible"), A.r(A.index_of(A.weighted_mean(A.S, A.rep_weight())), 2).alias("index"), A.r(F.avg("impact_score")).alias("average_impact"), F.count_if("opinion_eligible").alias("organic_opinion_records")
    )
    return g


@query(f"""{EW}, l AS (SELECT * FROM (VALUES {", ".join(f"('{x}')" for x in GROUPS)}) t(origin_group)),
g AS (SELECT origin_group, count(*) AS n, sum(impact_score) AS a, round({_IDX}, 2) AS idx FROM weighted GROUP BY 1)
SELECT origin_group, coalesce(n, 0) AS records, round(coalesce(100.0 * n / sum(n) OVER (), 0), 2) AS record_share, round(coalesce(100.0 * a / sum(a) OVER (), 0), 2) AS attention_share, idx AS "index" FROM l LEFT JOIN g USING (origin_group)""")
def origin_breakdown(spark, sf):
    g = X.weighted(spark, sf).groupBy("origin_group").agg(F.count(F.lit(1)).alias("n"), F.sum("impact_score").alias("a"), A.r(A.index_of(A.weighted_mean(A.S, A.rep_weight())), 2).alias("index"))
    full = spark.range(1).select(F.explode(F.array(*map(F.lit, GROUPS))).alias("origin_group")).join(F.broadcast(g), "origin_group", "left")
    every = Window.partitionBy()  # five labels
    pct = lambda c: A.r(F.coalesce(100 * F.col(c) / F.sum(c).over(every), F.lit(0.0)), 2)
    return full.select("origin_group", F.coalesce("n", F.lit(0)).cast("long").alias("records"), pct("n").alias("record_share"), pct("a").alias("attention_share"), "index")


@query(f"""{EW}, g AS (SELECT origin_group, author, count(*) AS records, round(sum(impact_score), 6) AS attention, round(sum(reputation_weight * sentiment_score) / nullif(sum(reputation_weight), 0), 4) AS weighted_sentiment FROM weighted GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY origin_group ORDER BY attention DESC, records DESC, author) AS rank FROM g) SELECT * FROM k WHERE rank <= 10""")
def author_ranking(spark, sf):
    g = X.weighted(spark, sf).groupBy("origin_group", "author").agg(F.count(F.lit(1)).alias("records"), A.r(F.sum("impact_score"), 6).alias("attention"), A.r(A.weighted_mean(A.S, A.W)).alias("weighted_sentiment"))
    return A.top_by(g, ["origin_group"], [F.col("attention").desc(), F.col("records").desc(), F.col("author")], 10)


_DAILY = f"""{EW}, s AS (SELECT day, count(*) AS records, sum(independent_voice_weight) AS voices, {_ESS} AS ess, count(DISTINCT platform) AS source_count, {_IDX} AS idx,
 {_NEG} AS negative_share, sum(impact_score) AS attention, {", ".join(f"{_emo(e)} AS {e}_share" for e in EMOTIONS)} FROM weighted GROUP BY day)"""


@query(f"""{_DAILY}, c AS (SELECT *, 0.72 * least(1, ess / 20) + 0.28 * least(1, source_count / 3.0) AS conf FROM s)
SELECT day, records, round(voices, 4) AS effective_voices, round(ess, 4) AS effective_sample_size, source_count, round(conf, 4) AS daily_confidence,
 CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.45 THEN 'medium' ELSE 'low' END AS confidence_label, round(idx, 2) AS "index", round(negative_share, 6) AS negative_share, round(attention, 4) AS attention_score_sum,
 {", ".join(f"round({e}_share, 6) AS {e}_share" for e in EMOTIONS)} FROM c""")
def daily_series(spark, sf):
    s = A.daily_series(X.weighted(spark, sf), EMOTIONS)
    return s.withColumns({c: A.r(F.col(c), 6) for c in ["negative_share", *[f"{e}_share" for e in EMOTIONS]]})


_P95 = " UNION ALL ".join(f"SELECT p.platform, '{m}' AS metric, CASE WHEN p.{m}_n < 5 THEN g.{m}_p ELSE p.{m}_p END AS p95 FROM p_ p CROSS JOIN g_ g" for m in X.METRICS)


@query(f"{EW} {_P95}")
def p95_reference(spark, sf):
    refs = scores.metric_reference(X.evidence(spark, sf))
    return A.unpivot(refs, ["platform"], [f"{m}_r" for m in X.METRICS], "metric", "p95").withColumn("metric", F.regexp_replace("metric", "_r$", ""))


_Z = """{ev}, d AS (SELECT platform, day, count(*) AS records FROM evidence GROUP BY 1, 2),
m AS (SELECT platform, count(*) AS k, median(CAST(records AS DOUBLE)) AS med FROM d GROUP BY 1), a AS (SELECT platform, median(abs(CAST(records AS DOUBLE) - med)) AS mad FROM d JOIN m USING (platform) GROUP BY 1),
z AS (SELECT platform, day, records, CASE WHEN k < 5 THEN 0 WHEN mad <= 1e-12 THEN 10 * (records - med) / greatest(1, abs(med)) ELSE CAST(0.6745 AS DOUBLE) * (records - med) / mad END AS records_z FROM d JOIN m USING (platform) JOIN a USING (platform))"""


@query(_Z.format(ev=EV) + " SELECT platform, day, records, round(records_z + 1e-9, 3) AS records_z FROM z")
def robust_z(spark, sf):
    d = X.evidence(spark, sf).groupBy("platform", "day").agg(F.count(F.lit(1)).alias("records"))
    return A.robust_scores(d, ["records"], ["platform"]).withColumn("records_z", A.r(F.col("records_z") + 1e-9, 3))


def _zsql(c: str) -> str:
    return f"(SELECT median(coalesce({c}, 0)) FROM s)"


_ZCOLS = ["records", "negative_share", *[f"{e}_share" for e in EMOTIONS]]
_MED = ", ".join(f"median(CAST(coalesce({c}, 0) AS DOUBLE)) AS m_{c}" for c in _ZCOLS)
_MAD = ", ".join(f"median(abs(coalesce({c}, 0) - m_{c})) AS d_{c}" for c in _ZCOLS)
_ZED = ", ".join(f"CASE WHEN k < 5 THEN 0 WHEN d_{c} <= 1e-12 THEN 10 * (coalesce({c}, 0) - m_{c}) / greatest(1, abs(m_{c})) ELSE CAST(0.6745 AS DOUBLE) * (coalesce({c}, 0) - m_{c}) / d_{c} END AS {c}_z" for c in _ZCOLS)
_FLAG = "list_filter([CASE WHEN records_z >= 3.5 THEN 'volume_spike' END, CASE WHEN negative_share_z >= 3.5 AND negative_share >= 0.35 THEN 'negative_share_spike' END, " + ", ".join(f"CASE WHEN {e}_share_z >= 3.5 AND {e}_share >= {0.25 if e == 'anger' else 0.2} THEN '{e}_share_spike' END" for e in EMOTIONS) + "], lambda x: x IS NOT NULL)"


@query(f"""{_DAILY}, md AS (SELECT count(*) AS k, {_MED} FROM s), ad AS (SELECT {_MAD} FROM s CROSS JOIN md), z AS (SELECT s.*, {_ZED} FROM s CROSS JOIN md CROSS JOIN ad)
SELECT day, array_to_string({_FLAG}, ',') AS flags, round(records_z + 1e-9, 3) AS volume_z, round(negative_share_z + 1e-9, 3) AS negative_z FROM z""")
def anomaly_flags(spark, sf):
    z = A.robust_scores(A.daily_series(X.weighted(spark, sf), EMOTIONS), _ZCOLS)
    return z.select("day", F.concat_ws(",", A.anomaly_flags(z, EMOTIONS)).alias("flags"), A.r(F.col("records_z") + 1e-9, 3).alias("volume_z"), A.r(F.col("negative_share_z") + 1e-9, 3).alias("negative_z"))


def _shift_sql(target: str, base: str) -> str:
    return f"""{EW}, sh AS (SELECT {{side}} AS side, narrative AS name, count(*) AS n, sum(reputation_weight) AS w FROM weighted WHERE eligible AND reputation_weight > 0 GROUP BY 1, 2),
q AS (SELECT side, name, n, w / sum(w) OVER (PARTITION BY side) AS share FROM sh), t AS (SELECT * FROM q WHERE side = {target}), b AS (SELECT * FROM q WHERE side = {base}),
j AS (SELECT coalesce(t.name, b.name) AS name, coalesce(t.share, 0) AS ts, coalesce(b.share, 0) AS bs, coalesce(t.n, 0) AS tn, coalesce(b.n, 0) AS bn FROM t FULL JOIN b ON t.name = b.name)
SELECT name, round(ts, 6) AS target_share, round(bs, 6) AS baseline_share, round(ts - bs, 6) AS share_delta, tn AS target_records, bn AS baseline_records FROM j WHERE abs(round(ts - bs, 6)) >= 0.02 OR tn >= 2"""


@query(_shift_sql("1", "0").replace("{side}", "CASE WHEN day > '2024-01-15' THEN 1 ELSE 0 END"))
def share_shift_full_outer(spark, sf):
    w = X.weighted(spark, sf).withColumn("late", F.col("day") > "2024-01-15")
    both = A.share_by(w, "late", "narrative").withColumnRenamed("narrative", "name")
    return A.share_shift(both.where("late"), both.where("NOT late"), None)


@query(f"""{_DAILY}, top AS (SELECT day AS top_day FROM s ORDER BY records DESC, day LIMIT 1), sh AS (SELECT CASE WHEN day = top_day THEN 1 ELSE 0 END AS side, narrative AS name, count(*) AS n, sum(reputation_weight) AS w
 FROM weighted CROSS JOIN top WHERE eligible AND reputation_weight > 0 AND (day = top_day OR CAST(day AS DATE) BETWEEN CAST(top_day AS DATE) - 7 AND CAST(top_day AS DATE) - 1) GROUP BY 1, 2),
q AS (SELECT side, name, n, w / sum(w) OVER (PARTITION BY side) AS share FROM sh), t AS (SELECT * FROM q WHERE side = 1), b AS (SELECT * FROM q WHERE side = 0),
j AS (SELECT coalesce(t.name, b.name) AS name, coalesce(t.share, 0) AS ts, coalesce(b.share, 0) AS bs, coalesce(t.n, 0) AS tn, coalesce(b.n, 0) AS bn FROM t FULL JOIN b ON t.name = b.name)
SELECT name, round(ts, 6) AS target_share, round(bs, 6) AS baseline_share, round(ts - bs, 6) AS share_delta, tn AS target_records, bn AS baseline_records FROM j
WHERE abs(round(ts - bs, 6)) >= 0.02 OR tn >= 2 ORDER BY abs(round(ts - bs, 6)) DESC, tn DESC, name LIMIT 5""")
def anomaly_drivers(spark, sf):
    """Narratives whose share moved most between the busiest day and the seven days before it."""
    w = X.weighted(spark, sf)
    top = w.groupBy("day").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "day").limit(1).select(F.to_date("day").alias("top_day"))
    near = w.withColumn("_d", F.to_date("day")).crossJoin(F.broadcast(top)).where(F.col("_d").between(F.date_sub("top_day", 7), F.col("top_day"))).withColumn("hot", F.col("_d") == F.col("top_day"))
    both = A.share_by(near, "hot", "narrative").withColumnRenamed("narrative", "name")
    return A.share_shift(both.where("hot"), both.where("NOT hot"), 5)


@query(f"""{EW}, g AS (SELECT platform, primary_emotion, count(*) AS n, sum(reputation_weight) AS w, sum(reputation_weight * sentiment_score) AS ws, avg(impact_score) AS i FROM weighted WHERE eligible AND reputation_weight > 0 GROUP BY 1, 2)
SELECT platform, primary_emotion, n AS records, round(w / sum(w) OVER (PARTITION BY platform), 6) AS share, round(ws / w, 6) AS average_sentiment, round(i, 6) AS average_impact FROM g""")
def share_by(spark, sf):
    return A.share_by(X.weighted(spark, sf), "platform", "primary_emotion").withColumns({c: A.r(F.col(c), 6) for c in ("share", "average_sentiment", "average_impact")})


@query(f"{EW} SELECT platform, round({_NEG}, 6) AS negative_share, round({_emo('anger')}, 6) AS anger_share FROM weighted GROUP BY 1")
def weighted_share(spark, sf):
    w = X.weighted(spark, sf)
    return w.groupBy("platform").agg(A.r(A.weighted_share(F.col("sentiment_label") == "negative", A.rep_weight()), 6).alias("negative_share"), A.r(A.weighted_share(F.col("primary_emotion") == "anger", F.col("opinion_weight")), 6).alias("anger_share"))


_HALF = f"""{EW}, b AS (SELECT min(CAST(day AS DATE)) AS lo, max(CAST(day AS DATE)) AS hi FROM weighted), m AS (SELECT lo + CAST(floor((hi - lo) / 2) AS INTEGER) AS mid FROM b),
h AS (SELECT CASE WHEN CAST(day AS DATE) <= mid THEN 1 ELSE 2 END AS half, count(*) AS records, 50 * (1 + ({_MEAN})) AS rep, {_NEG} AS neg, {_emo('anger')} AS anger FROM weighted CROSS JOIN m GROUP BY 1)"""


def _halves(w: DataFrame) -> DataFrame:
    bounds = w.agg(F.min(F.to_date("day")).alias("lo"), F.max(F.to_date("day")).alias("hi"))
    mid = bounds.select(F.expr("date_add(lo, cast(floor(datediff(hi, lo) / 2) as int))").alias("mid"))
    return w.crossJoin(F.broadcast(mid)).withColumn("half", F.when(F.to_date("day") <= F.col("mid"), 1).otherwise(2))


@query(f"{_HALF} SELECT a.records AS first_records, z.records AS second_records, round(z.rep - a.rep, 2) AS reputation_points, round(100 * (z.neg - a.neg), 2) AS negative_points, round(100 * (z.anger - a.anger), 2) AS anger_points FROM h a, h z WHERE a.half = 1 AND z.half = 2")
def period_split(spark, sf):
    w = _halves(X.weighted(spark, sf))
    h = w.groupBy().agg(
        *[x for k in (1, 2) for x in (
            F.count_if(F.col("half") == k).alias(f"n{k}"),
            (50 * (1 + A.weighted_mean(A.S, F.when(F.col("half") == k, A.rep_weight())))).alias(f"rep{k}"),
            A.weighted_share(F.col("sentiment_label") == "negative", F.when(F.col("half") == k, A.rep_weight())).alias(f"neg{k}"),
            A.weighted_share(F.col("primary_emotion") == "anger", F.when(F.col("half") == k, F.col("opinion_weight"))).alias(f"ang{k}"),
        )]
    )
    return h.select(F.col("n1").alias("first_records"), F.col("n2").alias("second_records"), A.r(F.col("rep2") - F.col("rep1"), 2).alias("reputation_points"), A.r(100 * (F.col("neg2") - F.col("neg1")), 2).alias("negative_points"), A.r(100 * (F.col("ang2") - F.col("ang1")), 2).alias("anger_points"))


@query(_HALF.split("h AS (")[0] + """sh AS (SELECT CASE WHEN CAST(day AS DATE) <= mid THEN 0 ELSE 1 END AS side, narrative AS name, count(*) AS n, sum(reputation_weight) AS w FROM weighted CROSS JOIN m WHERE eligible AND reputation_weight > 0 GROUP BY 1, 2),
q AS (SELECT side, name, n, w / sum(w) OVER (PARTITION BY side) AS share FROM sh)
SELECT t.name, round(t.share, 6) AS share, round(t.share - coalesce(b.share, 0), 6) AS delta, t.n AS records, t.share - coalesce(b.share, 0) >= 0.12 AND t.n >= 3 AND t.share >= 0.15 AS emerging FROM q t LEFT JOIN q b ON t.name = b.name AND b.side = 0 WHERE t.side = 1""")
def emerging_narrative(spark, sf):
    both = A.share_by(_halves(X.weighted(spark, sf)), "half", "narrative").withColumnRenamed("narrative", "name")
    late = both.where("half = 2").select("name", "share", "records")
    early = both.where("half = 1").select("name", F.col("share").alias("before"))
    d = F.col("share") - F.coalesce("before", F.lit(0.0))
    return late.join(early, "name", "left").select("name", A.r(F.col("share"), 6).alias("share"), A.r(d, 6).alias("delta"), "records", ((d >= 0.12) & (F.col("records") >= 3) & (F.col("share") >= 0.15)).alias("emerging"))


@query(f"""{EW}, g AS (SELECT platform, {_IDX} AS idx, count(*) FILTER (WHERE eligible) AS n FROM weighted GROUP BY 1)
SELECT a.platform AS high, b.platform AS low, round(a.idx - b.idx, 2) AS gap, a.idx - b.idx >= 20 AND a.n >= 3 AND b.n >= 3 AS divergent FROM g a JOIN g b ON a.platform <> b.platform AND (a.idx > b.idx OR (a.idx = b.idx AND a.platform < b.platform))""")
def source_divergence(spark, sf):
    """Gaps between the indices of all pairs of platforms: a handful of rows on either side."""
    g = X.weighted(spark, sf).groupBy("platform").agg(A.index_of(A.weighted_mean(A.S, A.rep_weight())).alias("idx"), F.count_if(A.ELIGIBLE).alias("n"))
    a, b = g.alias("a"), F.broadcast(g).alias("b")
    on = (F.col("a.platform") != F.col("b.platform")) & ((F.col("a.idx") > F.col("b.idx")) | ((F.col("a.idx") == F.col("b.idx")) & (F.col("a.platform") < F.col("b.platform"))))
    gap = F.col("a.idx") - F.col("b.idx")
    return a.join(b, on).select(F.col("a.platform").alias("high"), F.col("b.platform").alias("low"), A.r(gap, 2).alias("gap"), ((gap >= 20) & (F.col("a.n") >= 3) & (F.col("b.n") >= 3)).alias("divergent"))


@query(f"""{EW}, g AS (SELECT sum(reputation_weight * sentiment_score) FILTER (WHERE eligible AND origin_group = 'media') / sum(reputation_weight) FILTER (WHERE eligible AND origin_group = 'media') AS m,
 sum(reputation_weight * sentiment_score) FILTER (WHERE eligible AND origin_group = 'person') / sum(reputation_weight) FILTER (WHERE eligible AND origin_group = 'person') AS p FROM weighted)
SELECT round(50 * (1 + m), 2) AS media_index, round(50 * (1 + p), 2) AS person_index, round(50 * (m - p), 2) AS gap, abs(50 * (m - p)) >= 15 AS divergent FROM g""")
def origin_divergence(spark, sf):
    part = lambda g: A.weighted_mean(A.S, F.when(F.col("origin_group") == g, A.rep_weight()))
    g = X.weighted(spark, sf).agg(part("media").alias("m"), part("person").alias("p"))
    gap = 50 * (F.col("m") - F.col("p"))
    return g.select(A.r(50 * (1 + F.col("m")), 2).alias("media_index"), A.r(50 * (1 + F.col("p")), 2).alias("person_index"), A.r(gap, 2).alias("gap"), (F.abs(gap) >= 15).alias("divergent"))


@query(f"{_DAILY}, l AS (SELECT day, idx, idx - lag(idx) OVER (ORDER BY day) AS delta FROM s) SELECT day, round(delta, 2) AS delta, abs(delta) >= 8 AS triggered FROM l WHERE delta IS NOT NULL ORDER BY abs(delta) DESC, day LIMIT 1")
def daily_change_lag(spark, sf):
    """The largest change from one day to the next; the window runs over one row a day."""
    d = X.weighted(spark, sf).groupBy("day").agg(A.index_of(A.weighted_mean(A.S, A.rep_weight())).alias("idx"))
    d = d.withColumn("delta", F.col("idx") - F.lag("idx").over(Window.partitionBy().orderBy("day"))).where("delta IS NOT NULL")
    return d.orderBy(F.abs("delta").desc(), "day").limit(1).select("day", A.r(F.col("delta"), 2).alias("delta"), (F.abs("delta") >= 8).alias("triggered"))


@query(f"""{EV}, d AS (SELECT platform, CAST(day AS DATE) AS day, count(*) AS n FROM evidence GROUP BY 1, 2)
SELECT platform, CAST(day AS VARCHAR) AS day, n, round(avg(n) OVER (PARTITION BY platform ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING), 6) AS baseline FROM d""")
def baseline_7d(spark, sf):
    d = X.evidence(spark, sf).groupBy("platform", "day").agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.unix_date(F.to_date("day")))
    w = Window.partitionBy("platform").orderBy("_k").rangeBetween(-7, -1)
    return d.select("platform", "day", "n", A.r(F.avg("n").over(w), 6).alias("baseline"))


@query(f"""{EV}, g AS (SELECT author, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY author ORDER BY ts, ord)) AS gap FROM evidence)
SELECT author, count(*) AS posts, count(*) FILTER (WHERE gap <= 180) AS rapid_gaps, round(min(gap), 3) AS shortest FROM g GROUP BY 1""")
def post_gaps(spark, sf):
    w = Window.partitionBy("author").orderBy("ts", "ord")
    sec = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    g = X.evidence(spark, sf).withColumn("gap", sec - F.lag(sec).over(w))
    return g.groupBy("author").agg(F.count(F.lit(1)).alias("posts"), F.count_if(F.col("gap") <= 180).alias("rapid_gaps"), A.r(F.min("gap"), 3).alias("shortest"))


@query(f"{EV}, a AS (SELECT author, min(ts) AS t, min(ord) AS o FROM evidence GROUP BY 1) SELECT author, row_number() OVER (ORDER BY t, o) AS number FROM a")
def first_seen_rank(spark, sf):
    """Authors numbered by first appearance: ranks within day ranges plus the counts before them."""
    a = X.evidence(spark, sf).groupBy("author").agg(F.min("ts").alias("t"), F.min("ord").alias("o")).withColumn("d", F.to_date("t"))
    before = a.groupBy("d").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy().orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("d").orderBy("t", "o"))
    return a.withColumn("k", rank).join(F.broadcast(before.select("d", "before")), "d").select("author", (F.col("k") + F.col("before")).cast("long").alias("number"))


_COMP = "abs(sentiment_score) * (0.45 + 0.55 * impact_score) + 0.15 * impact_score"


@query(f"""{EW}, a AS (SELECT *, {_COMP} AS comp FROM weighted), t AS (SELECT ord FROM a ORDER BY round(comp, 9) DESC, impact_score DESC, abs(sentiment_score) DESC, ord LIMIT 20),
x AS (SELECT ord, row_number() OVER (PARTITION BY sentiment_label ORDER BY abs(sentiment_score) DESC, ord) AS k, sentiment_label FROM a WHERE sentiment_label IN ('positive', 'negative'))
SELECT a.id, a.platform, a.sentiment_label, a.impact_score, a.ord IN (SELECT ord FROM t) AS by_rank FROM a WHERE ord IN (SELECT ord FROM t) OR ord IN (SELECT ord FROM x WHERE k <= 2)""")
def top_mentions(spark, sf, limit: int = 20):
    """The most material records and, in reserved slots, the two most intense of each polarity."""
    comp = F.round(F.abs("sentiment_score") * (0.45 + 0.55 * F.col("impact_score")) + 0.15 * F.col("impact_score"), 9)
    w = X.weighted(spark, sf).select("ord", "id", "platform", "sentiment_label", "sentiment_score", "impact_score", comp.alias("comp"))
    strong = F.abs("sentiment_score").desc()
    top = w.orderBy(F.col("comp").desc(), F.col("impact_score").desc(), strong, "ord").limit(limit).withColumn("by_rank", F.lit(True))
    edge = A.top_by(w.where(F.col("sentiment_label").isin("positive", "negative")), ["sentiment_label"], [strong, F.col("ord")], 2).drop("rank").withColumn("by_rank", F.lit(False))
    both = top.unionByName(edge).groupBy("ord", "id", "platform", "sentiment_label", "impact_score").agg(F.max("by_rank").alias("by_rank"))
    return both.select("id", "platform", "sentiment_label", "impact_score", "by_rank")


@query(f"{EW} SELECT id, round(abs(sentiment_score) * greatest(0.01, reputation_weight), 6) AS strength FROM weighted ORDER BY round(abs(sentiment_score) * greatest(0.01, reputation_weight), 9) DESC, impact_score DESC, evidence_confidence DESC, id LIMIT 15")
def evidence_rank(spark, sf):
    s = F.abs("sentiment_score") * F.greatest(F.lit(0.01), A.W)
    return X.weighted(spark, sf).orderBy(F.round(s, 9).desc(), F.col("impact_score").desc(), F.col("evidence_confidence").desc(), "id").limit(15).select("id", A.r(s, 6).alias("strength"))


@query(f"""{EW}, a AS (SELECT *, row_number() OVER (PARTITION BY sentiment_label ORDER BY abs(sentiment_score) DESC, impact_score DESC, ord) AS rank FROM weighted WHERE origin_group <> 'brand_owned' AND sentiment_label <> 'neutral')
SELECT sentiment_label, rank, id, sentiment_score FROM a WHERE rank <= 10""")
def top_comments(spark, sf):
    w = X.weighted(spark, sf).where("origin_group <> 'brand_owned' AND sentiment_label <> 'neutral'").select("sentiment_label", "id", "sentiment_score", "impact_score", "ord")
    return A.top_by(w, ["sentiment_label"], [F.abs("sentiment_score").desc(), F.col("impact_score").desc(), F.col("ord")], 10).select("sentiment_label", "rank", "id", "sentiment_score")


@query(f"{EW}, a AS (SELECT platform, sentiment_label, author, impact_score, row_number() OVER (PARTITION BY platform, sentiment_label ORDER BY impact_score DESC, ord) AS k FROM weighted) SELECT platform, sentiment_label, author, round(impact_score, 6) AS impact_score FROM a WHERE k = 1")
def leading_voice(spark, sf):
    """argmax with ties to the first record: one partial aggregate, no sort."""
    key = F.struct(F.col("impact_score"), (-F.col("ord")).alias("o"))
    g = X.weighted(spark, sf).groupBy("platform", "sentiment_label").agg(F.max_by(F.struct("author", "impact_score"), key).alias("b"))
    return g.select("platform", "sentiment_label", "b.author", A.r(F.col("b.impact_score"), 6).alias("impact_score"))


@query(f"""{EW}, g AS (SELECT author, round(sum(impact_score), 6) AS attention FROM weighted GROUP BY 1), k AS (SELECT author, attention, row_number() OVER (ORDER BY attention DESC, author) AS rank FROM g ORDER BY rank LIMIT 30)
SELECT author, attention, rank, CAST(ceil(rank / 12.0) AS INTEGER) AS page FROM k""")
def paged_ranking(spark, sf):
    top = X.weighted(spark, sf).groupBy("author").agg(A.r(F.sum("impact_score"), 6).alias("attention")).orderBy(F.col("attention").desc(), "author").limit(30)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.col("attention").desc(), "author"))).withColumn("page", F.ceil(F.col("rank") / 12).cast("int"))


@query(f"""{EV}, g AS (SELECT platform, sum(views) AS views FROM evidence GROUP BY 1), f AS (SELECT platform, author, max(followers) AS m FROM evidence GROUP BY 1, 2)
SELECT g.platform, views, sum(m) AS potential_reach, count(*) AS authors FROM g JOIN f USING (platform) GROUP BY 1, 2""")
def reach_totals(spark, sf):
    """Views summed over records; followers once an author."""
    a = X.evidence(spark, sf).groupBy("platform", "author").agg(F.sum("views").alias("v"), F.max("followers").alias("m"))
    return a.groupBy("platform").agg(F.sum("v").alias("views"), F.sum("m").alias("potential_reach"), F.count(F.lit(1)).alias("authors"))


@query(f"""{_DAILY}, w AS (SELECT min(day) AS lo, max(day) AS hi FROM s), t AS (SELECT count(*) AS records, round(100.0 * count(*) FILTER (WHERE sentiment_label = 'positive') / count(*), 2) AS positive_pct,
 round(100.0 * count(*) FILTER (WHERE sentiment_label = 'negative') / count(*), 2) AS negative_pct, string_agg(DISTINCT platform, ',' ORDER BY platform) AS channels FROM weighted)
SELECT t.*, round(z.idx - a.idx, 2) AS index_change FROM t CROSS JOIN w JOIN s a ON a.day = lo JOIN s z ON z.day = hi""")
def exec_dashboard(spark, sf):
    w = X.weighted(spark, sf)
    pct = lambda x: A.r(100 * F.count_if(F.col("sentiment_label") == x) / F.count(F.lit(1)), 2)
    t = w.agg(F.count(F.lit(1)).alias("records"), pct("positive").alias("positive_pct"), pct("negative").alias("negative_pct"), F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("channels"))
    d = w.groupBy("day").agg(A.index_of(A.weighted_mean(A.S, A.rep_weight())).alias("idx")).agg((F.max_by("idx", "day") - F.min_by("idx", "day")).alias("c"))
    return t.crossJoin(F.broadcast(d)).select("records", "positive_pct", "negative_pct", "channels", A.r(F.col("c"), 2).alias("index_change"))


@query(f"""{EW}, h AS (SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, count(*) AS records, sum(impact_score * sentiment_score) / sum(impact_score) AS m FROM weighted GROUP BY 1)
SELECT hour, records, round(50 * (1 + m), 2) AS "index", round(50 * (m - lag(m) OVER (ORDER BY hour)), 2) AS change FROM h""")
def hourly_timeline(spark, sf):
    """Hourly index and its change; the window runs over one row an hour."""
    h = X.weighted(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("hour")).agg(F.count(F.lit(1)).alias("records"), A.weighted_mean(A.S, F.col("impact_score")).alias("m"))
    step = 50 * (F.col("m") - F.lag("m").over(Window.partitionBy().orderBy("hour")))
    return h.select("hour", "records", A.r(50 * (1 + F.col("m")), 2).alias("index"), A.r(step, 2).alias("change"))


@query(f"""{EW}, g AS (SELECT primary_emotion AS e, sum(opinion_weight) AS w, count(*) AS n FROM weighted WHERE opinion_eligible GROUP BY 1), p AS (SELECT e, n, w / sum(w) OVER () AS share FROM g)
SELECT round(sum(share) FILTER (WHERE e IN ('joy', 'surprise')), 4) AS positive_share, round(sum(share) FILTER (WHERE e IN ('anger', 'sadness', 'fear', 'disgust')), 4) AS negative_share,
 max_by(e, share) FILTER (WHERE e <> 'neutral') AS leader, round(max(share) FILTER (WHERE e <> 'neutral'), 4) AS leader_share, coalesce(max(share) FILTER (WHERE e <> 'neutral' AND n >= 5) >= 0.25, false) AS triggered FROM p""")
def emotion_profile(spark, sf):
    g = X.weighted(spark, sf).where("opinion_eligible").groupBy("primary_emotion").agg(F.sum("opinion_weight").alias("w"), F.count(F.lit(1)).alias("n"))
    p = g.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy()))  # seven rows
    e, s = F.col("primary_emotion"), F.col("share")
    warm, named = e.isin("joy", "surprise"), e != "neutral"
    return p.agg(
        A.r(F.sum(F.when(warm, s))).alias("positive_share"), A.r(F.sum(F.when(named & ~warm, s))).alias("negative_share"), F.max_by(e, F.when(named, s)).alias("leader"), A.r(F.max(F.when(named, s))).alias("leader_share"),
        F.coalesce(F.max(F.when(named & (F.col("n") >= 5), s)) >= 0.25, F.lit(False)).alias("triggered"),
    )


@query(f"""{EW}, g AS (SELECT primary_emotion AS e, sum(opinion_weight) AS w FROM weighted WHERE opinion_eligible AND primary_emotion <> 'neutral' GROUP BY 1),
t AS (SELECT e FROM (SELECT e, w / (SELECT sum(opinion_weight) FROM weighted WHERE opinion_eligible) AS share FROM g) WHERE share >= 0.12 ORDER BY share DESC, e LIMIT 3),
v AS (SELECT primary_emotion AS emotion, author, round(sum(impact_score), 6) AS attention FROM weighted JOIN t ON primary_emotion = e WHERE opinion_eligible GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY emotion ORDER BY attention DESC, author) AS rank FROM v) SELECT emotion, rank, author, attention FROM k WHERE rank <= 3""")
def emotion_anatomy(spark, sf):
    """The three loudest authors of each of the at most three leading emotions of 12 % or more."""
    o = X.weighted(spark, sf).where("opinion_eligible")
    share = F.col("w") / F.sum("w").over(Window.partitionBy())  # seven rows
    top = o.groupBy("primary_emotion").agg(F.sum("opinion_weight").alias("w")).withColumn("share", share).where("primary_emotion <> 'neutral' AND share >= 0.12").orderBy(F.col("share").desc(), "primary_emotion").limit(3)
    v = o.join(F.broadcast(top.select("primary_emotion")), "primary_emotion").groupBy(F.col("primary_emotion").alias("emotion"), "author").agg(A.r(F.sum("impact_score"), 6).alias("attention"))
    return A.top_by(v, ["emotion"], [F.col("attention").desc(), F.col("author")], 3).select("emotion", "rank", "author", "attention")


@query(f"""{EW}, s AS (SELECT platform, day, round({_IDX}, 2) AS idx FROM weighted GROUP BY 1, 2), l AS (SELECT *, idx - lag(idx) OVER (PARTITION BY platform ORDER BY day) AS d FROM s)
SELECT platform, count(*) FILTER (WHERE d < 0) AS declines, count(*) FILTER (WHERE round(d, 6) > 0.5) AS recoveries, min(idx) AS low, max(idx) AS high FROM l GROUP BY 1""")
def trajectory_profile(spark, sf):
    s = X.weighted(spark, sf).groupBy("platform", "day").agg(A.r(A.index_of(A.weighted_mean(A.S, A.rep_weight())), 2).alias("idx"))
    d = F.col("idx") - F.lag("idx").over(Window.partitionBy("platform").orderBy("day"))
    return s.withColumn("d", d).groupBy("platform").agg(F.count_if(F.col("d") < 0).alias("declines"), F.count_if(F.round("d", 6) > 0.5).alias("recoveries"), F.min("idx").alias("low"), F.max("idx").alias("high"))


@query(f"""{EW}, s AS (SELECT platform, day, round({_IDX}, 2) AS idx FROM weighted GROUP BY 1, 2), l AS (SELECT *, coalesce(idx > lag(idx) OVER (PARTITION BY platform ORDER BY day), false) AS up FROM s),
b AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY platform ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS isl FROM l) SELECT platform, count(*) FILTER (WHERE isl = 0) AS streak FROM b GROUP BY 1""")
def recovery_streak(spark, sf):
    """Days of improvement in a row up to the last one: islands counted from the end."""
    s = X.weighted(spark, sf).groupBy("platform", "day").agg(A.r(A.index_of(A.weighted_mean(A.S, A.rep_weight())), 2).alias("idx"))
    w = Window.partitionBy("platform").orderBy("day")
    s = s.withColumn("up", F.coalesce(F.col("idx") > F.lag("idx").over(w), F.lit(False)))
    back = Window.partitionBy("platform").orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("isl", F.sum(F.when(F.col("up"), 0).otherwise(1)).over(back)).groupBy("platform").agg(F.count_if(F.col("isl") == 0).alias("streak"))


@query(f"""{EW} SELECT CASE WHEN grouping(sentiment_label) = 0 THEN 'sentiment' WHEN grouping(primary_emotion) = 0 THEN 'emotion' ELSE 'stance' END AS dimension,
 coalesce(sentiment_label, primary_emotion, target_stance) AS label, count(*) AS n FROM weighted GROUP BY GROUPING SETS ((sentiment_label), (primary_emotion), (target_stance))""")
def analysis_report(spark, sf):
    """Counts over three vocabularies in one pass."""
    w = X.weighted(spark, sf).groupingSets([[F.col("sentiment_label")], [F.col("primary_emotion")], [F.col("target_stance")]], F.col("sentiment_label"), F.col("primary_emotion"), F.col("target_stance"))
    g = w.agg(F.count(F.lit(1)).alias("n"), F.grouping("sentiment_label").alias("a"), F.grouping("primary_emotion").alias("b"))
    return g.select(F.when(F.col("a") == 0, "sentiment").when(F.col("b") == 0, "emotion").otherwise("stance").alias("dimension"), F.coalesce("sentiment_label", "primary_emotion", "target_stance").alias("label"), "n")


@query(f"""{EV}, u AS (SELECT DISTINCT ord // 12 AS response, platform AS model, (ord // 12) % 400 AS tokens FROM evidence) SELECT model, count(*) AS responses, CAST(sum(tokens) AS BIGINT) AS tokens FROM u GROUP BY 1""")
def distinct_usage(spark, sf):
    """Usage is reported on every record of a batch but counts once a response and model."""
    u = X.evidence(spark, sf).select(F.floor(F.col("ord") / 12).alias("response"), F.col("platform").alias("model")).withColumn("tokens", F.col("response") % 400).dropDuplicates(["response", "model"])
    return u.groupBy("model").agg(F.count(F.lit(1)).alias("responses"), F.sum("tokens").alias("tokens"))


_PEND = "(ord % 7 = 0)"


@query(f"""{EW}, r AS (SELECT sum(reputation_weight) AS whole FROM weighted WHERE NOT {_PEND}), m AS (SELECT id, abs(sentiment_score) * 50 * (independent_voice_weight * authenticity * evidence_confidence * attention_multiplier)
 / (whole + independent_voice_weight * authenticity * evidence_confidence * attention_multiplier) AS movement FROM weighted CROSS JOIN r WHERE {_PEND}) SELECT id, round(movement, 6) AS movement FROM m""")
def triage_movement(spark, sf):
    w = X.weighted(spark, sf)
    whole = w.where("ord % 7 <> 0").agg(F.sum("reputation_weight").alias("whole"))
    v = F.col("independent_voice_weight") * F.col("authenticity") * F.col("evidence_confidence") * F.col("attention_multiplier")
    m = w.where("ord % 7 = 0").crossJoin(F.broadcast(whole))
    return m.select("id", A.r(scores.triage_movement(F.abs("sentiment_score"), v, F.col("whole")), 6).alias("movement"))


@query(f"""{EW}, r AS (SELECT sum(reputation_weight) AS whole FROM weighted WHERE NOT {_PEND}), m AS (SELECT abs(sentiment_score) * 50 * (independent_voice_weight * authenticity * evidence_confidence * attention_multiplier)
 / (whole + independent_voice_weight * authenticity * evidence_confidence * attention_multiplier) AS movement FROM weighted CROSS JOIN r WHERE {_PEND})
SELECT count(*) AS total_pending, count(*) FILTER (WHERE movement >= 0.01) AS material_count, round(max(movement), 3) AS max_movement, round(coalesce(sum(movement) FILTER (WHERE movement >= 0.01), 0), 3) AS combined_movement FROM m""")
def triage_summary(spark, sf, threshold: float = 0.01):
    w = X.weighted(spark, sf)
    whole = w.where("ord % 7 <> 0").agg(F.sum("reputation_weight").alias("whole"))
    v = F.col("independent_voice_weight") * F.col("authenticity") * F.col("evidence_confidence") * F.col("attention_multiplier")
    m = w.where("ord % 7 = 0").crossJoin(F.broadcast(whole)).select(scores.triage_movement(F.abs("sentiment_score"), v, F.col("whole")).alias("movement"))
    big = F.col("movement") >= threshold
    return m.agg(F.count(F.lit(1)).alias("total_pending"), F.count_if(big).alias("material_count"), A.r(F.max("movement"), 3).alias("max_movement"), A.r(F.coalesce(F.sum(F.when(big, F.col("movement"))), F.lit(0.0)), 3).alias("combined_movement"))


@query(f"{EW} SELECT id, reason, eligible, reputation_weight FROM weighted")
def eligibility(spark, sf):
    return X.weighted(spark, sf).select("id", "reason", "eligible", F.col("reputation_weight"))


@query(f"{EW} SELECT id, round(views_s, 6) AS views_score, round(engagement_s, 6) AS engagement_score, round(followers_s, 6) AS authority_score, impact_score, impact_confidence FROM weighted")
def norm_metric(spark, sf):
    return X.weighted(spark, sf).select("id", A.r(F.col("views_s"), 6).alias("views_score"), A.r(F.col("engagement_s"), 6).alias("engagement_score"), A.r(F.col("followers_s"), 6).alias("authority_score"), "impact_score", "impact_confidence")


@query(f"{EV} SELECT id, round(least(1, (0.36 * ln(1 + coalesce(views, 0)) + 0.25 * ln(1 + coalesce(likes, 0)) + 0.16 * ln(1 + coalesce(comments, 0)) + 0.18 * ln(1 + coalesce(shares, 0)) + 0.05 * ln(1 + coalesce(followers, 0))) / 7), 4) AS impact FROM evidence")
def routing_impact(spark, sf):
    return X.evidence(spark, sf).select("id", scores.routing_impact(*map(F.col, ("views", "likes", "comments", "shares", "followers"))).alias("impact"))


@query(f"""{EV} SELECT id, round(ln(1 + coalesce(comments, 0)) + 0.25 * ln(1 + coalesce(likes, 0)) + 4 * authenticity + CASE WHEN opinion_eligible THEN 1 ELSE 0 END
 - CASE WHEN content_class IN ('promotional', 'news', 'owned') THEN 3 ELSE 0 END - CASE WHEN origin_group = 'media' THEN 1 ELSE 0 END, 6) AS heat FROM evidence""")
def parent_heat(spark, sf):
    origin = F.when(F.col("origin_group") == "media", "earned_media").otherwise("earned_person")
    return X.evidence(spark, sf).select("id", A.r(scores.parent_heat(F.col("comments"), F.col("likes"), F.col("authenticity"), F.lit("review"), F.col("opinion_eligible"), F.col("content_class"), origin), 6).alias("heat"))


_SEED = "(comments > 0 AND content_class <> 'owned')"


@query(f"{EV} SELECT id, CAST(comments AS BIGINT) AS replies, round(2 * sqrt(comments) + authenticity + 0.5 * evidence_confidence, 4) AS score FROM evidence WHERE {_SEED} ORDER BY round(2 * sqrt(comments) + authenticity + 0.5 * evidence_confidence, 9) DESC, comments DESC, ord LIMIT 40")
def reply_seeds(spark, sf):
    s = scores.reply_seed_score(F.col("comments"), F.col("authenticity"), F.col("evidence_confidence"))
    e = X.evidence(spark, sf).where("comments > 0 AND content_class <> 'owned'")
    return e.orderBy(F.round(s, 9).desc(), F.col("comments").desc(), "ord").limit(40).select("id", F.col("comments").cast("long").alias("replies"), A.r(s).alias("score"))


@query(f"""{EV}, c AS (SELECT *, round(2 * sqrt(comments) + authenticity + 0.5 * evidence_confidence, 9) AS score FROM evidence WHERE {_SEED}), k AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY score DESC, ord) AS nth FROM c)
SELECT id, author, nth FROM k WHERE nth <= 2 ORDER BY score DESC, ord LIMIT 30""")
def seeds_top_n_per_author(spark, sf):
    s = F.round(scores.reply_seed_score(F.col("comments"), F.col("authenticity"), F.col("evidence_confidence")), 9)
    e = X.evidence(spark, sf).where("comments > 0 AND content_class <> 'owned'").select("id", "author", "ord", s.alias("score"))
    return A.top_by(e, ["author"], [F.col("score").desc(), F.col("ord")], 2, "nth").orderBy(F.col("score").desc(), "ord").limit(30).select("id", "author", "nth")


@query(f"""{EW} SELECT narrative, count(*) AS records, count(DISTINCT author) AS authors, string_agg(DISTINCT platform, ',' ORDER BY platform) AS platforms, round(avg(sentiment_score), 6) AS mean_sentiment, round(sum(impact_score), 6) AS attention
FROM weighted WHERE content_class = 'organic' GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT author) >= 2""")
def coordination_clusters(spark, sf):
    w = X.weighted(spark, sf).where("content_class = 'organic'")
    g = w.groupBy("narrative").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("author").alias("authors"), F.array_join(F.sort_array(F.collect_set("platform")), ",").alias("platforms"), A.r(F.avg("sentiment_score"), 6).alias("mean_sentiment"), A.r(F.sum("impact_score"), 6).alias("attention"))
    return g.where("records >= 3 AND authors >= 2")


@query(f"""{EW} SELECT topic, count(*) AS records, count(DISTINCT author) AS authors, round(avg(sentiment_score), 6) AS mean_sentiment FROM weighted WHERE content_class = 'news' GROUP BY 1 HAVING count(*) >= 2""")
def story_clusters(spark, sf):
    g = X.weighted(spark, sf).where("content_class = 'news'").groupBy("topic").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("author").alias("authors"), A.r(F.avg("sentiment_score"), 6).alias("mean_sentiment"))
    return g.where("records >= 2")


@query(f"""{EV} SELECT count(*) FILTER (WHERE content_class = 'owned') AS owned_pages, count(*) FILTER (WHERE content_class = 'organic') AS open_search, count(*) FILTER (WHERE content_class NOT IN ('owned', 'organic')) AS unlabelled,
 round(100.0 * count(*) FILTER (WHERE content_class = 'owned') / nullif(count(*) FILTER (WHERE content_class IN ('owned', 'organic')), 0), 1) AS owned_share_pct FROM evidence""")
def sampling_origin(spark, sf):
    c = F.col("content_class")
    own, opn = F.count_if(c == "owned"), F.count_if(c == "organic")
    return X.evidence(spark, sf).agg(own.alias("owned_pages"), opn.alias("open_search"), (F.count(F.lit(1)) - own - opn).alias("unlabelled"), A.r(100 * own / F.nullif((own + opn).cast("double"), F.lit(0.0)), 1).alias("owned_share_pct"))


@query(f"""{EV}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE ord % 9 <> 0 AND ord % 5 <> 0) AS trusted, count(*) FILTER (WHERE ord % 5 = 0) AS excluded, avg(evidence_confidence) AS conf, count(*) FILTER (WHERE views IS NOT NULL) AS complete, count(DISTINCT platform) AS sources FROM evidence),
q AS (SELECT *, 100 * (0.28 * (2.0 * n + complete) / (3 * n) + 0.24 * conf + 0.28 * least(1, trusted / 5000.0) + 0.20 * sources / 5.0) - 12.0 * excluded / n AS s FROM t)
SELECT n AS total_records, trusted AS trusted_records, excluded AS excluded_records, round(least(100, greatest(0, s)), 3) AS score, CASE WHEN s >= 80 THEN 'high' WHEN s >= 60 THEN 'medium' ELSE 'low' END AS label FROM q""")
def quality_report(spark, sf, target: int = 5000, wanted_sources: int = 5):
    o = F.col("ord")
    t = X.evidence(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if((o % 9 != 0) & (o % 5 != 0)).alias("trusted"), F.count_if(o % 5 == 0).alias("excluded"), F.avg("evidence_confidence").alias("conf"), F.count("views").alias("complete"), F.count_distinct("platform").alias("sources"))
    n = F.col("n")
    s = 100 * (0.28 * (2.0 * n + F.col("complete")) / (3 * n) + 0.24 * F.col("conf") + 0.28 * F.least(F.lit(1.0), F.col("trusted") / float(target)) + 0.2 * F.col("sources") / float(wanted_sources)) - 12.0 * F.col("excluded") / n
    return t.select(n.alias("total_records"), F.col("trusted").alias("trusted_records"), F.col("excluded").alias("excluded_records"), A.r(scores.clamp(s, 0.0, 100.0), 3).alias("score"), F.when(s >= 80, "high").when(s >= 60, "medium").otherwise("low").alias("label"))


def _listed(pattern: str, columns: str, source: str, order: str, limit: int) -> str:
    return f"(SELECT CASE WHEN count(*) > 0 THEN '[' || string_agg(printf('{pattern}', {columns}), ',' ORDER BY k) || ']' END FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS k FROM {source}) WHERE k <= {limit})"


def _counted(field: str, labels: tuple[str, ...], only: str) -> str:
    whole = f"count(*) FILTER (WHERE {only} AND {field} IN ({', '.join(repr(x) for x in labels)}))"
    pattern = '{"records":%d,' + ",".join(f'"{x}":%d' for x in labels) + "}"
    each = ", ".join(f"count(*) FILTER (WHERE {only} AND {field} = '{x}')" for x in labels)
    return f"(SELECT CASE WHEN {whole} > 0 THEN printf('{pattern}', {whole}, {each}) END FROM q)"


def _drivers(key: str) -> str:
    return f"(SELECT name, round(50 * ws / sum(w) OVER (), 4) AS points FROM (SELECT {key} AS name, sum(reputation_weight) AS w, sum(reputation_weight * sentiment_score) AS ws FROM q WHERE eligible GROUP BY 1))"


def _copied(key: str, kind: str, least: int, people: int) -> str:
    return f"(SELECT {key} AS name, count(*) AS records, count(DISTINCT author) AS authors FROM q WHERE content_class = '{kind}' GROUP BY 1 HAVING count(*) >= {least} AND count(DISTINCT author) >= {people})"


def _loudest(group: str) -> str:
    return f"(SELECT author AS name, round(sum(impact_score), 6) AS attention FROM q WHERE origin_group = '{group}' GROUP BY 1)"


_POINTS, _COPIES = '{"name":"%s","points":%.4f}', '{"name":"%s","records":%d,"authors":%d}'
_VALUES = {
    "sample_volume": """(SELECT printf('{"records":%d,"eligible":%d,"organic":%d,"trusted":%d,"voices":%.4f}', n, eligible, organic, trusted, round(voices, 4)) FROM t)""",
    "market_relevance": """(SELECT printf('{"records":%d,"high":%d,"share":%.4f,"average":%.4f}', scored, high, round(high / scored, 4), round(market, 4)) FROM t)""",
    "brand_reputation": """(SELECT printf('{"index":%.2f,"interpretation":"%s"}', round(idx, 2), CASE WHEN idx < 45 THEN 'negative' WHEN idx > 55 THEN 'positive' ELSE 'neutral_band' END) FROM t)""",
    "evidence_confidence": """(SELECT printf('{"score":%.2f,"label":"%s"}', round(score, 2), CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END) FROM v)""",
    "sentiment": _counted("sentiment_label", SENTIMENTS, "eligible"),
    "emotions": _counted("primary_emotion", EMOTIONS, "opinion_eligible"),
    "stance": _counted("target_stance", STANCES, "true"),
    "impact_attention": """(SELECT printf('{"known":%d,"records":%d,"share":%.4f}', known, n, round(known / n, 4)) FROM t)""",
    "effective_independent_voices": """(SELECT printf('{"voices":%.4f}', round(voices, 4)) FROM t)""",
    "origin_breakdown": _counted("origin_group", GROUPS, "true"),
    "source_breakdown": _listed('{"name":"%s","records":%d}', "name, records", "(SELECT platform AS name, count(*) AS records FROM q GROUP BY 1)", "records DESC, name", 50),
    "positive_narrative_drivers": _listed(_POINTS, "name, points", f"(SELECT * FROM {_drivers('narrative')} WHERE points > 0)", "abs(points) DESC, name", 10),
    "negative_narrative_drivers": _listed(_POINTS, "name, points", f"(SELECT * FROM {_drivers('narrative')} WHERE points < 0)", "abs(points) DESC, name", 10),
    "topic_drivers": _listed(_POINTS, "name, points", _drivers("topic"), "abs(points) DESC, name", 10),
    "media_influence": _listed('{"name":"%s","attention":%.4f}', "name, round(attention, 4)", _loudest("media"), "attention DESC, name", 10),
    "people_influence": _listed('{"name":"%s","attention":%.4f}', "name, round(attention, 4)", _loudest("person"), "attention DESC, name", 10),
    "time_trends": """(SELECT CASE WHEN days >= 2 THEN printf('{"days":%d,"first":"%s","last":"%s"}', days, lo, hi) END FROM t)""",
    "numeric_anomalies": _listed('{"day":"%s","flags":"%s"}', "day, flags", f"(SELECT day, array_to_string({_FLAG}, ',') AS flags FROM z WHERE len({_FLAG}) > 0)", "day", 50),
    "data_quality": """(SELECT printf('{"score":%.2f,"label":"%s"}', round(quality, 2), CASE WHEN quality >= 80 THEN 'high' WHEN quality >= 60 THEN 'medium' ELSE 'low' END) FROM v)""",
    "source_coverage": """(SELECT printf('{"ratio":%.4f,"sources":%d}', round(coverage, 4), sources) FROM v)""",
    "sample_achievement": """(SELECT printf('{"ratio":%.4f,"trusted":%d}', round(trusted / 5000.0, 4), trusted) FROM t)""",
    "authenticity_risk": """(SELECT printf('{"low":%d,"share":%.4f}', low, round(low / n, 4)) FROM t)""",
    "coordination": _listed(_COPIES, "name, records, authors", _copied("narrative", "organic", 3, 2), "records DESC, name", 10),
    "story_syndication": _listed(_COPIES, "name, records, authors", _copied("topic", "news", 2, 1), "records DESC, name", 10),
    "top_mentions": _listed('{"id":"%s","platform":"%s"}', "id, platform", "q", "impact_score DESC, abs(sentiment_score) DESC, evidence_confidence DESC, id", 15),
}
_INVENTORY = f"""{_DAILY}, md AS (SELECT count(*) AS k, {_MED} FROM s), ad AS (SELECT {_MAD} FROM s CROSS JOIN md), z AS (SELECT s.*, {_ZED} FROM s CROSS JOIN md CROSS JOIN ad),
q AS (SELECT *, CASE WHEN ord % 3 <> 0 THEN CAST(ord % 50 AS DOUBLE) / 50 END AS market_score, CASE WHEN ord % 5 = 0 THEN 'excluded' WHEN ord % 9 = 0 THEN 'review' ELSE 'trusted' END AS decision FROM weighted),
t AS (SELECT count(*) AS n, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE opinion_eligible) AS organic, count(*) FILTER (WHERE decision = 'trusted') AS trusted, count(*) FILTER (WHERE decision = 'excluded') AS excluded,
 sum(independent_voice_weight) AS voices, count(market_score) AS scored, count(*) FILTER (WHERE market_score >= 0.65) AS high, avg(market_score) AS market, {_IDX} AS idx, {_ESS} AS ess, avg(evidence_confidence) AS sure,
 coalesce(avg(evidence_confidence) FILTER (WHERE eligible), 0) AS sure_eligible, count(*) FILTER (WHERE impact_confidence > 0) AS known, count(views) AS complete, count(DISTINCT platform) AS sources, count(*) FILTER (WHERE authenticity < 0.6) AS low,
 count(DISTINCT day) AS days, min(day) AS lo, max(day) AS hi FROM q),
u AS (SELECT *, least(1, sources / 5.0) AS coverage FROM t),
v_ AS (SELECT *, least(100, greatest(0, 100 * (0.28 * (2 + complete / n) / 3 + 0.24 * sure + 0.28 * least(1, trusted / 5000.0) + 0.2 * coverage) - 12 * excluded / n)) AS quality FROM u),
v AS (SELECT *, CASE WHEN eligible = 0 THEN 0 ELSE 100 * (0.35 * least(1, sqrt(ess / 100)) + 0.3 * quality / 100 + 0.2 * coverage + 0.15 * sure_eligible) END AS score FROM v_),
i AS ({" UNION ALL ".join(f"SELECT '{i}' AS indicator_id, '{role}' AS role, {_VALUES[i]} AS value" for i, role in I.INDICATORS)})
SELECT indicator_id, role, value IS NOT NULL AS available, value FROM i"""


@query(_INVENTORY)
def indicator_inventory(spark, sf):
    """The 25 indicators, each once."""
    o = F.col("ord")
    w = X.weighted(spark, sf).withColumn("market_score", F.when(o % 3 != 0, (o % 50).cast("double") / 50)).withColumn("decision", F.when(o % 5 == 0, "excluded").when(o % 9 == 0, "review").otherwise("trusted"))
    return I.inventory(w, SENTIMENTS, EMOTIONS, STANCES, GROUPS)


@query(f"{EV} SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS posted, platform, author, content_class, CAST(coalesce(views, 0) AS BIGINT) AS views, CAST(coalesce(likes, 0) AS BIGINT) AS likes, sentiment_label, narrative FROM evidence")
def flatten_records(spark, sf):
    n = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("long").alias(c)
    return X.evidence(spark, sf).select("id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("posted"), "platform", "author", "content_class", n("views"), n("likes"), "sentiment_label", "narrative")


@query(f"""{EW} SELECT platform, count(*) AS records, round(100.0 * count(*) FILTER (WHERE sentiment_label = 'negative') / count(*), 2) AS negative_pct, '{{"platform":"' || platform || '","records":' || CAST(count(*) AS VARCHAR) || '}}' AS payload FROM weighted GROUP BY 1""")
def dashboard_payload(spark, sf):
    g = X.weighted(spark, sf).groupBy("platform").agg(F.count(F.lit(1)).alias("records"), A.r(100 * F.count_if(F.col("sentiment_label") == "negative") / F.count(F.lit(1)), 2).alias("negative_pct"))
    return g.withColumn("payload", F.to_json(F.struct("platform", "records")))


@query(f"""{RUNS}, l AS (SELECT *, lag("index") OVER w AS before, lag(month) OVER w AS month_before, lag(ess) OVER w AS ess_before, row_number() OVER (PARTITION BY series ORDER BY month DESC) AS k FROM runs WINDOW w AS (PARTITION BY series ORDER BY month))
SELECT series, month_before AS from_month, month AS to_month, round("index" - before, 2) AS delta, least(ess, ess_before) < 30 AS thin, CASE WHEN abs(round("index" - before, 2)) < 3 OR least(ess, ess_before) < 30 THEN 'stable' WHEN "index" > before THEN 'improved' ELSE 'declined' END AS direction FROM l WHERE k = 1 AND before IS NOT NULL""")
def series_change(spark, sf):
    w = Window.partitionBy("series").orderBy("month")
    x = X.runs(spark, sf)
    s = x.withColumns({"before": F.lag("index").over(w), "month_before": F.lag("month").over(w), "ess_before": F.lag("ess").over(w), "k": F.row_number().over(Window.partitionBy("series").orderBy(F.col("month").desc()))}).where("k = 1 AND before IS NOT NULL")
    d, thin = F.round(F.col("index") - F.col("before"), 2), F.least("ess", "ess_before") < 30
    return s.select("series", F.col("month_before").alias("from_month"), F.col("month").alias("to_month"), d.alias("delta"), thin.alias("thin"), F.when((F.abs(d) < 3) | thin, "stable").when(d > 0, "improved").otherwise("declined").alias("direction"))


@query(f"""{RUNS} SELECT series, count(*) AS n_points, min(month) AS first_month, max(month) AS last_month, string_agg(month, ',' ORDER BY month) AS months FROM runs GROUP BY 1""")
def series_build(spark, sf):
    months = F.array_sort(F.collect_list("month"))
    return X.runs(spark, sf).groupBy("series").agg(F.count(F.lit(1)).alias("n_points"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.array_join(months, ",").alias("months"))


_TWO = f"""{RUNS}, a AS (SELECT * FROM runs WHERE series = '1-URGENT'), b AS (SELECT * FROM runs WHERE series = '5-LOW'), x AS (SELECT avg("index") AS i, sum(n) AS n, min(month) AS lo, max(month) AS hi FROM a), y AS (SELECT avg("index") AS i, sum(n) AS n, min(month) AS lo, max(month) AS hi FROM b)"""


@query(f"{_TWO} SELECT round(x.i, 4) AS index_a, round(y.i, 4) AS index_b, round(y.i - x.i, 4) AS delta, CAST(x.n AS BIGINT) AS n_a, CAST(y.n AS BIGINT) AS n_b, greatest(x.lo, y.lo) <= least(x.hi, y.hi) AS overlapping FROM x CROSS JOIN y")
def compare_runs(spark, sf):
    r = X.runs(spark, sf)
    side = lambda s, t: r.where(F.col("series") == s).agg(F.avg("index").alias(f"i_{t}"), F.sum("n").alias(f"n_{t}"), F.min("month").alias(f"lo_{t}"), F.max("month").alias(f"hi_{t}"))
    two = side("1-URGENT", "a").crossJoin(F.broadcast(side("5-LOW", "b")))  # one row each
    return two.select(A.r(F.col("i_a")).alias("index_a"), A.r(F.col("i_b")).alias("index_b"), A.r(F.col("i_b") - F.col("i_a")).alias("delta"), "n_a", "n_b", (F.greatest("lo_a", "lo_b") <= F.least("hi_a", "hi_b")).alias("overlapping"))


@query(f"""{EV}, w AS (SELECT platform, min(CAST(day AS DATE)) AS lo, max(CAST(day AS DATE)) AS hi FROM evidence WHERE ord % 3 = 0 OR platform <> 'click' GROUP BY 1)
SELECT a.platform AS a, b.platform AS b, greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) AS days FROM w a JOIN w b ON a.platform < b.platform""")
def window_overlap(spark, sf):
    w = X.evidence(spark, sf).where("ord % 3 = 0 OR platform <> 'click'").groupBy("platform").agg(F.min(F.to_date("day")).alias("lo"), F.max(F.to_date("day")).alias("hi"))
    a, b = w.alias("a"), F.broadcast(w).alias("b")
    days = F.greatest(F.lit(0), F.datediff(F.least("a.hi", "b.hi"), F.greatest("a.lo", "b.lo")) + 1)
    return a.join(b, F.col("a.platform") < F.col("b.platform")).select(F.col("a.platform").alias("a"), F.col("b.platform").alias("b"), days.cast("long").alias("days"))


def _top3(side: str) -> str:
    return f"(SELECT list_sort(list(name)) FROM (SELECT narrative AS name FROM weighted WHERE eligible AND {side} GROUP BY 1 ORDER BY round(sum(reputation_weight * sentiment_score), 6), narrative LIMIT 3))"


@query(f"""{EW}, t AS (SELECT {_top3("day <= '2024-01-15'")} AS a, {_top3("day > '2024-01-15'")} AS b)
SELECT array_to_string(list_sort(list_intersect(a, b)), ',') AS shared, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS only_first, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ',') AS only_second FROM t""")
def narrative_sets(spark, sf):
    w = X.weighted(spark, sf).where("eligible").withColumn("late", F.col("day") > "2024-01-15")
    g = w.groupBy("late", "narrative").agg(F.round(F.sum(A.W * A.S), 6).alias("x"))
    top = A.top_by(g, ["late"], [F.col("x"), F.col("narrative")], 3).groupBy().agg(F.sort_array(F.collect_list(F.when(~F.col("late"), F.col("narrative")))).alias("a"), F.sort_array(F.collect_list(F.when(F.col("late"), F.col("narrative")))).alias("b"))
    j = lambda c: F.array_join(F.sort_array(c), ",")
    return top.select(j(F.array_intersect("a", "b")).alias("shared"), j(F.array_except("a", "b")).alias("only_first"), j(F.array_except("b", "a")).alias("only_second"))
