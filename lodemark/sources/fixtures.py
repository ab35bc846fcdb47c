"""Derived views: evidence records, text corpus, threads and runs over the plain tables.

Each view is a lazy DataFrame; ``SQL`` holds the same definitions as common table expressions for
checks in another engine.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.functions import scores
from lodemark.session import cut, table

METRICS = ("views", "likes", "comments", "shares", "followers")
EMOTIONS = ("joy", "anger", "sadness", "fear", "disgust", "surprise", "neutral")


def _by(col: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (col + 1).cast("int"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence record for each event."""
    e, u = F.col("event_id"), F.col("user_id")
    raw = (e * 37) % 201 - 100
    label = F.when(F.abs(raw) <= 10, "neutral").when(raw > 0, "positive").otherwise("negative")
    m = lambda x: F.when(e % 13 != 0, x).cast("double")
    kind = e % 10
    content = F.when(kind == 0, "owned").when(kind == 1, "promotional").when(kind <= 3, "news").otherwise("organic")
    group = F.when(kind == 0, "brand_owned").when(kind == 1, "organization").when(kind <= 3, "media").otherwise("person")
    return table(spark, sf_dir, "events").select(
        e.alias("ord"),
        e.cast("string").alias("id"),
        F.col("event_type").alias("platform"),
        F.concat(F.lit("u"), u.cast("string")).alias("author"),
        "ts",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (raw.cast("double") / 100).alias("sentiment_score"),
        label.alias("sentiment_label"),
        F.when(e % 11 == 0, "not_applicable").when(label == "positive", "supportive").when(label == "negative", "critical").otherwise("neutral").alias("target_stance"),
        _by((e * 13) % 7, list(EMOTIONS)).alias("primary_emotion"),
        F.concat(F.lit("n"), (u % 9).cast("string")).alias("narrative"),
        F.concat(F.lit("t"), (e % 5).cast("string")).alias("topic"),
        content.alias("content_class"),
        F.when(group == "person", "person_or_creator").otherwise(group).alias("account_type"),
        group.alias("origin_group"),
        ((content == "organic") & (label != "neutral")).alias("opinion_eligible"),
        (F.lit(1.0) / (1 + e % 4)).alias("independent_voice_weight"),
        ((100 - e % 31).cast("double") / 100).alias("authenticity"),
        (F.lit(0.6) + (e % 40).cast("double") / 100).alias("evidence_confidence"),
        m(F.floor(F.col("value") * 10)).alias("views"),
        m(e % 97).alias("likes"),
        m(e % 23).alias("comments"),
        m(e % 11).alias("shares"),
        m((u * 17) % 5000).alias("followers"),
        "props",
    )


_once: ContextVar[tuple[str, DataFrame] | None] = ContextVar("weighted_once", default=None)


@contextmanager
def weighted_once(spark: SparkSession, sf_dir: str) -> Iterator[DataFrame]:
    """Inside, ``weighted`` of this folder (without props) is one table that was written once; queries built here need not derive it anew."""
    held = cut(weighted(spark, sf_dir).drop("props"))
    token = _once.set((sf_dir, held))
    try:
        yield held
    finally:
        _once.reset(token)


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with impact scores and record weights."""
    held = _once.get()
    if held and held[0] == sf_dir:
        return held[1]
    e = evidence(spark, sf_dir)
    return scores.with_weights(scores.with_impact(e, scores.metric_reference(e)))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as records: platform and author are the source."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("platform"), F.col("source").alias("author"), "lang", "text")


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as comments and replies."""
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        t,
        F.concat_ws(":", "conv_id", t).alias("id"),
        F.when(t > 0, F.concat_ws(":", "conv_id", t - 1)).alias("parent_id"),
        F.when(t == 0, "primary").when(t == 1, "comment").otherwise("reply").alias("layer"),
        "role",
        "text",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities by month as a series of runs with an index and an effective sample size."""
    o = table(spark, sf_dir, "orders")
    month = F.date_format("o_orderdate", "yyyy-MM")
    price = F.col("o_totalprice").cast("double")
    return o.groupBy(F.col("o_orderpriority").alias("series"), month.alias("month")).agg(
        F.round(F.avg(price) / 5000, 2).alias("index"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.pow(F.sum(price), 2) / F.sum(price * price), 2).alias("ess"),
    )


_EVIDENCE = """
evidence AS (
  SELECT event_id AS ord, CAST(event_id AS VARCHAR) AS id, event_type AS platform, 'u' || CAST(user_id AS VARCHAR) AS author,
    ts, strftime(ts, '%Y-%m-%d') AS day, CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 100 AS sentiment_score,
    CASE WHEN abs((event_id * 37) % 201 - 100) <= 10 THEN 'neutral' WHEN (event_id * 37) % 201 > 100 THEN 'positive' ELSE 'negative' END AS sentiment_label,
    CASE WHEN event_id % 11 = 0 THEN 'not_applicable' WHEN abs((event_id * 37) % 201 - 100) <= 10 THEN 'neutral'
         WHEN (event_id * 37) % 201 > 100 THEN 'supportive' ELSE 'critical' END AS target_stance,
    ['joy', 'anger', 'sadness', 'fear', 'disgust', 'surprise', 'neutral'][1 + (event_id * 13) % 7] AS primary_emotion,
    'n' || CAST(user_id % 9 AS VARCHAR) AS narrative, 't' || CAST(event_id % 5 AS VARCHAR) AS topic,
    CASE event_id % 10 WHEN 0 THEN 'owned' WHEN 1 THEN 'promotional' WHEN 2 THEN 'news' WHEN 3 THEN 'news' ELSE 'organic' END AS content_class,
    CASE event_id % 10 WHEN 0 THEN 'brand_owned' WHEN 1 THEN 'organization' WHEN 2 THEN 'media' WHEN 3 THEN 'media' ELSE 'person_or_creator' END AS account_type,
    CASE event_id % 10 WHEN 0 THEN 'brand_owned' WHEN 1 THEN 'organization' WHEN 2 THEN 'media' WHEN 3 THEN 'media' ELSE 'person' END AS origin_group,
    event_id % 10 > 3 AND abs((event_id * 37) % 201 - 100) > 10 AS opinion_eligible,
    CAST(1 AS DOUBLE) / (1 + event_id % 4) AS independent_voice_weight, CAST(100 - event_id % 31 AS DOUBLE) / 100 AS authenticity,
    CAST(0.6 AS DOUBLE) + CAST(event_id % 40 AS DOUBLE) / 100 AS evidence_confidence,
    CASE WHEN event_id % 13 <> 0 THEN CAST(floor(value * 10) AS DOUBLE) END AS views, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 97 AS DOUBLE) END AS likes,
    CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 23 AS DOUBLE) END AS comments, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 11 AS DOUBLE) END AS shares,
    CASE WHEN event_id % 13 <> 0 THEN CAST((user_id * 17) % 5000 AS DOUBLE) END AS followers, props
  FROM events)"""

_REFS = ", ".join(f"quantile_cont({m}, 0.95) FILTER (WHERE {m} > 0) AS {m}_p, count(*) FILTER (WHERE {m} > 0) AS {m}_n" for m in METRICS)
_NORM = ", ".join(
    f"CASE WHEN {m} IS NULL THEN NULL WHEN {m} <= 0 THEN 0 WHEN coalesce({m}_r, 0) <= 0 THEN 1 ELSE least(1, ln(1 + {m}) / ln(1 + {m}_r)) END AS {m}_s"
    for m in METRICS
)
_REF_OF = ", ".join(f"CASE WHEN p.{m}_n < 5 THEN g.{m}_p ELSE p.{m}_p END AS {m}_r" for m in METRICS)

_WEIGHTED = f"""{_EVIDENCE},
p_ AS (SELECT platform, {_REFS} FROM evidence GROUP BY platform),
g_ AS (SELECT {_REFS} FROM evidence),
refs AS (SELECT p.platform, {_REF_OF} FROM p_ p CROSS JOIN g_ g),
n_ AS (SELECT e.*, {_NORM} FROM evidence e JOIN refs USING (platform)),
g2_ AS (SELECT *, CASE WHEN likes_s IS NULL AND comments_s IS NULL AND shares_s IS NULL THEN NULL ELSE
    (0.3 * coalesce(likes_s, 0) + 0.3 * coalesce(comments_s, 0) + 0.4 * coalesce(shares_s, 0))
    / (CASE WHEN likes_s IS NULL THEN 0 ELSE 0.3 END + CASE WHEN comments_s IS NULL THEN 0 ELSE 0.3 END + CASE WHEN shares_s IS NULL THEN 0 ELSE 0.4 END) END AS engagement_s FROM n_),
i_ AS (SELECT *, CAST(CASE WHEN views_s IS NULL THEN 0 ELSE 0.5 END + CASE WHEN engagement_s IS NULL THEN 0 ELSE 0.3 END + CASE WHEN followers_s IS NULL THEN 0 ELSE 0.2 END AS DOUBLE) AS cover FROM g2_),
j_ AS (SELECT *, round(CASE WHEN cover = 0 THEN 0.5 ELSE 0.5 + cover * ((0.5 * coalesce(views_s, 0) + 0.3 * coalesce(engagement_s, 0) + 0.2 * coalesce(followers_s, 0)) / cover - 0.5) END, 6) AS impact_score,
    round(cover, 6) AS impact_confidence,
    CASE WHEN content_class IN ('owned', 'promotional') THEN 'owned_or_promotional' WHEN target_stance = 'not_applicable' THEN 'no_target_stance' ELSE 'eligible' END AS reason FROM i_),
weighted AS (SELECT *, reason = 'eligible' AS eligible, round(0.4 + 0.6 * impact_score, 6) AS attention_multiplier,
    CASE WHEN reason = 'eligible' THEN round(independent_voice_weight * authenticity * evidence_confidence * (0.4 + 0.6 * impact_score), 8) ELSE 0 END AS reputation_weight,
    CASE WHEN reason = 'eligible' AND opinion_eligible THEN round(independent_voice_weight * authenticity * evidence_confidence * (0.4 + 0.6 * impact_score), 8) ELSE 0 END AS opinion_weight FROM j_)"""

_RUNS = """
runs AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS month, round(avg(CAST(o_totalprice AS DOUBLE)) / 5000, 2) AS "index",
  count(*) AS n, round(pow(sum(CAST(o_totalprice AS DOUBLE)), 2) / sum(CAST(o_totalprice AS DOUBLE) * CAST(o_totalprice AS DOUBLE)), 2) AS ess
  FROM orders GROUP BY 1, 2)"""

_THREADS = """
threads AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id,
  CASE WHEN turn > 0 THEN CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) END AS parent_id,
  CASE WHEN turn = 0 THEN 'primary' WHEN turn = 1 THEN 'comment' ELSE 'reply' END AS layer, role, text FROM conversations)"""

#: Common table expressions; a query continues with ``SELECT`` or with a comma and its own expressions.
SQL = {"evidence": "WITH" + _EVIDENCE, "weighted": "WITH" + _WEIGHTED, "runs": "WITH" + _RUNS, "threads": "WITH" + _THREADS}
