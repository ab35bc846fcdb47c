"""The fixed inventory of indicators: a row for each, whether or not the data have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemark.functions import scores
from lodemark.operators import aggregate as A
from lodemark.session import cut, discard

#: Ids and roles of the indicators.
INDICATORS = (
    ("sample_volume", "quality"),
    ("market_relevance", "quality"),
    ("brand_reputation", "core"),
    ("evidence_confidence", "quality"),
    ("sentiment", "core"),
    ("emotions", "core"),
    ("stance", "core"),
    ("impact_attention", "core"),
    ("effective_independent_voices", "quality"),
    ("origin_breakdown", "core"),
    ("source_breakdown", "core"),
    ("positive_narrative_drivers", "core"),
    ("negative_narrative_drivers", "core"),
    ("topic_drivers", "core"),
    ("media_influence", "core"),
    ("people_influence", "core"),
    ("time_trends", "core"),
    ("numeric_anomalies", "core"),
    ("data_quality", "quality"),
    ("source_coverage", "quality"),
    ("sample_achievement", "quality"),
    ("authenticity_risk", "quality"),
    ("coordination", "quality"),
    ("story_syndication", "context"),
    ("top_mentions", "core"),
)


#: What the inventory reads of the records.
COLUMNS = (
    "id", "platform", "author", "day", "narrative", "topic", "content_class", "origin_group", "decision", "market_score",
    "sentiment_score", "sentiment_label", "primary_emotion", "target_stance", "opinion_eligible", "eligible", "views",
    "reputation_weight", "opinion_weight", "independent_voice_weight", "authenticity", "evidence_confidence",
    "impact_score", "impact_confidence",
)


def _num(x: Column, digits: int = 4) -> Column:
    return A.r(x, digits).cast(f"decimal(18,{digits})")


def _list(found: Column) -> Column:
    """JSON of the values of structs (k, v) in the order of k; null without any."""
    values = F.transform(F.array_sort(F.array_compact(found)), lambda e: e["v"])
    return F.when(F.size(values) > 0, F.to_json(values))


def _top(df: DataFrame, name: str, order: list[Column], limit: int, *fields: Column) -> DataFrame:
    """One row: the first ``limit`` rows as a JSON list."""
    k = F.row_number().over(Window.partitionBy().orderBy(*order))  # after the limit
    rows = df.orderBy(*order).limit(limit).select(k.alias("k"), F.struct(*fields).alias("v"))
    return rows.agg(_list(F.collect_list(F.struct("k", "v"))).alias(name))


def _tops(df: DataFrame, side: Column, names: tuple[str, ...], order: list[Column], limit: int, *fields: Column) -> DataFrame:
    """One row: a list as in ``_top`` for each of ``names``, of the rows whose ``side`` is that name."""
    rows = A.top_by(df.withColumn("_side", side).where(F.col("_side").isin(*names)), ["_side"], order, limit, "k").select("_side", "k", F.struct(*fields).alias("v"))
    return rows.agg(*[_list(F.collect_list(F.when(F.col("_side") == n, F.struct("k", "v")))).alias(n) for n in names])


def inventory(
    records: DataFrame,
    sentiments: tuple[str, ...],
    emotions: tuple[str, ...],
    stances: tuple[str, ...],
    groups: tuple[str, ...],
    target: int = 5000,
    wanted_sources: int = 5,
    limit: int = 10,
) -> DataFrame:
    """indicator_id, role, available and value (JSON, null where not available): every id of INDICATORS once.

    ``records`` are weighted evidence with ``market_score`` and ``decision``. Without records nothing is
    available; a null name is left out of its JSON object. Lists hold the ``limit`` first entries, sources
    and anomalies 50. Every aggregate yields one row, so what is joined and returned does not grow. The
    columns in use are written once, so that the weights are computed once and not for every aggregate; the
    result is written as well, so that this table can go.
    """
    kept = cut(records.select(*COLUMNS))
    out = cut(_inventory(kept, sentiments, emotions, stances, groups, target, wanted_sources, limit))
    discard(kept)
    return out


def _inventory(records: DataFrame, sentiments, emotions, stances, groups, target: int, wanted_sources: int, limit: int) -> DataFrame:
    every, e, n = F.lit(True), A.eligible_record(), F.count(F.lit(1))
    counts = lambda field, labels, only: F.struct(F.count_if(only & F.col(field).isin(*labels)).alias("records"), *[F.count_if(only & (F.col(field) == x)).alias(x) for x in labels])
    t = records.agg(
        n.alias("n"),
        F.count_if(e).alias("eligible"),
        F.count_if("opinion_eligible").alias("organic"),
        F.count_if(F.col("decision") == "trusted").alias("trusted"),
        F.count_if(F.col("decision") == "excluded").alias("excluded"),
        F.sum("independent_voice_weight").alias("voices"),
        F.count("market_score").alias("scored"),
        F.count_if(F.col("market_score") >= 0.65).alias("high"),
        F.avg("market_score").alias("market"),
        A.index_of(A.weighted_mean(A.score(), A.rep_weight())).alias("index"),
        A.effective_sample_size(A.rep_weight()).alias("ess"),
        F.avg("evidence_confidence").alias("sure"),
        F.coalesce(F.avg(F.when(e, F.col("evidence_confidence"))), F.lit(0.0)).alias("sure_eligible"),
        counts("sentiment_label", sentiments, e).alias("sentiment"),
        counts("primary_emotion", emotions, F.col("opinion_eligible")).alias("emotions"),
        counts("target_stance", stances, every).alias("stance"),
        counts("origin_group", groups, every).alias("origin"),
        F.count_if(F.col("impact_confidence") > 0).alias("known"),
        F.count("views").alias("complete"),
        F.count_distinct("platform").alias("sources"),
        F.count_if(F.col("authenticity") < 0.6).alias("low"),
    )
    one = t
    drivers = A.contributions(records, "narrative")
    side = F.when(F.col("points") > 0, "positive").when(F.col("points") < 0, "negative")
    largest, points = [F.abs("points").desc(), F.col("name")], _num(F.col("points")).alias("points")
    authors = records.groupBy("origin_group", "author").agg(A.r(F.sum("impact_score"), 6).alias("attention"))
    days = A.robust_scores(A.daily_series(records, emotions), ["records", "negative_share", *[f"{x}_share" for x in emotions]])
    flagged = days.withColumn("flags", F.concat_ws(",", A.anomaly_flags(days, emotions))).where("flags <> ''")
    copied = lambda key, cls, least, people: records.where(F.col("content_class") == cls).groupBy(F.col(key).alias("name")).agg(n.alias("records"), F.count_distinct("author").alias("authors")).where((F.col("records") >= least) & (F.col("authors") >= people))
    busiest = [F.col("records").desc(), F.col("name")]
    parts = (
        _top(records.groupBy(F.col("platform").alias("name")).agg(n.alias("records")), "platforms", busiest, 50, "name", "records"),
        _tops(drivers, side, ("positive", "negative"), largest, limit, "name", points),
        _top(A.contributions(records, "topic"), "topics", largest, limit, "name", points),
        _tops(authors, F.col("origin_group"), ("media", "person"), [F.col("attention").desc(), F.col("author")], limit, F.col("author").alias("name"), _num(F.col("attention")).alias("attention")),
        records.agg(F.count_distinct("day").alias("days"), F.min("day").alias("first"), F.max("day").alias("last")),
        _top(flagged, "anomalies", [F.col("day")], 50, "day", "flags"),
        _top(copied("narrative", "organic", 3, 2), "clusters", busiest, limit, "name", "records", "authors"),
        _top(copied("topic", "news", 2, 1), "stories", busiest, limit, "name", "records", "authors"),
        _top(records, "mentions", [F.col("impact_score").desc(), F.abs("sentiment_score").desc(), F.col("evidence_confidence").desc(), F.col("id")], 15, "id", "platform"),
    )
    for p in parts:
        one = one.crossJoin(F.broadcast(p))  # one row each
    c, some = F.col, F.col("n") > 0
    share = lambda a, b: c(a) / F.nullif(c(b).cast("double"), F.lit(0.0))
    coverage, reached = F.least(F.lit(1.0), c("sources") / float(wanted_sources)), c("trusted") / float(target)
    quality = 100 * (0.28 * (2 + share("complete", "n")) / 3 + 0.24 * c("sure") + 0.28 * F.least(F.lit(1.0), reached) + 0.2 * coverage) - 12 * share("excluded", "n")
    quality = scores.clamp(quality, 0.0, 100.0)
    sure = F.when(c("eligible") == 0, 0.0).otherwise(100 * (0.35 * F.least(F.lit(1.0), F.sqrt(c("ess") / 100)) + 0.3 * quality / 100 + 0.2 * coverage + 0.15 * c("sure_eligible")))
    label = lambda x, high, medium: F.when(x >= high, "high").when(x >= medium, "medium").otherwise("low").alias("label")
    word = F.when(c("index") < 45, "negative").when(c("index") > 55, "positive").otherwise("neutral_band").alias("interpretation")
    js = lambda when, *fields: F.when(when, F.to_json(F.struct(*fields)))
    whole = lambda s: F.when(c(s)["records"] > 0, F.to_json(s))
    value = {
        "sample_volume": js(some, c("n").alias("records"), "eligible", "organic", "trusted", _num(c("voices")).alias("voices")),
        "market_relevance": js(c("scored") > 0, c("scored").alias("records"), "high", _num(share("high", "scored")).alias("share"), _num(c("market")).alias("average")),
        "brand_reputation": js(c("index").isNotNull(), _num(c("index"), 2).alias("index"), word),
        "evidence_confidence": js(some, _num(sure, 2).alias("score"), label(sure, 75, 50)),
        "sentiment": whole("sentiment"),
        "emotions": whole("emotions"),
        "stance": whole("stance"),
        "impact_attention": js(some, "known", c("n").alias("records"), _num(share("known", "n")).alias("share")),
        "effective_independent_voices": js(some, _num(c("voices")).alias("voices")),
        "origin_breakdown": whole("origin"),
        "source_breakdown": c("platforms"),
        "positive_narrative_drivers": c("positive"),
        "negative_narrative_drivers": c("negative"),
        "topic_drivers": c("topics"),
        "media_influence": c("media"),
        "people_influence": c("person"),
        "time_trends": js(c("days") >= 2, "days", "first", "last"),
        "numeric_anomalies": c("anomalies"),
        "data_quality": js(some, _num(quality, 2).alias("score"), label(quality, 80, 60)),
        "source_coverage": js(some, _num(coverage).alias("ratio"), "sources"),
        "sample_achievement": js(some, _num(reached).alias("ratio"), "trusted"),
        "authenticity_risk": js(some, "low", _num(share("low", "n")).alias("share")),
        "coordination": c("clusters"),
        "story_syndication": c("stories"),
        "top_mentions": c("mentions"),
    }
    rows = [F.struct(F.lit(i).alias("indicator_id"), F.lit(role).alias("role"), value[i].isNotNull().alias("available"), value[i].alias("value")) for i, role in INDICATORS]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
