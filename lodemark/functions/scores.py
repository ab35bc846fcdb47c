"""Scores and weights as columns: impact, evidence weights, rule cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.operators.aggregate import r
from lodemark.operators.ranks import exact_quantile

METRICS = ("views", "likes", "comments", "shares", "followers")
MIN_PLATFORM_SAMPLE = 5


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_double(x: Column, default: float | None = 0.0) -> Column:
    """x as a finite double, else the default."""
    d = x.try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(ok, d).otherwise(F.lit(default).cast("double"))


def safe_count(x: Column) -> Column:
    """A count from anything: truncated, not negative, 0 where it is no finite number."""
    d = safe_double(x)
    return F.greatest(F.lit(0), F.least(d, F.lit(9.2e18)).cast("long"))


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def mean_of_present(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean over the parts that are not null; null if none is."""
    w = total([F.when(c.isNotNull(), F.lit(k)).otherwise(F.lit(0.0)) for c, k in parts])
    s = total([F.coalesce(c, F.lit(0.0)) * k for c, k in parts])
    return F.when(w > 0, s / w)


def metric_reference(records: DataFrame, metrics: tuple[str, ...] = METRICS, q: float = 0.95, exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """(platform, {metric}_r): the percentile of positive values by platform, that of all where fewer than five.

    Exact by rank selection over value ranges (``ranks.exact_quantile``), so no task holds the values of a
    platform; ``exact=False`` uses the sketch, whose state is bounded too, in one pass: platform and grand
    totals come from one ROLLUP. A platform without any value has null references where all have none.
    """
    if exact:
        refs = exact_quantile(records, "platform", list(metrics), q)
        refs = refs.unionByName(records.select("platform").distinct().withColumn("all_", F.lit(False)), allowMissingColumns=True)
        refs = refs.groupBy("platform", "all_").agg(*[F.max(f"{m}_{x}").alias(f"{m}_{x}") for m in metrics for x in ("p", "n")])
    else:
        aggs = []
        for m in metrics:
            v = F.when(F.col(m) > 0, F.col(m).cast("double"))
            aggs += [F.percentile_approx(v, q, accuracy).alias(f"{m}_p"), F.count(v).alias(f"{m}_n")]
        refs = records.rollup("platform").agg(*aggs, (F.grouping("platform") == 1).alias("all_"))
    whole = refs.where("all_").select(*[F.col(f"{m}_p").alias(f"{m}_g") for m in metrics])
    local = refs.where("NOT all_").join(F.broadcast(whole), F.lit(True), "left")  # one row, none for a table without values
    few = lambda m: F.coalesce(F.col(f"{m}_n"), F.lit(0)) < MIN_PLATFORM_SAMPLE
    return local.select("platform", *[F.when(few(m), F.col(f"{m}_g")).otherwise(F.col(f"{m}_p")).alias(f"{m}_r") for m in metrics])


def norm_metric(v: Column, ref: Column) -> Column:
    """log-scaled share of the reference in [0, 1]; null stays null, 0 stays 0, no reference gives 1."""
    return F.when(v.isNull(), None).when(v <= 0, F.lit(0.0)).when(F.coalesce(ref, F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(clamp(F.log1p(v) / F.log1p(ref)))


def with_impact(records: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds {metric}_s, engagement_s, impact_score and impact_confidence.

    Unknown is not zero: without any metric the impact is 0.5 at confidence 0, and sparse metrics are
    drawn towards 0.5.
    """
    df = records.join(F.broadcast(refs), "platform")  # one row a platform
    for m in METRICS:
        df = df.withColumn(f"{m}_s", norm_metric(F.col(m), F.col(f"{m}_r")))
    df = df.withColumn("engagement_s", mean_of_present([(F.col("likes_s"), 0.3), (F.col("comments_s"), 0.3), (F.col("shares_s"), 0.4)]))
    parts = [(F.col("views_s"), 0.5), (F.col("engagement_s"), 0.3), (F.col("followers_s"), 0.2)]
    cover = total([F.when(c.isNotNull(), F.lit(k)).otherwise(F.lit(0.0)) for c, k in parts])
    impact = F.coalesce(0.5 + cover * (mean_of_present(parts) - 0.5), F.lit(0.5))
    return df.withColumn("impact_score", r(clamp(impact), 6)).withColumn("impact_confidence", r(clamp(cover), 6)).drop(*[f"{m}_r" for m in METRICS])


def exclusion_reason(ready: Column, relevant: Column, content: Column, stance: Column, confidence: Column) -> Column:
    """First reason that keeps a record out of the index, else 'eligible'."""
    return (
        F.when(~ready, "not_analysis_ready")
        .when(~relevant, "not_semantically_relevant")
        .when(content.isin("owned", "promotional"), "owned_or_promotional")
        .when(stance == "not_applicable", "no_target_stance")
        .when(F.coalesce(confidence, F.lit(0.0)) <= 0, "no_sentiment_confidence")
        .otherwise("eligible")
    )


def with_weights(df: DataFrame) -> DataFrame:
    """Adds reason, eligible, attention_multiplier, reputation_weight and opinion_weight."""
    yes = F.lit(True)
    reason = exclusion_reason(yes, yes, F.col("content_class"), F.col("target_stance"), F.col("evidence_confidence"))
    weight = clamp(F.col("independent_voice_weight")) * clamp(F.col("authenticity")) * F.col("evidence_confidence") * (0.4 + 0.6 * F.col("impact_score"))
    df = df.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "eligible")
    df = df.withColumn("attention_multiplier", r(0.4 + 0.6 * F.col("impact_score"), 6))
    df = df.withColumn("reputation_weight", F.when(F.col("eligible"), r(weight, 8)).otherwise(F.lit(0.0)))
    return df.withColumn("opinion_weight", F.when(F.col("opinion_eligible"), F.col("reputation_weight")).otherwise(F.lit(0.0)))


def routing_impact(views: Column, likes: Column, comments: Column, shares: Column, followers: Column) -> Column:
    """Cheap impact for routing only: a weighted log1p sum over seven, at most one."""
    z = lambda c: F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))
    raw = 0.36 * z(views) + 0.25 * z(likes) + 0.16 * z(comments) + 0.18 * z(shares) + 0.05 * z(followers)
    return F.round(F.least(F.lit(1.0), raw / 7), 4)


def linear_impact(views: Column, likes: Column, comments: Column, shares: Column) -> Column:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return z(views) + 20 * z(likes) + 30 * z(comments) + 50 * z(shares)


def evidence_confidence(overall: Column, sentiment: Column, relevance: Column, cleaning: Column) -> Column:
    return clamp(0.45 * safe_double(overall) + 0.25 * safe_double(sentiment) + 0.15 * safe_double(relevance) + 0.15 * safe_double(cleaning))


def classification_confidence(relevance: Column, market: Column, account: Column, content: Column, bot: Column) -> Column:
    far = lambda x: F.greatest(x, 1 - x)
    return clamp(0.34 * far(relevance) + 0.22 * far(market) + 0.18 * account + 0.14 * content + 0.12 * far(bot), 0.05, 0.99)


def origin_class(account: Column, content: Column) -> Column:
    return (
        F.when((account == "brand_owned") | (content == "owned"), "owned")
        .when((account == "media") | content.isin("news", "announcement"), "earned_media")
        .when(account == "person_or_creator", "earned_person")
        .when(account == "organization", "earned_organization")
        .otherwise("unknown")
    )


#: Thresholds of the cleaning decision; fixed values.
RULES = {
    "relevance_exclude_below": 0.28,
    "relevance_review_below": 0.58,
    "market_review_below": 0.25,
    "market_exclude_below": 0.15,
    "spam_exclude_at": 0.82,
    "bot_suspicious_at": 0.45,
    "bot_likely_automated_at": 0.80,
    "coordination_window_hours": 6,
    "coordination_similarity": 0.82,
    "story_similarity": 0.72,
    "same_author_near_duplicate_similarity": 0.85,
}


def authenticity_status(bot: Column, n_reasons: Column) -> Column:
    return F.when((bot >= RULES["bot_likely_automated_at"]) & (n_reasons >= 2), "likely_automated").when(bot >= RULES["bot_suspicious_at"], "suspicious").otherwise("low_risk")


def clean_decision(relevance: Column, market: Column, spam: Column, bot: Column, n_bot_reasons: Column, flags: Column, content: Column, impact: Column) -> Column:
    """struct(decision, reasons): hard gates in order, else all soft reasons, else trusted."""
    has = lambda f: F.array_contains(flags, f)
    hard = (
        F.when(has("exact_duplicate") | has("near_duplicate_same_author") | has("syndicated_duplicate_content"), "duplicate_not_independent_evidence")
        .when(has("explicit_exclusion_context"), "explicit_exclusion_context")
        .when(spam >= RULES["spam_exclude_at"], "high_spam_risk")
        .when((bot >= RULES["bot_likely_automated_at"]) & (n_bot_reasons >= 2), "high_automation_or_manipulation_risk")
        .when(has("no_subject_signal") & ~has("contextual_parent_match"), "subject_not_mentioned")
        .when((market < RULES["market_exclude_below"]) & ~has("parent_market_context"), "outside_target_market")
    )
    soft = [
        F.when(relevance < RULES["relevance_exclude_below"], "lexical_relevance_low_semantic_review_required").when(relevance < RULES["relevance_review_below"], "relevance_uncertain"),
        F.when((content == "unknown") & (relevance < 0.68), "content_context_uncertain"),
        F.when((bot >= RULES["bot_suspicious_at"]) & (bot < RULES["bot_likely_automated_at"]), "authenticity_uncertain"),
        F.when(market < RULES["market_review_below"], "market_relevance_uncertain"),
        F.when((impact >= 10000) & (bot >= 0.35), "high_impact_suspicious_activity"),
        F.when(has("ambiguous_short_entity"), "entity_disambiguation_needed"),
        F.when(has("provenance_parent_context"), "parent_subject_inherited_from_search_provenance"),
    ]
    reasons = F.when(hard.isNotNull(), F.array(hard)).otherwise(F.array_compact(F.array(*soft)))
    decision = F.when(hard.isNotNull(), "excluded").when(F.size(reasons) > 0, "review").otherwise("trusted")
    return F.struct(decision.alias("decision"), reasons.alias("reasons"))


def analytic_role(decision: Column, content: Column, origin: Column, platform: Column, account: Column, coordinated: Column, status: Column, opinion: Column, stance: Column) -> Column:
    """The part a record plays in the report: an ordered cascade."""
    return (
        F.when(decision == "excluded", "irrelevant_quarantine")
        .when(decision == "review", "review")
        .when(content.isin("owned", "promotional"), "owned_promotional_visibility")
        .when(origin.isin("media", "earned_media") | (platform == "news"), "media_visibility")
        .when(account == "organization", "organization_evidence")
        .when(coordinated | status.isin("suspicious", "likely_automated"), "coordination_suspicious")
        .when(opinion, "organic_opinion_reputation")
        .when(stance != "not_applicable", "reputation_evidence")
        .otherwise("visibility_evidence")
    )


def neutral_band(score: Column, label: Column, band: float = 0.10) -> Column:
    """Scores within the band read as neutral whatever the label says."""
    return F.when(F.abs(score) <= band, "neutral").otherwise(label)


def conflict_flags(label: Column, score: Column, emotion: Column, second: Column, sarcasm: Column, sarcasm_confidence: Column) -> Column:
    clash = ((label == "positive") & (score < 0.05)) | ((label == "negative") & (score > -0.05)) | ((label == "neutral") & (F.abs(score) > 0.35))
    return F.array_compact(
        F.array(
            F.when(clash, "sentiment_label_score_conflict"),
            F.when((second == emotion) & (second != "none"), "duplicate_primary_secondary_emotion"),
            F.when(sarcasm & (sarcasm_confidence < 0.5), "weak_sarcasm_claim"),
        )
    )


#: Flags that send a record to the reasoning tier, and flags that send it to review; fixed values.
ESCALATING = ("sentiment_label_score_conflict", "deterministic_ai_relevance_conflict", "weak_sarcasm_claim", "stance_sentiment_contradiction", "mention_not_aboutness")
CRITICAL = (
    "sentiment_label_score_conflict",
    "deterministic_ai_relevance_conflict",
    "provider_partial_failure",
    "weak_sarcasm_claim",
    "ai_budget_guard",
    "reasoning_skipped_budget",
    "insufficient_text_for_ai",
)


def any_flag(flags: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(flags, F.array(*map(F.lit, names)))


def needs_reasoning(relevance: Column, confidence: Column, sarcasm: Column, impact: Column, flags: Column) -> Column:
    return (relevance == "uncertain") | (confidence < 0.76) | sarcasm | ((impact >= 0.78) & (confidence < 0.9)) | any_flag(flags, ESCALATING)


def material_disagreement(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two annotations (semantic_relevance, sentiment_label, sentiment_score, target_stance, primary_emotion, emotion_confidence) differ in what matters."""
    strong = ("supportive", "critical")
    return (
        (a["semantic_relevance"] != b["semantic_relevance"])
        | ((a["sentiment_label"] != b["sentiment_label"]) & (F.abs(a["sentiment_score"] - b["sentiment_score"]) >= 0.35))
        | ((a["target_stance"] != b["target_stance"]) & (a["target_stance"].isin(*strong) | b["target_stance"].isin(*strong)))
        | ((a["primary_emotion"] != b["primary_emotion"]) & (F.least(a["emotion_confidence"], b["emotion_confidence"]) >= 0.75))
    )


def semantic_decision(flags: Column, tier: Column, relevance: Column, relevance_confidence: Column, confidence: Column, impact: Column, sarcasm: Column, sarcasm_confidence: Column, adjudication: float = 0.82) -> Column:
    """struct(decision, reason): ordered cascade over an annotation."""
    has = lambda f: F.array_contains(flags, f)
    fragile = any_flag(flags, CRITICAL) | (has("model_disagreement") & ~((tier == "reasoning") & (confidence >= adjudication)))
    sure = (relevance_confidence >= 0.85) & (impact < 0.78)
    cases = [
        (fragile, "review", "conflicting_or_fragile_semantic_signal"),
        (has("mention_not_aboutness"), "review", "target_mentioned_but_not_the_subject"),
        (relevance == "uncertain", "review", "semantic_relevance_uncertain"),
        ((relevance == "irrelevant") & sure, "excluded", "high_confidence_semantic_irrelevance"),
        (relevance == "irrelevant", "review", "irrelevance_requires_review_due_to_confidence_or_impact"),
        (confidence < 0.62, "review", "low_semantic_confidence"),
        (sarcasm & (sarcasm_confidence < 0.8), "review", "sarcasm_requires_review"),
    ]
    out = F.when(F.lit(False), F.struct(F.lit("").alias("decision"), F.lit("").alias("reason")))
    for when, decision, reason in cases:
        out = out.when(when, F.struct(F.lit(decision).alias("decision"), F.lit(reason).alias("reason")))
    return out.otherwise(F.struct(F.lit("ready").alias("decision"), F.lit("semantic_analysis_ready").alias("reason")))


def robust_z(v: Column, med: Column, mad: Column) -> Column:
    """0.6745 (v - median) / MAD; where the MAD is nearly 0, ten times the relative gap."""
    return F.when(mad <= 1e-12, 10 * (v - med) / F.greatest(F.lit(1.0), F.abs(med))).otherwise(0.6745 * (v - med) / mad)


def triage_movement(d: Column, w: Column, whole: Column) -> Column:
    """Points by which the index would move if a record of weight w counted."""
    return d * 50 * w / (whole + w)


def parent_heat(comments: Column, likes: Column, relevance: Column, decision: Column, organic: Column, content: Column, origin: Column) -> Column:
    """How much conversation a post is likely to carry."""
    z = lambda c: F.log1p(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)))
    add = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    dull = content.isin("announcement", "promotional", "news", "owned", "repost")
    return z(comments) + 0.25 * z(likes) + 4 * relevance + add(decision == "trusted", 1.5) + add(organic, 1.0) + add(dull, -3.0) + add(origin.isin("earned_media", "owned_media"), -1.0)


def reply_seed_score(replies: Column, relevance: Column, market: Column) -> Column:
    return 2 * F.sqrt(replies) + relevance + 0.5 * market
