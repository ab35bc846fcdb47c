"""Review state, local evidence and investigations: decisions with history, queues, confidence, caveats, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.functions import scores as S
from lodemark.operators import aggregate as A


def decided(records: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Adds verdict, reviewer, n_reviews and history to records from an append-only table (``key``, action,
    reviewer, at, seq): the latest decision wins, ``seq`` breaking ties of time; 'clear' takes all before it back.

    One aggregate over the decisions, whose size is that of what people decided, and one join. Records
    without a decision, or cleared, have null verdicts. Decisions on unknown records go.
    """
    event = F.struct("at", "seq", "action", "reviewer")
    g = decisions.groupBy(key).agg(F.array_sort(F.collect_list(event)).alias("history"), F.max(F.when(F.col("action") == "clear", F.struct("at", "seq"))).alias("_cut"))
    live = F.filter("history", lambda e: F.col("_cut").isNull() | (F.struct(e["at"], e["seq"]) > F.col("_cut")))
    g = g.withColumn("history", live)
    last = F.try_element_at("history", F.lit(-1))
    g = g.select(key, last["action"].alias("verdict"), last["reviewer"].alias("reviewer"), F.size("history").cast("long").alias("n_reviews"), "history")
    return records.join(g, key, "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0).cast("long")))


def overridden(decision: Column, verdict: Column) -> Column:
    """The decision after human review."""
    return F.when(verdict == "keep", "trusted").when(verdict == "exclude", "excluded").otherwise(decision)


def queue(records: DataFrame, limit: int = 200, chars: int = 1200) -> DataFrame:
    """The next page for a reviewer: undecided records in order, their texts cut for display. The limit is the feature."""
    text = F.left(F.coalesce("text", F.lit("")), F.lit(chars))
    return records.where("decision = 'review' AND verdict IS NULL AND id <> ''").orderBy("ord").limit(limit).withColumn("text", text)


def adjudicated(label: Column, second: Column, confidence: Column, least: float = 0.82) -> Column:
    """The label after a second pass: a second one counts at a confidence of ``least`` or more."""
    return F.when(second.isNotNull() & (confidence >= least), second).otherwise(label)


def local_evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and means of a group's records (platform, author, evidence_confidence, impact_confidence)."""
    c = F.coalesce("evidence_confidence", F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.coalesce("platform", F.lit("unknown"))).alias("sources"),
        F.count_distinct(F.coalesce("author", F.lit("unknown"))).alias("authors"),
        F.avg(c).alias("evidence"),
        F.avg((F.coalesce("impact_confidence", F.lit(0.0)) <= 0).cast("double")).alias("missing_impact"),
        F.avg((c < 0.55).cast("double")).alias("low_semantic"),
    )


def local_confidence(overall: Column, quality: Column, strength: Column) -> Column:
    """Confidence of a finding from 0 to 100 out of ``local_evidence``'s columns, the run's confidence and quality, and a driver's strength."""
    sample, spread = S.clamp(F.sqrt(F.col("n") / 25.0)), S.clamp(F.col("sources") / 3.0)
    score = 0.25 * S.clamp(overall / 100) + 0.20 * S.clamp(quality / 100) + 0.20 * sample + 0.15 * spread + 0.15 * F.col("evidence") + 0.05 * S.clamp(strength)
    return A.r(100 * score, 2)


def band(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def evidence_status(confidence: Column) -> Column:
    """How far a finding may be called an association."""
    return (
        F.when((confidence >= 75) & ((F.col("sources") >= 2) | (F.col("authors") >= 5)), "strong_association")
        .when((confidence >= 50) & (F.col("sources") >= 1) & (F.col("authors") >= 2), "moderate_association")
        .otherwise("limited_evidence")
    )


def quality_caveats(coverage: Column, achievement: Column) -> Column:
    """What a reader has to be told about a finding's data."""
    return F.array_compact(
        F.array(
            F.when(F.col("n") < 5, "small_local_evidence_base"),
            F.when(coverage < 0.75, "incomplete_source_coverage"),
            F.when(achievement < 0.75, "sample_shortfall"),
            F.when(F.col("missing_impact") >= 0.40, "impact_metrics_missing"),
            F.when(F.col("low_semantic") >= 0.30, "semantic_confidence_mixed"),
        )
    )


def numbered(items: DataFrame, keys: list[str], limit: int = 10_000) -> DataFrame:
    """Investigations with ids: one for each ``keys`` (the first by ``ord``), by priority, confidence, type and the other
    ``keys``, so that no two are equal.

    A report holds few of them; the number is checked, since the ids come from one ordered window.
    """
    rest = [c for c in items.columns if c not in keys]
    one = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*keys, "r.*")
    if one.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} investigations")
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy().orderBy(F.desc("priority"), F.desc("confidence"), "type", *[c for c in keys if c != "type"]))
    return one.withColumn("investigation_id", F.format_string("INV-%03d", k))


def fulfillment(collected: Column, target: Column, all_ran: Column, normal: Column, failed: Column, blocked: Column) -> Column:
    """struct(status, reason, shortfall) of a source's comment layer from what was collected and how its calls ended
    (``normal``: completed, ``failed``: of these in all, ``blocked``: for lack of budget)."""
    got, want = F.greatest(F.coalesce(collected, F.lit(0)), F.lit(0)), F.greatest(F.coalesce(target, F.lit(0)), F.lit(0))
    short = F.greatest(want - got, F.lit(0))
    s = lambda status, reason, n: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), n.cast("long").alias("shortfall"))
    nothing = (got <= 0) & (failed > 0) & (normal <= 0)
    return (
        F.when(~all_ran, s("deferred", "worker_deadline_or_unfinished_pass", short))
        .when(nothing & (blocked > 0), s("failed", "comment_budget_blocked_before_successful_attempt", short))
        .when(nothing, s("failed", "comment_actor_failed_before_successful_attempt", short))
        .when(got <= 0, s("shortfall", "no_comments_found_after_bounded_parent_discovery", short))
        .when(got < want, s("shortfall", "source_exhausted_before_comment_target", short))
        .otherwise(s("collected", None, F.lit(0)))
    )


def best_routes(routes: DataFrame, keys: list[str], group: str, top: int = 3) -> DataFrame:
    """The first of equal routes by ``ord``, then the probes and after them the rest, at most ``top`` of a group."""
    from pyspark.sql import Window

    rest = [c for c in routes.columns if c not in keys]
    one = routes.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*keys, "r.*")
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("probe"), "ord"))
    return one.withColumn("rank", k).where(F.col("rank") <= top)


#: Statuses of rows that report instead of holding data, and fields that hold content.
DIAGNOSTIC = ("no-input", "invalid-input", "replies-incomplete", "zero-output", "aborted", "unexpected-error")
CONTENT_FIELDS = ("text", "caption", "message", "title", "content", "description", "timestamp", "createdAt", "created_at", "date", "takenAt", "taken_at", "publishedAt", "published_at")


def is_diagnostic(raw: Column) -> Column:
    """Whether a raw row (JSON) reports on the call instead of holding data: by id, type or status, or an error without any content."""
    v = F.try_parse_json(raw)
    get = lambda k: F.trim(F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")))
    first = lambda *ks: F.coalesce(*[F.nullif(get(k), F.lit("")) for k in ks], F.lit(""))
    error = first("error", "errorDescription", "error_description")
    bare = (error != "") & (error != "false") & (first(*CONTENT_FIELDS) == "")
    kind = F.lower(first("resultType", "result_type", "type"))
    return F.startswith(get("id"), F.lit("diag:")) | (kind == "diagnostic") | F.lower(get("status")).isin(*DIAGNOSTIC) | bare


def phrase(x: Column) -> Column:
    """A search phrase: white space squeezed, quotes dropped, quoted if it has several words."""
    y = F.trim(F.regexp_replace(F.replace(F.trim(x), F.lit('"'), F.lit(" ")), r"\s+", " "))
    return F.when(F.contains(y, F.lit(" ")), F.concat(F.lit('"'), y, F.lit('"'))).otherwise(y)


def or_group(values: Column, most: int = 12) -> Column:
    """(a OR "b c" OR ...) of at most ``most`` values; empty without any."""
    ps = F.transform(F.slice(values, 1, most), phrase)
    return F.when(F.size(ps) > 0, F.concat(F.lit("("), F.array_join(ps, " OR "), F.lit(")"))).otherwise(F.lit(""))


def negatives(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda t: F.concat(F.lit("-"), phrase(t))), " ")


def hashtag(x: Column) -> Column:
    """Letters, digits and inner underscores of a term."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\p{L}\p{N}_]+", ""), "^_+|_+$", "")


def signature(*columns: str) -> Column:
    """Sixteen hexadecimal digits that name a mapping, whatever the order in which its fields come."""
    pairs = F.array_sort(F.array(*[F.concat_ws("=", F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]))
    return F.substring(F.sha2(F.array_join(pairs, "\x1f"), 256), 1, 16)


def fitting(x: Column, kind: str, low: float | None = None, high: float | None = None) -> Column:
    """A value as its schema wants it, or null: cast, finite and within bounds."""
    if kind in ("double", "bigint", "int"):
        d = S.safe_double(x, None)
        ok = d.isNotNull()
        ok = ok & (d >= low) if low is not None else ok
        ok = ok & (d <= high) if high is not None else ok
        ok = ok & (d == F.floor(d)) if kind != "double" else ok
        return F.when(ok, d).cast(kind)
    return F.nullif(F.trim(x.cast("string")), F.lit("")) if kind == "string" else x.try_cast(kind)
