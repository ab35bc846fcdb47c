"""Queries on review state, local evidence, investigations and raw-row rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemark.operators import aggregate as A
from lodemark.operators import normalize as N
from lodemark.operators import review as R
from lodemark.plans import texts as P
from lodemark.plans.registry import query
from lodemark.sources import fixtures as X
from lodemark.streaming import gaps
from lodemark.sources.fixtures import table

EV = X.SQL["evidence"]


def _decisions(e):
    """Invented decisions: every tenth record is decided, every thirtieth decided again, every ninetieth cleared."""
    o = F.col("ord")
    first = e.where(o % 10 == 0).select("id", F.when(o % 20 == 0, "keep").otherwise("exclude").alias("action"), F.lit("a").alias("reviewer"), F.lit(1).alias("at"), o.alias("seq"))
    second = e.where(o % 30 == 0).select("id", F.when(o % 20 == 0, "exclude").otherwise("keep").alias("action"), F.lit("b").alias("reviewer"), F.lit(2).alias("at"), o.alias("seq"))
    third = e.where(o % 90 == 0).select("id", F.lit("clear").alias("action"), F.lit("a").alias("reviewer"), F.lit(3).alias("at"), o.alias("seq"))
    return first.union(second).union(third)


_STATE = """CASE WHEN ord % 90 = 0 THEN NULL WHEN ord % 30 = 0 THEN CASE WHEN ord % 20 = 0 THEN 'exclude' ELSE 'keep' END WHEN ord % 10 = 0 THEN CASE WHEN ord % 20 = 0 THEN 'keep' ELSE 'exclude' END END"""
_REVIEW = f"{EV}, st AS (SELECT *, {_STATE} AS verdict, CASE WHEN ord % 7 = 0 THEN 'review' WHEN ord % 7 = 1 THEN 'excluded' ELSE 'trusted' END AS decision FROM evidence)"


def _reviewed(spark, sf):
    e = X.evidence(spark, sf)
    o = F.col("ord")
    with_decision = e.withColumn("decision", F.when(o % 7 == 0, "review").when(o % 7 == 1, "excluded").otherwise("trusted"))
    return R.decided(with_decision, _decisions(e))


@query(f"{_REVIEW} SELECT id, verdict, CASE WHEN ord % 90 = 0 THEN NULL WHEN ord % 30 = 0 THEN 'b' WHEN ord % 10 = 0 THEN 'a' END AS reviewer, CASE WHEN ord % 90 = 0 THEN 0 WHEN ord % 30 = 0 THEN 2 WHEN ord % 10 = 0 THEN 1 ELSE 0 END AS n_reviews FROM st")
def review_state(spark, sf):
    """The latest decision of each record, and how many there were since the last clear."""
    return _reviewed(spark, sf).select("id", "verdict", "reviewer", "n_reviews")


@query(f"{_REVIEW} SELECT CASE verdict WHEN 'keep' THEN 'trusted' WHEN 'exclude' THEN 'excluded' ELSE decision END AS decision, count(*) AS n, count(verdict) AS reviewed FROM st GROUP BY 1")
def review_override(spark, sf):
    r = _reviewed(spark, sf)
    return r.groupBy(R.overridden(F.col("decision"), F.col("verdict")).alias("decision")).agg(F.count(F.lit(1)).alias("n"), F.count("verdict").alias("reviewed"))


@query(f"{_REVIEW} SELECT id, left(coalesce(props, ''), 12) AS text FROM st WHERE decision = 'review' AND verdict IS NULL ORDER BY ord LIMIT 50")
def review_queue_page(spark, sf):
    return R.queue(_reviewed(spark, sf).withColumn("text", F.col("props")), limit=50, chars=12).select("id", "text")


@query(f"""{EV}, s AS (SELECT *, CASE WHEN ord % 6 = 0 THEN 'neutral' END AS second, 0.7 + (ord % 5) * 0.05 AS sure FROM evidence) SELECT id, CASE WHEN second IS NOT NULL AND sure >= 0.82 THEN second ELSE sentiment_label END AS label FROM s""")
def second_pass(spark, sf):
    o = F.col("ord")
    e = X.evidence(spark, sf).withColumn("second", F.when(o % 6 == 0, "neutral")).withColumn("sure", F.lit(0.7) + (o % 5) * 0.05)
    return e.select("id", R.adjudicated(F.col("sentiment_label"), F.col("second"), F.col("sure")).alias("label"))


_LOCAL = f"""{EV}, l AS (SELECT narrative, day AS about, count(*) AS n, count(DISTINCT platform) AS sources, count(DISTINCT author) AS authors, avg(evidence_confidence) AS evidence, avg(CASE WHEN views IS NULL THEN 1.0 ELSE 0.0 END) AS missing_impact,
 avg(CASE WHEN evidence_confidence < 0.65 THEN 1.0 ELSE 0.0 END) AS low FROM evidence GROUP BY 1, 2),
lc AS (SELECT *, round(100 * (0.25 * 0.8 + 0.20 * 0.7 + 0.20 * least(1, sqrt(n / 25.0)) + 0.15 * least(1, sources / 3.0) + 0.15 * evidence + 0.05 * 0.4), 2) AS score FROM l)"""


def _local(spark, sf):
    e = X.evidence(spark, sf).withColumn("impact_confidence", F.when(F.col("views").isNotNull(), 1.0).otherwise(0.0))
    # low confidence counts from 0.65 in these data, so that the caveat occurs
    e = e.withColumn("about", F.col("day")).withColumn("plain", F.col("evidence_confidence"))
    l = R.local_evidence(e, ["narrative", "about"]).drop("low_semantic")  # noqa: E741
    low = e.groupBy("narrative", "about").agg(F.avg((F.col("plain") < 0.65).cast("double")).alias("low_semantic"))
    return l.join(low, ["narrative", "about"]).withColumn("score", R.local_confidence(F.lit(80.0), F.lit(70.0), F.lit(0.4)))


@query(f"""{_LOCAL} SELECT narrative, about, n, round(score, 2) AS score, CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS label,
 CASE WHEN score >= 75 AND (sources >= 2 OR authors >= 5) THEN 'strong_association' WHEN score >= 50 AND sources >= 1 AND authors >= 2 THEN 'moderate_association' ELSE 'limited_evidence' END AS status FROM lc""")
def local_confidence(spark, sf):
    return _local(spark, sf).select("narrative", "about", "n", "score", R.band(F.col("score"), 75, 50).alias("label"), R.evidence_status(F.col("score")).alias("status"))


@query(f"""{_LOCAL} SELECT narrative, about, array_to_string(list_filter([CASE WHEN n < 5 THEN 'small_local_evidence_base' END, 'incomplete_source_coverage', CASE WHEN missing_impact >= 0.40 THEN 'impact_metrics_missing' END, CASE WHEN low >= 0.30 THEN 'semantic_confidence_mixed' END], lambda x: x IS NOT NULL), ',') AS caveats FROM lc""")
def quality_caveats(spark, sf):
    return _local(spark, sf).select("narrative", "about", F.array_join(R.quality_caveats(F.lit(0.5), F.lit(1.0)), ",").alias("caveats"))


@query(f"""{_LOCAL}, k AS (SELECT *, CAST(substr(narrative, 2) AS BIGINT) AS ord, CASE WHEN n % 2 = 0 THEN 'shift' ELSE 'anomaly' END AS type FROM lc), f AS (SELECT about, type, arg_min(score, ord) AS score, min(ord) AS ord, arg_min(n, ord) AS n FROM k GROUP BY 1, 2)
SELECT about, type, score, printf('INV-%03d', row_number() OVER (ORDER BY n DESC, score DESC, type, about)) AS investigation_id FROM f""")
def investigation_order(spark, sf):
    """One investigation for each trigger and type, numbered by priority; equal ones by type and trigger."""
    l = _local(spark, sf).withColumn("type", F.when(F.col("n") % 2 == 0, "shift").otherwise("anomaly"))  # noqa: E741
    l = l.select("about", "type", F.col("n").alias("priority"), F.col("score").alias("confidence"), F.substring("narrative", 2, 9).cast("long").alias("ord"))  # noqa: E741
    out = R.numbered(l, ["about", "type"])
    return out.select("about", "type", F.col("confidence").alias("score"), "investigation_id")


_RAW = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN '{"id":"diag:' || event_id || '"}' WHEN 1 THEN '{"resultType":"Diagnostic"}' WHEN 2 THEN '{"status":"Zero-Output"}' WHEN 3 THEN '{"error":"no_items"}' WHEN 4 THEN '{"error":"x","text":"a post"}'
 WHEN 5 THEN '{"error":false}' WHEN 6 THEN 'not json' ELSE '{"text":"t' || event_id || '","status":"ok"}' END AS raw FROM events"""


def _raw(spark, sf):
    e = F.col("event_id")
    cases = [(0, F.concat(F.lit('{"id":"diag:'), e.cast("string"), F.lit('"}'))), (1, F.lit('{"resultType":"Diagnostic"}')), (2, F.lit('{"status":"Zero-Output"}')), (3, F.lit('{"error":"no_items"}')), (4, F.lit('{"error":"x","text":"a post"}')), (5, F.lit('{"error":false}')), (6, F.lit("not json"))]
    raw = F.concat(F.lit('{"text":"t'), e.cast("string"), F.lit('","status":"ok"}'))
    for k, x in cases:
        raw = F.when(e % 8 == k, x).otherwise(raw)
    return table(spark, sf, "events").select("event_id", raw.alias("raw"))


@query(f"SELECT event_id, event_id % 8 <= 3 AS diagnostic FROM ({_RAW})")
def diagnostic_rows(spark, sf):
    return _raw(spark, sf).select("event_id", R.is_diagnostic(F.col("raw")).alias("diagnostic"))


@query(f"SELECT CASE WHEN event_id % 8 <= 3 THEN 'diagnostic' ELSE 'data' END AS side, count(*) AS n FROM ({_RAW}) GROUP BY 1")
def diagnostic_split(spark, sf):
    side = F.when(R.is_diagnostic(F.col("raw")), "diagnostic").otherwise("data")
    return _raw(spark, sf).groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{P._DECIDED}, o AS (SELECT *, account_type = 'person_or_creator' AND content_class = 'organic' AND decision = 'trusted' AND bot_all < 0.45 AS organic FROM decided)
SELECT decision, content_class, count(*) AS n, CAST(sum(CASE WHEN organic THEN 1 ELSE 0 END) AS BIGINT) AS organic FROM o GROUP BY 1, 2""")
def organic_eligibility(spark, sf):
    c = P.cleaned(spark, sf)
    return c.groupBy("decision.decision", "content_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("organic_eligible").alias("organic"))


@query(f"{EV} SELECT id FROM evidence WHERE ord NOT IN (SELECT ord FROM evidence WHERE ord % 4 = 0)")
def exclude_used(spark, sf):
    """Candidates that no earlier pass has used."""
    e = X.evidence(spark, sf)
    return e.select("id").join(e.where("ord % 4 = 0").select("id"), "id", "left_anti")


@query(f"{EV} SELECT platform, count(*) AS added FROM evidence WHERE ord % 3 = 0 AND ord % 2 <> 0 GROUP BY 1")
def added_ids(spark, sf):
    """What a batch adds to a table: its ids that were not there."""
    e = X.evidence(spark, sf)
    return N.added(e.where("ord % 2 = 0"), e.where("ord % 3 = 0").select("id", "platform"), ["id"]).groupBy("platform").agg(F.count(F.lit(1)).alias("added"))


@query("""WITH r AS (SELECT page_id AS ord, regexp_extract(url, '^https?://([^/?#]*)', 1) AS actor, length(html) % 5 AS input, page_id % 9 = 0 AS probe FROM pages), d AS (SELECT actor, input, min(ord) AS ord, arg_min(probe, ord) AS probe FROM r GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY probe DESC, ord) AS rank FROM d) SELECT actor, input, ord, rank FROM k WHERE rank <= 3""")
def route_dedupe(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/?#]*)", 1).alias("actor"), (F.length("html") % 5).cast("long").alias("input"), F.col("page_id").alias("ord"), (F.col("page_id") % 9 == 0).alias("probe"))
    return R.best_routes(p, ["actor", "input"], "actor").select("actor", "input", "ord", "rank")


@query("""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT source, CASE WHEN source LIKE '%1' THEN NULL ELSE (length(source) * 7 + ascii(right(source, 1))) % 11 / 4.0 END AS price FROM n)
SELECT source, round(price, 4) AS price, row_number() OVER (ORDER BY price IS NULL DESC, price DESC, source) AS rank FROM p""")
def source_price_order(spark, sf):
    """Unknown prices first, then the dearest; one row a source."""
    from pyspark.sql import Window

    s = table(spark, sf, "documents").select("source").distinct()
    price = F.when(~F.endswith("source", F.lit("1")), (F.length("source") * 7 + F.ascii(F.right("source", F.lit(1)))) % 11 / 4.0)
    s = s.withColumn("price", price)
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("price").desc_nulls_first(), "source"))
    return s.select("source", A.r(F.col("price")).alias("price"), rank.alias("rank"))


@query("""WITH c AS (SELECT event_id, event_id % 7 AS got, event_id % 5 AS want, event_id % 11 <> 0 AS ran, event_id % 3 AS ok, event_id % 4 AS bad, CASE WHEN event_id % 4 > 1 THEN 1 ELSE 0 END AS blocked FROM events)
SELECT event_id, CASE WHEN NOT ran THEN 'deferred' WHEN got = 0 AND bad > 0 AND ok = 0 THEN 'failed' WHEN got = 0 OR got < want THEN 'shortfall' ELSE 'collected' END AS status,
 CASE WHEN NOT ran THEN 'worker_deadline_or_unfinished_pass' WHEN got = 0 AND bad > 0 AND ok = 0 THEN CASE WHEN blocked > 0 THEN 'comment_budget_blocked_before_successful_attempt' ELSE 'comment_actor_failed_before_successful_attempt' END
 WHEN got = 0 THEN 'no_comments_found_after_bounded_parent_discovery' WHEN got < want THEN 'source_exhausted_before_comment_target' END AS reason,
 CASE WHEN ran AND got > 0 AND got >= want THEN 0 ELSE greatest(want - got, 0) END AS shortfall FROM c""")
def comment_fulfillment(spark, sf):
    e = F.col("event_id")
    s = R.fulfillment(e % 7, e % 5, e % 11 != 0, e % 3, e % 4, F.when(e % 4 > 1, 1).otherwise(0))
    return table(spark, sf, "events").select("event_id", s.alias("s")).select("event_id", "s.status", "s.reason", "s.shortfall")


@query("""SELECT source, '(' || string_agg(CASE WHEN contains(v, ' ') THEN '"' || v || '"' ELSE v END, ' OR ' ORDER BY k) || ')' AS any_of, string_agg('-' || CASE WHEN contains(v, ' ') THEN '"' || v || '"' ELSE v END, ' ' ORDER BY k) AS none_of, any_value(source) || 'tag' AS tag
FROM (SELECT DISTINCT source, unnest([source, source || ' news', 'the ' || source]) AS v, unnest([1, 2, 3]) AS k FROM documents) GROUP BY source""")
def query_terms(spark, sf):
    """Search expressions of a source's terms."""
    s = table(spark, sf, "documents").select("source").distinct()
    terms = F.array(F.col("source"), F.concat("source", F.lit('  "news"')), F.concat(F.lit(" the "), "source"))
    return s.select("source", R.or_group(terms).alias("any_of"), R.negatives(terms).alias("none_of"), R.hashtag(F.concat(F.lit("_#"), "source", F.lit("-tag!_"))).alias("tag"))


@query("SELECT doc_id, substr(sha256('lang=' || lang || chr(31) || 'source=' || source), 1, 16) AS signature FROM documents")
def mapping_signature(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.signature("source", "lang").alias("signature"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN '1e400' WHEN 2 THEN '12.5' WHEN 3 THEN '-4' WHEN 4 THEN ' ' ELSE CAST(event_id AS VARCHAR) END AS v FROM events)
SELECT event_id, CASE WHEN event_id % 6 IN (2) THEN 12.5 WHEN event_id % 6 = 3 THEN -4.0 WHEN event_id % 6 = 5 THEN CAST(event_id AS DOUBLE) END AS d, CASE WHEN event_id % 6 = 5 AND event_id <= 500 THEN event_id END AS n, nullif(trim(v), '') AS s FROM v""")
def type_sanitize(spark, sf):
    """Values that fit their schema; what does not, or is not finite, becomes null."""
    e = F.col("event_id")
    v = F.when(e % 6 == 0, "NaN").when(e % 6 == 1, "1e400").when(e % 6 == 2, "12.5").when(e % 6 == 3, "-4").when(e % 6 == 4, " ").otherwise(e.cast("string"))
    return table(spark, sf, "events").select("event_id", R.fitting(v, "double").alias("d"), R.fitting(v, "bigint", 0, 500).alias("n"), R.fitting(v, "string").alias("s"))


@query(f"""{EV}, g AS (SELECT day AS author, ts, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY day ORDER BY ts) AS gap FROM evidence)
SELECT author, count(*) AS posts, count(*) FILTER (WHERE gap <= 180) AS rapid, count(*) >= 5 AND count(*) FILTER (WHERE gap <= 180) >= 4 AS burst FROM g GROUP BY 1""")
def gap_bursts(spark, sf):
    """Rapid gaps between events; a day stands in for an author, whose events lie too far apart in these data."""
    return gaps.batch_bursts(X.evidence(spark, sf).select(F.col("day").alias("author"), "ts"))
