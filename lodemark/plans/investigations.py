"""All kinds of investigation from the registered figures, with their evidence and the contract with their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.operators import investigate as I
from lodemark.plans import evidence as _evidence  # noqa: F401  registers the figures
from lodemark.plans.registry import ORACLE, QUERIES, query
from lodemark.session import cut
from lodemark.sources import fixtures as X

DIMENSIONS = ["day", "narrative", "platform", "origin_group", "primary_emotion"]


def triggers(spark, sf) -> DataFrame:
    """Triggers of eleven kinds; the evidence is weighed once for all of them."""
    with X.weighted_once(spark, sf):
        return _triggers(spark, sf)


def _triggers(spark, sf) -> DataFrame:
    q = lambda name: QUERIES[name](spark, sf)
    c, least = F.col, lambda x, y: F.least(F.lit(x), y)
    size = F.greatest(F.abs("volume_z"), F.abs("negative_z"))
    material = F.greatest(F.abs("reputation_points"), F.abs("negative_points"), F.abs("anger_points"))
    drivers = cut(q("driver_contributions"))
    worst, best = drivers.orderBy("points", "name").limit(1), drivers.orderBy(F.col("points").desc(), "name").limit(1)
    clusters = q("coordination_clusters").orderBy(F.col("records").desc(), "narrative").limit(1)
    one = F.lit(True)
    return I.union([
        I.trigger("numeric_anomaly", "day", q("anomaly_flags"), c("flags") != "", c("day"), 45 + least(45.0, size * 5), F.lit(0.0)),
        I.trigger("reputation_daily_change", "day", q("daily_change_lag"), c("triggered"), c("day"), least(100.0, 55 + F.abs("delta") * 2.5), F.lit(0.0)),
        I.trigger("period_shift", "all", q("period_split"), one, None, 45 + least(35.0, material * 2.5), F.lit(0.0)),
        I.trigger("negative_narrative_driver", "narrative", worst, c("points") <= -1, c("name"), least(95.0, 35 + F.abs("points") * 8), least(1.0, F.abs("points") / 10)),
        I.trigger("positive_narrative_driver", "narrative", best, c("points") >= 1, c("name"), least(95.0, 35 + F.abs("points") * 8), least(1.0, F.abs("points") / 10)),
        I.trigger("emotion_profile", "primary_emotion", q("emotion_profile"), c("leader").isNotNull(), c("leader"), least(85.0, 35 + 100 * c("leader_share")), c("leader_share")),
        I.trigger("emerging_narrative", "narrative", q("emerging_narrative"), c("delta") > 0, c("name"), least(90.0, 45 + c("delta") * 180), least(1.0, c("delta") * 3)),
        I.trigger("source_divergence", "platform", q("source_divergence"), c("gap") > 0, c("high"), least(90.0, 30 + c("gap") * 1.5), least(1.0, c("gap") / 50)),
        I.trigger("media_people_divergence", "origin_group", q("origin_divergence"), c("gap").isNotNull(), F.lit("media"), least(85.0, 35 + F.abs("gap") * 1.5), least(1.0, F.abs("gap") / 40)),
        I.trigger("coordination_signal", "narrative", clusters, one, c("narrative"), least(95.0, 45 + 2.0 * c("records") + 2.0 * c("authors")), F.lit(1.0)),
        I.trigger("data_quality_guardrail", "all", q("quality_report"), one, None, least(95.0, 45 + 0.5 * (100 - c("score"))), F.lit(0.0)),
    ])


def _sub(name: str) -> str:
    return f"({ORACLE[name]})"


_SQL = f"""WITH tr AS (
SELECT 'numeric_anomaly' AS type, 'day' AS dimension, day AS value, 45 + least(45, greatest(abs(volume_z), abs(negative_z)) * 5) AS priority, 0.0 AS strength FROM {_sub('anomaly_flags')} WHERE flags <> ''
UNION ALL SELECT 'reputation_daily_change', 'day', day, least(100, 55 + abs(delta) * 2.5), 0 FROM {_sub('daily_change_lag')} WHERE triggered
UNION ALL SELECT 'period_shift', 'all', '', 45 + least(35, greatest(abs(reputation_points), abs(negative_points), abs(anger_points)) * 2.5), 0 FROM {_sub('period_split')}
UNION ALL SELECT 'negative_narrative_driver', 'narrative', name, least(95, 35 + abs(points) * 8), least(1, abs(points) / 10) FROM (SELECT * FROM {_sub('driver_contributions')} ORDER BY points, name LIMIT 1) WHERE points <= -1
UNION ALL SELECT 'positive_narrative_driver', 'narrative', name, least(95, 35 + abs(points) * 8), least(1, abs(points) / 10) FROM (SELECT * FROM {_sub('driver_contributions')} ORDER BY points DESC, name LIMIT 1) WHERE points >= 1
UNION ALL SELECT 'emotion_profile', 'primary_emotion', leader, least(85, 35 + 100 * leader_share), leader_share FROM {_sub('emotion_profile')} WHERE leader IS NOT NULL
UNION ALL SELECT 'emerging_narrative', 'narrative', name, least(90, 45 + delta * 180), least(1, delta * 3) FROM {_sub('emerging_narrative')} WHERE delta > 0
UNION ALL SELECT 'source_divergence', 'platform', high, least(90, 30 + gap * 1.5), least(1, gap / 50) FROM {_sub('source_divergence')} WHERE gap > 0
UNION ALL SELECT 'media_people_divergence', 'origin_group', 'media', least(85, 35 + abs(gap) * 1.5), least(1, abs(gap) / 40) FROM {_sub('origin_divergence')} WHERE gap IS NOT NULL
UNION ALL SELECT 'coordination_signal', 'narrative', narrative, least(95, 45 + 2.0 * records + 2.0 * authors), 1.0 FROM (SELECT * FROM {_sub('coordination_clusters')} ORDER BY records DESC, narrative LIMIT 1)
UNION ALL SELECT 'data_quality_guardrail', 'all', '', least(95, 45 + 0.5 * (100 - score)), 0 FROM {_sub('quality_report')}),
known AS (SELECT type, dimension, value, max(priority) AS priority, arg_max(strength, priority) AS strength FROM tr GROUP BY 1, 2, 3),
ev AS ({X.SQL["evidence"].replace("WITH ", "WITH ", 1)} SELECT * FROM evidence),
wide AS (SELECT id, platform, author, evidence_confidence AS ec, views IS NULL AS blind, unnest([{{'d': 'day', 'v': day}}, {{'d': 'narrative', 'v': narrative}}, {{'d': 'platform', 'v': platform}}, {{'d': 'origin_group', 'v': origin_group}}, {{'d': 'primary_emotion', 'v': primary_emotion}}, {{'d': 'all', 'v': ''}}]) AS x FROM ev),
loc AS (SELECT x.d AS dimension, x.v AS value, count(*) AS n, count(DISTINCT platform) AS sources, count(DISTINCT author) AS authors, avg(ec) AS evidence, avg(CASE WHEN blind THEN 1.0 ELSE 0.0 END) AS missing_impact, avg(CASE WHEN ec < 0.55 THEN 1.0 ELSE 0.0 END) AS low,
 list_transform(list_slice(list_sort(list({{'w': -round(ec, 6), 'i': id}})), 1, 5), lambda z: z.i) AS ids FROM wide GROUP BY 1, 2),
f AS (SELECT type, k.dimension, k.value, round(least(100, greatest(0, priority)) + 1e-9, 2) AS priority, strength, n, sources, authors, missing_impact, low, ids,
 round(100 * (0.25 * 0.8 + 0.20 * 0.7 + 0.20 * least(1, sqrt(n / 25.0)) + 0.15 * least(1, sources / 3.0) + 0.15 * evidence + 0.05 * least(1, greatest(0, strength))), 2) AS confidence FROM known k JOIN loc USING (dimension, value))
SELECT type, dimension, value, priority, CASE WHEN priority >= 70 THEN 'high' WHEN priority >= 40 THEN 'medium' ELSE 'low' END AS level, confidence, CASE WHEN confidence >= 75 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END AS label,
 CASE WHEN confidence >= 75 AND (sources >= 2 OR authors >= 5) THEN 'strong_association' WHEN confidence >= 50 AND sources >= 1 AND authors >= 2 THEN 'moderate_association' ELSE 'limited_evidence' END AS status,
 array_to_string(list_filter([CASE WHEN n < 5 THEN 'small_local_evidence_base' END, 'incomplete_source_coverage', CASE WHEN missing_impact >= 0.40 THEN 'impact_metrics_missing' END, CASE WHEN low >= 0.30 THEN 'semantic_confidence_mixed' END], lambda z: z IS NOT NULL), ',') AS caveats,
 array_to_string(ids, ',') AS evidence_ids, n, printf('INV-%03d', row_number() OVER (ORDER BY priority DESC, confidence DESC, type, dimension, value)) AS investigation_id, false AS stale, true AS stale_after FROM f"""


@query(_SQL)
def investigations(spark, sf):
    """Investigations of all kinds; their input has not changed, and would be found to have if one row were missing."""
    e = X.evidence(spark, sf).withColumn("impact_confidence", F.when(F.col("views").isNotNull(), 1.0).otherwise(0.0)).withColumn("weight", F.round("evidence_confidence", 6))
    items = cut(I.assemble(e, cut(triggers(spark, sf)), DIMENSIONS, 80.0, 70.0, 0.5, 1.0))  # read twice below
    columns = ["id", "day", "narrative", "sentiment_score", "evidence_confidence"]
    made = cut(I.input_hash(e, columns))  # compared twice
    out = I.with_lineage(items, made, I.input_hash(e, columns)).drop("input_digest")
    later = I.with_lineage(items.select("investigation_id"), made, I.input_hash(e.where("ord <> 7"), columns)).select("investigation_id", F.col("stale").alias("stale_after"))
    return out.join(later, "investigation_id").withColumns({"caveats": F.array_join("caveats", ","), "evidence_ids": F.array_join("evidence_ids", ",")}).drop("indicators", "candidate")
