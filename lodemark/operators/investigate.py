"""From triggers to investigations: local evidence, confidence, caveats, ids, and the contract with their input.

A trigger points at records by one dimension and its value: a day, a narrative, a platform. Records meet all
triggers in one join on (dimension, value), so their number does not matter; triggers are few and checked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemark.operators import aggregate as A
from lodemark.operators import review as R

#: The kinds of investigation and the indicators that each rests on.
TYPES = {
    "numeric_anomaly": ("anomalies", "daily_records"),
    "reputation_daily_change": ("daily_reputation",),
    "period_shift": ("period_change",),
    "negative_narrative_driver": ("negative_drivers",),
    "positive_narrative_driver": ("positive_drivers",),
    "emotion_profile": ("emotions",),
    "emerging_narrative": ("narrative_shares",),
    "source_divergence": ("source_index",),
    "media_people_divergence": ("origin_index",),
    "coordination_signal": ("coordination",),
    "data_quality_guardrail": ("data_quality",),
}
HIGH, MEDIUM = 70, 40
CANDIDATE = 40
FRAME = ("client", "topic", "market", "date_from", "date_to")


def input_hash(records: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest) of a set of rows, whatever their order: partial sums of hashes add up. Doubles count to six places."""
    kinds = dict(records.dtypes)
    text = [F.coalesce(F.format_number(c, 6) if kinds[c] == "double" else F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    one = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *text), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(one), F.lit(0)).cast("string").alias("digest"))


def check_frame(made: dict[str, str], asked: dict[str, str]) -> None:
    """An investigation has to ask about the frame that the figures were made for."""
    for k in FRAME:
        if made.get(k) and asked.get(k) and str(made[k]) != str(asked[k]):
            raise ValueError(f"the figures were made for another {k}; make them again")


def check_ids(records: DataFrame, key: str = "id") -> None:
    """Every record needs an id of its own."""
    bad = records.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k = '' OR n > 1")
    if not bad.isEmpty():
        raise ValueError("records without an id, or with one that others have")


def _top(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """({keys}, evidence_ids): the first ``n`` ids of each group by weight, then id; groups are cut before they travel."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("weight").desc(), "id"))
    best = rows.select(*keys, "id", "weight").withColumn("k", k).where(F.col("k") <= n)
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias("e")).select(*keys, F.transform("e", lambda x: x["id"]).alias("evidence_ids"))


def assemble(records: DataFrame, triggers: DataFrame, dimensions: list[str], overall: float, quality: float, coverage: float, achievement: float, evidence: int = 5, limit: int = 10_000) -> DataFrame:
    """Investigations (investigation_id, type, dimension, value, priority, level, confidence, label, status, caveats, evidence_ids,
    indicators, n, candidate), by priority.

    ``records``: id, platform, author, evidence_confidence, impact_confidence, weight and the ``dimensions``.
    ``triggers``: type, dimension, value (null with the dimension "all"), priority, strength. One investigation for each type,
    dimension and value. A trigger that no record answers to has n = 0 and no evidence.
    """
    of = [F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]
    wide = records.select("id", "platform", "author", "evidence_confidence", "impact_confidence", "weight", F.inline(F.array(*of, F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")))))
    known = triggers.withColumn("value", F.coalesce("value", F.lit(""))).groupBy("type", "dimension", "value").agg(F.max_by(F.struct("priority", "strength"), F.col("priority")).alias("t")).select("type", "dimension", "value", "t.*")
    where = known.select("dimension", "value").distinct()
    local = wide.join(where, ["dimension", "value"], "left_semi")
    figures = R.local_evidence(local, ["dimension", "value"])
    out = known.join(figures, ["dimension", "value"], "left").join(_top(local, ["dimension", "value"], evidence), ["dimension", "value"], "left")
    out = out.fillna({"n": 0, "sources": 0, "authors": 0, "evidence": 0.0, "missing_impact": 0.0, "low_semantic": 0.0})
    out = out.withColumn("confidence", R.local_confidence(F.lit(overall), F.lit(quality), F.col("strength"))).withColumn("priority", A.r(F.least(F.lit(100.0), F.greatest(F.lit(0.0), "priority")) + 1e-9, 2))
    out = out.withColumn("status", R.evidence_status(F.col("confidence"))).withColumn("caveats", R.quality_caveats(F.lit(coverage), F.lit(achievement)))
    names = F.create_map(*[x for t, i in TYPES.items() for x in (F.lit(t), F.array(*map(F.lit, i)))])
    out = out.select(
        "type", "dimension", "value", "priority", R.band(F.col("priority"), HIGH, MEDIUM).alias("level"), "confidence", R.band(F.col("confidence"), 75, 50).alias("label"), "status", "caveats",
        F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"), F.try_element_at(names, F.col("type")).alias("indicators"), "n",
        ((F.col("priority") >= CANDIDATE) & (F.col("status") != "limited_evidence")).alias("candidate"), F.struct("dimension", "value").alias("ord"),
    )
    return R.numbered(out, ["type", "dimension", "value"], limit).drop("ord")


def with_lineage(items: DataFrame, made_from: DataFrame, now: DataFrame) -> DataFrame:
    """``items`` with input_digest and stale: whether the rows that they were made from (``input_hash``) are those of now."""
    key = now.select(F.col("digest").alias("now_digest"), F.col("n").alias("now_n"))
    both = made_from.select(F.col("digest").alias("input_digest"), "n").join(F.broadcast(key), F.lit(True)).select("input_digest", ((F.col("input_digest") != F.col("now_digest")) | (F.col("n") != F.col("now_n"))).alias("stale"))
    return items.join(F.broadcast(both), F.lit(True))  # one row


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def trigger(kind: str, dimension: str, df: DataFrame, when: Column, value: Column | None, priority: Column, strength: Column) -> DataFrame:
    """Triggers of one kind from rows of figures."""
    if kind not in TYPES:
        raise ValueError(f"unknown kind {kind}")
    v = F.lit(None).cast("string") if value is None else value.cast("string")
    return df.where(when).select(F.lit(kind).alias("type"), F.lit(dimension).alias("dimension"), v.alias("value"), priority.cast("double").alias("priority"), strength.cast("double").alias("strength"))
