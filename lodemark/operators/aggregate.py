"""Weighted aggregates over evidence records (see ``functions.scores`` for the weights).

Every operator is one conditional aggregation, or one with a join to its own small result; label
dimensions that must show empty labels are joined from a literal list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that most operators read; made on use, since a column needs a running session.
_COLUMNS = {"W": "reputation_weight", "S": "sentiment_score", "ELIGIBLE": "eligible"}


def __getattr__(name: str) -> Column:
    if name in _COLUMNS:
        return F.col(_COLUMNS[name])
    raise AttributeError(name)


def rep() -> Column:
    return F.col("reputation_weight")


def score() -> Column:
    return F.col("sentiment_score")


def eligible_record() -> Column:
    return F.col("eligible")


def r(x: Column, digits: int = 4) -> Column:
    """``x`` as a double, rounded as SQL engines round doubles: the product with the power of ten goes to the nearest whole number,
    halves away from zero. ``F.round`` rounds the shortest decimal form instead, which differs where that ends in a five."""
    power = F.lit(float(10**digits))
    return F.round(x.cast("double") * power, 0) / power


def weighted_mean(value: Column, weight: Column) -> Column:
    """Null where no weight is positive."""
    w = F.when(weight > 0, weight)
    return F.sum(w * value) / F.nullif(F.sum(w), F.lit(0.0))


def effective_sample_size(weight: Column) -> Column:
    w = F.when(weight > 0, weight)
    return F.coalesce(F.pow(F.sum(w), F.lit(2.0)) / F.sum(w * w), F.lit(0.0))


def index_of(mean: Column) -> Column:
    """0 to 100 from a mean sentiment in [-1, 1]; null stays null."""
    return F.when(mean.isNotNull(), F.least(F.greatest((mean + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 100)


def rep_weight() -> Column:
    return F.when(eligible_record(), rep()).otherwise(F.lit(0.0))


def reputation(records: DataFrame, *keys: str) -> DataFrame:
    """index, weighted_sentiment, eligible_records, effective_weight and interpretation by ``keys``."""
    out = records.groupBy(*keys).agg(
        weighted_mean(score(), rep_weight()).alias("m"),
        F.count_if(eligible_record()).alias("n"),
        F.sum(rep_weight()).alias("w"),
        effective_sample_size(rep_weight()).alias("ess"),
    )
    idx = index_of(F.col("m"))
    word = F.when(idx.isNull(), "insufficient_evidence").when(idx < 45, "negative").when(idx > 55, "positive").otherwise("neutral_band")
    return out.select(
        *keys,
        r(idx, 2).alias("index"),
        r(F.col("m"), 6).alias("weighted_sentiment"),
        F.when(F.col("m").isNull(), 0).otherwise(F.col("n")).cast("long").alias("eligible_records"),
        r(F.when(F.col("m").isNull(), F.lit(0.0)).otherwise(F.col("w")), 6).alias("effective_weight"),
        r(F.col("ess"), 2).alias("effective_sample_size"),
        word.alias("interpretation"),
    )


def distribution(records: DataFrame, field: str, labels: tuple[str, ...], weight: str, only: Column | None = None) -> DataFrame:
    """label, n, percent and weighted_percent for all of ``labels``, also those that do not occur."""
    rows = records if only is None else records.where(only)
    got = rows.where(F.col(field).isin(*labels)).groupBy(F.col(field).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(weight) > 0, F.col(weight))).alias("w"))
    want = records.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("label"))
    full = want.join(F.broadcast(got), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w", F.lit(0.0)).alias("w"))
    every = Window.partitionBy()  # a handful of labels
    share = lambda c: F.coalesce(100 * F.col(c) / F.nullif(F.sum(c).over(every).cast("double"), F.lit(0.0)), F.lit(0.0))
    return full.select("label", F.col("n").cast("long").alias("n"), r(share("n"), 2).alias("percent"), r(share("w"), 2).alias("weighted_percent"))


def contributions(records: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Additive index points by ``key``: 50 * sum(w * s) / total weight; together they give index - 50."""
    name = F.coalesce(F.nullif(F.trim(F.col(key)), F.lit("")), F.lit("Unclassified")).alias("name")
    g = records.where(eligible_record()).groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(rep()).alias("w"), F.sum(rep() * score()).alias("ws"), F.avg("impact_score").alias("impact"))
    whole = g.agg(F.sum("w").alias("total"))
    out = g.crossJoin(F.broadcast(whole)).select(
        "name",
        F.col("n").alias("mention_count"),
        r(F.col("w"), 4).alias("effective_weight"),
        r(F.coalesce(F.col("ws") / F.nullif("w", F.lit(0.0)), F.lit(0.0)), 4).alias("average_sentiment"),
        r(F.coalesce(50 * F.col("ws") / F.nullif("total", F.lit(0.0)), F.lit(0.0)), 4).alias("points"),
        r(F.col("impact"), 4).alias("average_impact"),
    )
    if limit is None:
        return out
    return out.orderBy(F.abs("points").desc(), F.col("effective_weight").desc(), "name").limit(limit)


def share_by(records: DataFrame, *keys: str, weight: str = "reputation_weight", eligible: str = "eligible") -> DataFrame:
    """Weight share, mean sentiment and mean impact by ``keys``; the last key is the label, shares are within the others."""
    w = F.col(weight)
    g = records.where(F.col(eligible) & (w > 0)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * score()).alias("ws"), F.avg("impact_score").alias("impact"))
    within = Window.partitionBy(*keys[:-1])
    return g.select(*keys, F.col("n").alias("records"), (F.col("w") / F.sum("w").over(within)).alias("share"), (F.col("ws") / F.col("w")).alias("average_sentiment"), F.col("impact").alias("average_impact"))


def weighted_share(cond: Column, weight: Column) -> Column:
    """Share of the weight where ``cond`` holds; null without weight."""
    w = F.when(weight > 0, weight)
    return F.coalesce(F.sum(F.when(cond, w)), F.lit(0.0)) / F.nullif(F.sum(w), F.lit(0.0))


def daily_series(records: DataFrame, emotions: tuple[str, ...]) -> DataFrame:
    """One row for each day that has records: volume, index, shares, confidence and the share of each emotion."""
    w, o = rep_weight(), F.when(F.col("opinion_eligible"), F.col("opinion_weight")).otherwise(F.lit(0.0))
    g = records.groupBy("day").agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("independent_voice_weight").alias("voices"),
        effective_sample_size(w).alias("ess"),
        F.count_distinct("platform").alias("source_count"),
        weighted_mean(score(), w).alias("m"),
        weighted_share(F.col("sentiment_label") == "negative", w).alias("negative"),
        F.sum("impact_score").alias("attention"),
        *[weighted_share(F.col("primary_emotion") == e, o).alias(e) for e in emotions],
    )
    conf = 0.72 * F.least(F.lit(1.0), F.col("ess") / 20) + 0.28 * F.least(F.lit(1.0), F.col("source_count") / 3)
    conf = F.least(F.greatest(conf, F.lit(0.0)), F.lit(1.0))
    return g.select(
        "day",
        "records",
        r(F.col("voices"), 4).alias("effective_voices"),
        r(F.col("ess"), 4).alias("effective_sample_size"),
        "source_count",
        r(conf, 4).alias("daily_confidence"),
        F.when(conf >= 0.75, "high").when(conf >= 0.45, "medium").otherwise("low").alias("confidence_label"),
        r(index_of(F.col("m")), 2).alias("index"),
        F.col("negative").alias("negative_share"),
        r(F.col("attention"), 4).alias("attention_score_sum"),
        *[F.col(e).alias(f"{e}_share") for e in emotions],
    )


def robust_scores(series: DataFrame, columns: list[str], partition: list[str] | None = None, min_points: int = 5) -> DataFrame:
    """Adds {column}_z to a series (one row a day): median and MAD twice aggregated and joined back.

    Missing values count as 0; fewer than ``min_points`` rows give 0.
    """
    from lodemark.functions.scores import robust_z

    keys = partition or []
    s = series.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns})
    med = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k"), *[F.median(f"_{c}").alias(f"_m_{c}") for c in columns])
    s = s.join(F.broadcast(med), keys) if keys else s.crossJoin(F.broadcast(med))
    mad = s.groupBy(*keys).agg(*[F.median(F.abs(F.col(f"_{c}") - F.col(f"_m_{c}"))).alias(f"_d_{c}") for c in columns])
    s = s.join(F.broadcast(mad), keys) if keys else s.crossJoin(F.broadcast(mad))
    z = {f"{c}_z": F.when(F.col("_k") < min_points, F.lit(0.0)).otherwise(robust_z(F.col(f"_{c}"), F.col(f"_m_{c}"), F.col(f"_d_{c}"))) for c in columns}
    return s.withColumns(z).drop("_k", *[p + c for c in columns for p in ("_", "_m_", "_d_")])


def anomaly_flags(scored: DataFrame, emotions: tuple[str, ...]) -> Column:
    """Flags of a day from its robust scores and shares."""
    z = lambda c: F.col(f"{c}_z") >= 3.5
    flags = [F.when(z("records"), "volume_spike"), F.when(z("negative_share") & (F.col("negative_share") >= 0.35), "negative_share_spike")]
    for e in emotions:
        flags.append(F.when(z(f"{e}_share") & (F.col(f"{e}_share") >= (0.25 if e == "anger" else 0.2)), f"{e}_share_spike"))
    return F.array_compact(F.array(*flags))


def share_shift(target: DataFrame, baseline: DataFrame, limit: int | None = 5) -> DataFrame:
    """Change of shares by label between two results of ``share_by``; labels on one side count 0 on the other."""
    t = target.select(F.col("name"), F.col("share").alias("ts"), F.col("records").alias("tn"))
    b = baseline.select(F.col("name"), F.col("share").alias("bs"), F.col("records").alias("bn"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = t.join(b, "name", "full_outer").select("name", r(z("ts"), 6).alias("target_share"), r(z("bs"), 6).alias("baseline_share"), r(z("ts") - z("bs"), 6).alias("share_delta"), n("tn").alias("target_records"), n("bn").alias("baseline_records"))
    out = out.where((F.abs("share_delta") >= 0.02) | (F.col("target_records") >= 2))
    return out if limit is None else out.orderBy(F.abs("share_delta").desc(), F.col("target_records").desc(), "name").limit(limit)


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; Spark prunes to one row a partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def apportion(df: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Largest remainder: integers that add up to ``total``; ties by key."""
    whole = df.agg(F.sum(weight).cast("double").alias("_w"))
    x = df.crossJoin(F.broadcast(whole)).withColumn("_x", F.col(weight) * F.lit(float(total)) / F.col("_w")).withColumn("_f", F.floor("_x"))
    order = Window.partitionBy().orderBy((F.col("_x") - F.col("_f")).desc(), key)  # one row a source
    rest = F.lit(total) - F.sum("_f").over(Window.partitionBy())
    return x.withColumn("allocated", (F.col("_f") + F.when(F.row_number().over(order) <= rest, 1).otherwise(0)).cast("long")).drop("_w", "_x", "_f")


def greedy(df: DataFrame, order: list[Column], cap: str, want: int) -> DataFrame:
    """In order, each row takes what is left of ``want``, up to its cap."""
    w = Window.partitionBy().orderBy(*order)
    before = F.coalesce(F.sum(cap).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("allocated", F.greatest(F.lit(0), F.least(F.col(cap), F.lit(want) - before)).cast("long"))


def confusion(df: DataFrame, truth: str, guess: str, classes: tuple[int, ...]) -> DataFrame:
    """A row for each true class with the counts of each guess."""
    return df.groupBy(truth).agg(*[F.count_if(F.col(guess) == c).alias(f"guess_{c}") for c in classes])


def class_scores(df: DataFrame, truth: str, guess: str, classes: tuple[int, ...]) -> DataFrame:
    """precision, recall and F1 of each class that occurs."""
    both = df.select(F.explode(F.array(*map(F.lit, classes))).alias("class"), truth, guess)
    hit = both.groupBy("class").agg(
        F.count_if((F.col(truth) == F.col("class")) & (F.col(guess) == F.col("class"))).alias("tp"),
        F.count_if(F.col(truth) == F.col("class")).alias("p"),
        F.count_if(F.col(guess) == F.col("class")).alias("g"),
    )
    div = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    tp, p, g = F.col("tp"), F.col("p"), F.col("g")
    return hit.where((p > 0) | (g > 0)).select("class", "tp", "p", "g", r(div(tp, g), 6).alias("precision"), r(div(tp, p), 6).alias("recall"), r(div(2 * tp, p + g), 6).alias("f1"))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)
