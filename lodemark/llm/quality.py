"""Quality rules as a short-circuit cascade, in SQL functions only.

Base figures are computed for every row, inside the row: no shuffle. The rules are conditions on
these figures or on the text. Their cost (seconds) and selectivity are measured on a bounded sample
of rows, and ``CASE WHEN`` evaluates them in the order of rejections per cost, so a row pays only for
the rules up to the first that rejects it. The order changes the time, never the verdict.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemark.functions.text import here as _here

SAMPLE_ROWS, REPEAT = 1000, 4
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``reject`` is an SQL condition over the base figures and ``text_``; it must not be null."""

    name: str
    reject: str


#: Thresholds are shares of words, lines or letters, all with integer arithmetic.
RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("mean_word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("exclamations", "5 * (length(text_) - length(translate(text_, '!', ''))) > n_words"),
    Rule("capitals", r"2 * (length(text_) - length(regexp_replace(text_, '\\p{Lu}', ''))) > length(text_) - length(regexp_replace(text_, '\\p{L}', ''))"),
    Rule("letters", r"2 * size(filter(w_, x -> x RLIKE '\\p{L}')) < n_words"),
    Rule("bullets", r"10 * size(filter(lines_, x -> x RLIKE '^[ \\t]*[-*\u2022]')) > 9 * n_lines"),
    Rule("ellipses", r"10 * size(filter(lines_, x -> x RLIKE '(\\.\\.\\.|\u2026)[ \\t\\r]*$')) > 3 * n_lines"),
)


#: The base rule, which comes before the cascade.
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def base_figures(docs: DataFrame) -> DataFrame:
    """``row_`` (all columns of ``docs``) with text_, w_ (words), lines_ (lines with a word) and the base figures."""
    df = docs.select(F.struct("*").alias("row_"), "text").withColumn("text_", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("w_", _here(F.expr(r"filter(split(text_, '[\\x20\\x09-\\x0D]+'), x -> x <> '')")))
    df = df.withColumn("lines_", _here(F.expr(r"filter(split(text_, '\n'), x -> x RLIKE '[^\\x20\\x09-\\x0D]')")))
    df = df.withColumn("g_", _here(F.expr("CASE WHEN size(w_) >= 3 THEN sort_array(transform(sequence(0, size(w_) - 3), i -> named_struct('h', xxhash64(w_[i], w_[i + 1], w_[i + 2]), 'p', i))) ELSE array() END")))
    df = df.withColumn("r_", _here(F.expr("filter(zip_with(g_, slice(g_, 2, greatest(size(g_) - 1, 0)), (a, b) -> IF(a.h = b.h, array(a.p, b.p), NULL)), x -> x IS NOT NULL)")))
    df = df.withColumn("p_", _here(F.expr("array_sort(array_distinct(flatten(r_)))")))
    return df.select(
        "row_",
        "text_",
        "w_",
        "lines_",
        _here(F.size("w_").cast("long")).alias("n_words"),
        _here(F.length(F.translate("text_", BLANKS, "")).cast("long")).alias("word_chars"),
        _here((F.length("text_") - F.length(F.translate("text_", "#*$%&|<>", ""))).cast("long")).alias("n_symbols"),
        _here((F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long")).alias("n_dup_lines"),
        _here(F.expr("aggregate(zip_with(p_, slice(p_, 2, greatest(size(p_) - 1, 0)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)")).alias("n_repeat_words"),
        _here(F.size("lines_").cast("long")).alias("n_lines"),
    )


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second, measured on at most ``sample_rows`` random rows (the bound is the parameter).

    Only rows that pass the base rule count, for the cascade sees no others; every row of the table is as
    likely to be drawn as any other.

    A rule's cost is the time of its condition over the sample, repeated ``REPEAT`` times, less that of
    the same job without a condition. Rules are chosen one by one: each by its rejections among the
    rows that those before it leave, divided by its cost. The sample is drawn before any figure is
    computed; the rows count, on Parquet, reads footers only.
    """
    rows = docs.count()
    share = min(1.0, 2.0 * sample_rows / max(1, rows))
    chosen = docs.select("text").sample(share, seed=11).orderBy(F.rand(11)).limit(sample_rows)
    sample = base_figures(chosen).drop("row_").where(f"NOT ({BASE})").persist()
    try:
        bits = F.lit(0)
        for i, rule in enumerate(rules):
            bits = bits + F.expr(rule.reject).cast("int") * (1 << i)
        masks = {r["m"]: r["n"] for r in sample.groupBy(bits.alias("m")).agg(F.count(F.lit(1)).alias("n")).collect()}
        again = sample.withColumn("i_", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))

        def seconds(condition: str) -> float:
            job = again.agg(F.sum(F.when(F.expr(condition), F.col("i_")).otherwise(F.lit(0))).alias("n"))
            job.first()  # compiled and cached
            began = time.perf_counter()
            job.first()
            return time.perf_counter() - began

        bare = seconds("n_words >= 0")
        cost = [max(1e-3, seconds(rule.reject) - bare) for rule in rules]
    finally:
        sample.unpersist()
    order: list[Rule] = []
    left = list(range(len(rules)))
    while left:
        hits = {i: sum(n for m, n in masks.items() if m >> i & 1) for i in left}
        best = max(left, key=lambda i: (hits[i] / cost[i], -cost[i], -i))
        order.append(rules[best])
        left.remove(best)
        masks = {m: n for m, n in masks.items() if not m >> best & 1}
    return order


def cascade(rules: list[Rule]) -> Column:
    """True where a rule rejects; later rules are not evaluated then."""
    verdict = F.when(F.lit(False), F.lit(True))
    for rule in rules:
        verdict = verdict.when(F.expr(rule.reject), F.lit(True))
    return verdict.otherwise(F.lit(False))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The columns of ``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    A null text counts as empty: all figures are 0 and it is rejected (fewer than 50 words). Rows
    that repeat are judged alike. Input columns of the same names as the added ones are replaced.
    An empty table gives an empty result.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    order = rule_order(docs, rules, sample_rows)
    out = base_figures(docs).withColumn("base_failed", F.expr(BASE))
    out = out.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~cascade(order)))
    return out.select(*[F.col("row_")[c].alias(c) for c in docs.columns if c not in added], *added)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id with its figures and verdict."""
    return judge(docs.select("doc_id", "text")).drop("text")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS tx FROM documents),
w AS (SELECT doc_id, tx, regexp_extract_all(tx, '[^\x20\x09-\x0D]+') AS ws,
      list_filter(string_split(tx, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY doc_id),
f AS (SELECT w.doc_id, tx, ws, ls, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(tx, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(tx) - length(regexp_replace(tx, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * n_dup_lines > 3 * len(ls)
    OR 5 * (length(tx) - length(replace(tx, '!', ''))) > n_words
    OR 2 * (length(tx) - length(regexp_replace(tx, '\p{Lu}', '', 'g'))) > length(tx) - length(regexp_replace(tx, '\p{L}', '', 'g'))
    OR 2 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) < n_words
    OR 10 * len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[-*•]'))) > 9 * len(ls)
    OR 10 * len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t\r]*$'))) > 3 * len(ls)) AS kept
FROM b
"""
