"""Merkle manifest of a table, with proofs by coordinate lookup.

Rows become leaves, numbered within their group; every ``ARITY`` consecutive nodes become their digest
until one is left, and the groups' roots form a last tree in the same way. A node has coordinates
(group, level, position). Nodes are made and kept in blocks of four levels, up to 81 nodes below one, so
that a tree of a thousand million leaves takes five rounds.

A proof is what a row needs to reach the root: its siblings at each level. A leaf explodes the
coordinates that it needs within its block, from its position and the size of its group, joins them with
the table of nodes, and has the rest from the node above its block, which has looked up its own in the
same way. So the nodes near the root, which all rows of a group need, are asked for by 81 rows each and
not by a third of the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemark.session import cut, discard

ARITY, LEVELS = 3, 4
BLOCK = ARITY**LEVELS
COLUMNS = "doc_id", "source", "lang", "n_chars", "text"
STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(value: Column) -> Column:
    """A value that runs into no other: its length in bytes, a colon and itself; a hyphen for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def numbered(df: DataFrame, group: str, *order: str) -> DataFrame:
    """``df`` written out with ``idx``, the place of a row in its group by ``order`` (nulls first), and ``n``, the group's size.

    Rows are dealt by ranges of group and order, so a group that holds most rows lies in many tasks;
    the places start from counts of the earlier ranges, one row for each range that a group touches.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    rows = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    rows_in = rows.withColumn("range", F.shiftright("at", 33))
    runs = rows_in.groupBy(group, "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy(group)
    runs = runs.select(group, "range", "first", (F.sum("size").over(w.orderBy("range")) - F.col("size")).alias("before"), F.sum("size").over(w).alias("n"))
    out = rows_in.join(runs, [group, "range"]).withColumn("idx", F.col("at") - F.col("first") + F.col("before"))
    out = cut(out.drop("at", "range", "first", "before"))
    discard(rows)
    return out


def _up(nodes: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int")), lambda i: F.sha2(F.concat_ws("", F.slice(nodes, i * ARITY + 1, F.lit(ARITY))), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """(grp, block, levels, top, n): the nodes of each block level by level, its top, and how many tops its group has."""
    rows = nodes.groupBy("grp", F.expr(f"idx div {BLOCK}").alias("block"), "n").agg(F.sort_array(F.collect_list(F.struct("idx", "h"))).alias("rows"))
    start = F.struct(F.array(F.transform("rows", lambda x: x["h"])).alias("levels"), F.col("n").alias("n"))
    # a group that is down to one node grows no more levels
    grown = F.aggregate(
        F.sequence(F.lit(1), F.lit(LEVELS)),
        start,
        lambda acc, _: F.when(acc["n"] <= 1, acc).otherwise(F.struct(F.concat(acc["levels"], F.array(_up(F.element_at(acc["levels"], -1)))).alias("levels"), F.floor((acc["n"] + ARITY - 1) / ARITY).alias("n"))),
    )
    return rows.select("grp", "block", grown.alias("g")).select("grp", "block", "g.levels", F.element_at(F.element_at("g.levels", -1), 1).alias("top"), "g.n")


def build(nodes: DataFrame) -> list[DataFrame]:
    """The written blocks of each round over ``nodes`` (grp, idx, n, h); the tops of the last one are the groups' roots."""
    left = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [cut(_blocks(nodes.select("grp", "idx", "n", "h")))]
    while (left := -(-left // BLOCK)) > 1:
        rounds.append(cut(_blocks(tops(rounds[-1]))))
    return rounds


def tops(blocks: DataFrame) -> DataFrame:
    return blocks.select("grp", F.col("block").alias("idx"), "n", F.col("top").alias("h"))


def node_table(blocks: DataFrame) -> DataFrame:
    """(grp, level, pos, h): the nodes of one round by coordinates; level 0 is the round's own input."""
    return blocks.select("grp", "block", F.posexplode("levels").alias("level", "a")).select(
        "grp", "level", F.posexplode("a").alias("i", "h"), (F.col("block") * F.element_at(F.array(*[F.lit(ARITY ** (LEVELS - k)) for k in range(LEVELS + 1)]), F.col("level") + 1)).alias("base")
    ).select("grp", "level", (F.col("base") + F.col("i")).cast("long").alias("pos"), "h")


def _power(level: Column) -> Column:
    return F.pow(F.lit(float(ARITY)), level).cast("long")


def siblings() -> Column:
    """(level, pos) of the nodes that a node needs to climb through one block, from ``idx`` and ``n``."""
    def one(level: Column) -> Column:
        own = F.call_function("div", F.col("idx"), _power(level))
        n = F.ceil(F.col("n") / _power(level))
        run = own - own % ARITY
        return F.transform(F.filter(F.sequence(run, run + ARITY - 1), lambda p: (p != own) & (p < n)), lambda p: F.struct(level.alias("level"), p.alias("pos")))

    return F.flatten(F.transform(_levels(), one))


def _levels() -> Column:
    """The levels of a block at which the group still has more than one node."""
    return F.filter(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.col("n") > _power(k))


def proofs(nodes: DataFrame, rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """``nodes`` with ``steps`` (before, after: the siblings to the left and right at each level) up to the root, and the columns of ``above``.

    ``above`` (grp, steps, ...) holds the steps from a group's root on.
    """
    more = [c for c in above.columns if c not in ("grp", "steps")]
    up = above.withColumn("idx", F.lit(0).cast("long"))
    for blocks, lower in reversed(list(zip(rounds, [nodes, *map(tops, rounds[:-1])], strict=True))):
        asks = lower.select("grp", "idx", F.explode(siblings()).alias("c")).select("grp", "idx", "c.level", "c.pos")
        found = asks.join(node_table(blocks), ["grp", "level", "pos"])
        gathered = found.groupBy("grp", "idx").agg(F.sort_array(F.collect_list(F.struct("level", "pos", "h"))).alias("found"))
        rows = lower.join(gathered, ["grp", "idx"], "left")

        def side(level: Column, left: bool) -> Column:
            own = F.call_function("div", F.col("idx"), _power(level))
            return F.concat_ws("", F.transform(F.filter(F.coalesce("found", F.array()), lambda x: (x["level"] == level) & ((x["pos"] < own) if left else (x["pos"] > own))), lambda x: x["h"]))

        steps = F.transform(_levels(), lambda k: F.struct(side(k, True).alias("before"), side(k, False).alias("after")))
        rows = rows.withColumn("own", steps).withColumn("block", F.call_function("div", F.col("idx"), F.lit(BLOCK).cast("long"))).drop("found")
        up = rows.join(up.select("grp", F.col("idx").alias("block"), "steps", *more), ["grp", "block"])
        up = up.withColumn("steps", F.concat("own", "steps")).drop("own", "block")
    return up


@dataclass
class Manifest:
    """The written tree: ``leaves`` (grp, idx, n, h and the row's own columns), the blocks of its rounds, and the tree over the groups' roots."""

    leaves: DataFrame
    rounds: list[DataFrame]
    groups: DataFrame
    group_rounds: list[DataFrame]
    root: str | None

    def proofs(self) -> DataFrame:
        """The rows of ``leaves`` with subroot and steps."""
        top = self.groups.select(F.lit("").alias("grp"), F.lit(None).cast(STEPS).alias("steps")).distinct().withColumn("steps", F.array().cast(STEPS))
        mid = proofs(self.groups, self.group_rounds, top)
        above = mid.select(F.col("name").alias("grp"), "steps", F.col("h").alias("subroot"))
        return proofs(self.leaves, self.rounds, above)


def manifest(df: DataFrame, leaf: Column, group: Column, order: str, *carry: Column) -> Manifest:
    """The tree over the rows of ``df``: ``leaf`` is a row's digest, ``group`` a string (null sorts first), ``order`` the column that leaves ascend by.

    Ties of ``order`` ascend by the digest; a null comes first.
    """
    name = F.coalesce(F.concat(F.lit("="), group), F.lit(""))
    leaves = numbered(df.select(name.alias("grp"), F.col(order).alias("order"), leaf.alias("h"), *carry), "grp", "order", "h").drop("order")
    rounds = build(leaves)
    groups = numbered(tops(rounds[-1]).select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"), "grp", "name")
    above = build(groups)
    root = tops(above[-1]).first()
    return Manifest(leaves, rounds, groups, above, root["h"] if root else None)


def row_digest(text: Column, columns: tuple[str, ...] = COLUMNS) -> Column:
    return digest(*[framed(text if c == "text" else F.col(c)) for c in columns])


def fold(steps: Column, leaf: Column) -> Column:
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["before"], acc, s["after"]), 256))


def prove(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents.

    Where 2 divides the crc32 of the decimal doc_id, the fold starts from the row without the line
    feeds of its text, so it verifies only where there were none. A null doc_id is first in its source and
    is not tampered with; rows that repeat a doc_id ascend by digest; equal rows are leaves of their own.
    An empty table gives no rows. Other columns are ignored.
    """
    docs = docs.select(*[F.col(c) for c in COLUMNS])
    odd = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.contains(F.col("text"), F.lit("\n"))
    tampered = F.when(odd, row_digest(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    tree = manifest(docs, row_digest(F.col("text")), F.col("source").cast("string"), "doc_id", F.col("doc_id"), tampered.alias("tampered"))
    rows = tree.proofs()
    folded = fold(F.col("steps"), F.coalesce("tampered", "h"))
    proof = F.sha2(F.concat_ws("", F.transform("steps", lambda s: F.concat(s["before"], s["after"]))), 256)
    out = rows.select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(tree.root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same rows in DuckDB. The crc32 is written out, as DuckDB has none.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT,0,0,0,0,0,0,0]), lambda c, z: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce('=' || source, '') AS grp, replace(text, chr(10), '') AS bare, text,
 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS odd FROM documents, tab),
l0 AS (SELECT doc_id, grp, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS h, sha256(head || coalesce(strlen(CASE WHEN odd THEN bare ELSE text END) || ':' || CASE WHEN odd THEN bare ELSE text END, '-')) AS g FROM d),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM l0),
nodes AS (SELECT grp, 0 AS level, idx AS pos, h, n FROM leaves
 UNION ALL SELECT grp, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY grp, level, pos // 3, n),
sub AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
top AS (SELECT 0 AS level, idx AS pos, h, n FROM sub
 UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n),
walk AS (SELECT leaves.doc_id, leaves.grp, leaves.idx AS id, 0 AS level, leaves.idx AS at, leaves.n, g AS acc, '' AS proof FROM leaves
 UNION ALL SELECT w.doc_id, w.grp, w.id, w.level + 1, w.at // 3, (w.n + 2) // 3,
  sha256(string_agg(CASE WHEN x.pos = w.at THEN w.acc ELSE x.h END, '' ORDER BY x.pos)), w.proof || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos <> w.at), '')
 FROM walk w JOIN nodes x ON x.grp = w.grp AND x.level = w.level AND x.pos // 3 = w.at // 3 WHERE w.n > 1 GROUP BY w.doc_id, w.grp, w.id, w.level, w.at, w.n, w.acc, w.proof),
climb AS (SELECT w.doc_id, w.grp, w.id, 0 AS level, s.idx AS at, s.n, w.acc, w.proof FROM walk w JOIN sub s ON s.grp = w.grp WHERE w.n = 1
 UNION ALL SELECT w.doc_id, w.grp, w.id, w.level + 1, w.at // 3, (w.n + 2) // 3,
  sha256(string_agg(CASE WHEN x.pos = w.at THEN w.acc ELSE x.h END, '' ORDER BY x.pos)), w.proof || coalesce(string_agg(x.h, '' ORDER BY x.pos) FILTER (WHERE x.pos <> w.at), '')
 FROM climb w JOIN top x ON x.level = w.level AND x.pos // 3 = w.at // 3 WHERE w.n > 1 GROUP BY w.doc_id, w.grp, w.id, w.level, w.at, w.n, w.acc, w.proof)
SELECT c.doc_id, l.h AS leaf, s.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = t.h AS verified
FROM climb c JOIN leaves l ON l.grp = c.grp AND l.idx = c.id JOIN sub s ON s.grp = c.grp JOIN top t ON t.n = 1 WHERE c.n = 1"""
