"""MinHash near-duplicates by a signature-coordinate inverted join.

Each distinct shingle set is posted under its (coordinate, minimum) pairs. Two sets of similarity s
agree on each of the k coordinates with chance s, so only pairs that agree on at least ``match`` of
them can matter; by the prefix rule it is enough to post the k - match + 1 pairs of each set that
are rarest in the corpus, and pairs that only one set has are skipped. Candidates whose collision
count reaches ``match`` are confirmed on the full shingle sets.

Equal sets are one vertex from the start. What the prefix lists connect is a family: all links lie
inside families, so each set travels once, to its family. There a member's 32 lists are merged: the
shortest ones give candidates, the longer ones are only probed for these, and a candidate goes as soon
as it can no longer reach ``match``. Candidates of another component are confirmed on the full sets; a
union-find keeps one link for each merge, so no list is expanded into pairs, and none is cut. A family
whose sets are too large for one task is first linked to the centres of its lists; then members
outside its largest component meet all members, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.llm import words as W
from lodemark.operators.components import connected_components
from lodemark.session import cut, discard

COORDS, MATCH, SHINGLE = 32, 14, 5
#: Shingles that a task holds at once, of a family or of each side of a block (8 bytes each).
FAMILY = 4_000_000


def _sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = W.text_buffers(texts)
    h, _, _, first = W.word_hashes(data, off, lower=True)
    g = W.grams(h, n)
    for i in range(len(first) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield W.whole(h[a:b])
        else:
            yield np.zeros(0, np.uint64)


def _signer(k: int, n: int):
    mul = (W.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)) | np.uint64(1))[:, None]
    tag = np.arange(k, dtype=np.int64) << 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, one, two, sig = [], [], [], []
            for u in (x for p in range(0, batch.num_rows, 1024) for x in _sets(batch.column("text").slice(p, 1024), n)):
                size.append(len(u))
                m = W.mix(u)
                one.append(int(m.sum(dtype=np.uint64).astype(np.int64)))
                two.append(int(np.bitwise_xor.reduce(m * np.uint64(0xD6E8FEB86659FD93)).astype(np.int64)) if len(u) else 0)
                if len(u):
                    low = np.full(k, np.iinfo(np.uint64).max)
                    for p in range(0, len(u), 8192):
                        low = np.minimum(low, (u[None, p : p + 8192] * mul).min(axis=1))
                    sig.append(tag | (low >> np.uint64(32)).astype(np.int64))
                else:
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "h1", "h2", "sig"],
            )

    return run


def signatures(docs: DataFrame, coords: int = COORDS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig): set size, a 128-bit digest of the set, and its coordinates."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_signer(coords, shingle), "doc_id long, n_shingles long, h1 long, h2 long, sig array<bigint>")


def _blobs(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in range(0, batch.num_rows, 512):
                part = batch.slice(p, 512)
                sets = pa.array([u.tobytes() for u in _sets(part.column("text"), n)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("family", "id", "sig", "large")), sets], ["family", "id", "sig", "large", "shingles"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _find(up: np.ndarray, x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _agreeing(token: np.ndarray, member: np.ndarray, own: np.ndarray, match: int, n: int) -> np.ndarray:
    """Members on at least ``match`` of the posting lists of ``own``'s tokens.

    ``token`` and ``member`` are the lists, by token and member. The shortest lists are merged; a
    member that is on none of them cannot reach ``match``. Longer lists are probed for what is left.
    """
    lo, hi = np.searchsorted(token, own, side="left"), np.searchsorted(token, own, side="right")
    order = np.argsort(hi - lo, kind="stable")
    prefix = len(own) - match + 1
    count = np.bincount(np.concatenate([member[lo[i] : hi[i]] for i in order[:prefix]]), minlength=n)
    left = np.flatnonzero(count)
    count = count[left]
    for rest, i in zip(range(len(own) - prefix, 0, -1), order[prefix:], strict=True):
        able = count + rest >= match
        left, count = left[able], count[able]
        if not len(left):
            break
        row = member[lo[i] : hi[i]]
        if len(row):
            count = count + (row[np.minimum(np.searchsorted(row, left), len(row) - 1)] == left)
    return left[count >= match]


def _links(match: int, num: int, den: int):
    """Confirmed links that join different components, for each block of a bucket.

    Rows (block, id, comp, asks, all, sig, shingles): those that ask are compared with all that are of
    another component. In a whole family everybody asks, but for the members of its centre's component.
    """

    def one_block(ids, comp, asks, every, sig, sets, out) -> None:
        side, mine = np.flatnonzero(every), np.flatnonzero(asks)
        flat = sig[side].ravel()
        order = np.argsort(flat, kind="stable")
        token, member = flat[order], (order // sig.shape[1]).astype(np.int64)
        up = np.unique(comp, return_inverse=True)[1]  # numbers of the components
        first = np.full(up.max() + 1, -1)
        root = np.empty(len(up), np.int64)  # a union-find over rows, a component starting as one tree
        for i, c in enumerate(up):
            first[c] = i if first[c] < 0 else first[c]
            root[i] = first[c]
        whole = bool((asks & every).all())
        centre = -1
        if whole:  # the member on the longest lists goes first
            _, which, size = np.unique(flat, return_inverse=True, return_counts=True)
            weight = np.log2(size[which]).reshape(len(side), -1).sum(axis=1)
            mine = mine[np.argsort(-weight[mine], kind="stable")]
            centre = int(mine[0])
        for p in mine.tolist():
            if whole and p != centre and _find(root, p) == _find(root, centre):
                continue
            near = side[_agreeing(token, member, sig[p], match, len(side))]
            own = sets[p]
            for at in range(0, len(near), 256):
                mark = _find(root, p)
                some = np.array([q for q in near[at : at + 256].tolist() if _find(root, q) != mark], np.int64)
                if not len(some):
                    continue
                joined = np.concatenate([sets[q] for q in some])
                size = np.array([len(sets[q]) for q in some])
                place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
                both = np.add.reduceat(own[place] == joined, np.cumsum(size) - size)
                for q in some[den * both >= num * (size + len(own) - both)].tolist():
                    x, y = _find(root, p), _find(root, q)
                    if x != y:
                        root[y] = x
                        out.append((ids[p], ids[q]))

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, ids, comp, asks, every = (table.column(c).to_numpy() for c in ("block", "id", "comp", "asks", "all"))
        sig = np.concatenate([np.zeros(0, np.int64), *(c.flatten().to_numpy() for c in table.column("sig").chunks)]).reshape(len(ids), -1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        order = np.lexsort((ids, block))
        heads = np.flatnonzero(np.concatenate(([True], block[order][1:] != block[order][:-1])))
        out: list[tuple[int, int]] = []
        for lo, hi in zip(heads, np.append(heads[1:], len(order)), strict=True):
            part = order[lo:hi]
            one_block(ids[part], comp[part], asks[part], every[part], sig[part], [sets[i] for i in part], out)
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


BLOCKS = "block", "id", "comp", "asks", "all", "sig", "shingles"


def _linked(blocks: DataFrame, buckets: int, match: int, percent: int) -> DataFrame:
    """Links within blocks; blocks share tasks by the bucket of their number."""
    rows = blocks.select(*BLOCKS, F.pmod(F.xxhash64("block"), F.lit(buckets)).alias("bucket"))
    return rows.groupBy("bucket").applyInArrow(_links(match, percent, 100), "a long, b long")


def _large_links(rows: DataFrame, posted: DataFrame, match: int, percent: int, limit: int) -> DataFrame:
    """Links of the families that are too large for a task; ``rows`` (family, id, sig, shingles) is a written table."""
    lists = posted.join(rows.select("id", "family").distinct(), "id")
    hub = lists.groupBy("token").agg(F.max(F.struct("central", (-F.col("id")).alias("neg"))).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("token", (-F.col("m.neg")).alias("a"))
    star = lists.join(hub, "token").where("id <> a").select("a", F.col("id").alias("b")).distinct()
    left = rows.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("shingles").alias("x"))
    right = rows.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("shingles").alias("y"))
    agree = F.size(F.array_intersect("sa", "sb")) >= match
    near = star.join(left.drop("x"), "a").join(right.drop("y"), "b").where(agree).select("a", "b").distinct()
    full = near.join(left.drop("sa"), "a").join(right.drop("sb"), "b").select("a", "b", "x", "y")
    first = cut(full.mapInArrow(_confirm(percent, 100), "a long, b long").distinct())
    comp = cut(connected_components(first, "a", "b"))
    member = rows.join(comp, "id", "left").withColumn("comp", F.coalesce("component", "id")).withColumn("n", F.length("shingles") / 8)
    per = member.groupBy("family", "comp").agg(F.sum("n").alias("n"))
    size = per.groupBy("family").agg(F.sum("n").alias("whole"), F.max(F.struct("n", "comp")).alias("m"))
    size = size.select("family", F.col("m.comp").alias("main"), F.ceil(F.col("whole") / limit).cast("int").alias("na"), F.ceil((F.col("whole") - F.col("m.n")) / limit).cast("int").alias("no")).where("no > 0")
    member = member.join(size, "family")
    h = F.abs(F.xxhash64("id"))
    asking = member.where("comp <> main").withColumns({"asks": F.lit(True), "all": F.lit(False), "bo": F.pmod(h, "no"), "ba": F.explode(F.expr("sequence(0, na - 1)"))})
    every = member.withColumns({"asks": F.lit(False), "all": F.lit(True), "bo": F.explode(F.expr("sequence(0, no - 1)")), "ba": F.pmod(h, "na")})
    blocks = asking.unionByName(every).withColumn("block", F.xxhash64("family", "bo", "ba"))
    return first.union(_linked(blocks, 1 << 16, match, percent))


def near_duplicates(docs: DataFrame, coords: int = COORDS, match: int = MATCH, shingle: int = SHINGLE, percent: int = 75, limit: int = FAMILY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (columns doc_id, text).

    Words are lower-cased in A-Z only. A text with fewer than ``shingle`` words has its whole
    sequence as its one shingle; one without words, or null, has an empty set and links with
    nothing. Rows with one doc_id are one vertex, with the links of each of their texts. A null doc_id
    takes no part: its component is null and it is kept. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(signatures(docs, coords, shingle))
    full = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = cut(full.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id"), F.min_by("sig", "doc_id").alias("sig")))
    reps = sets.select("id", "sig")
    # (coordinate, value) pairs with their counts; pairs of one set alone are skipped
    post = reps.select("id", F.explode("sig").alias("token"))
    often = post.groupBy("token").agg(F.count(F.lit(1)).alias("freq")).where("freq > 1")
    mine = post.join(often, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("t"))
    lists = mine.select("id", F.aggregate("t", F.lit(0.0), lambda s, x: s + F.log2(x["freq"].cast("double"))).alias("central"), F.expr(f"transform(slice(t, 1, greatest(0, size(t) - {match - 1})), x -> x.token)").alias("t"))
    posted = cut(lists.select("id", "central", F.explode("t").alias("token")))
    # families: what the prefix lists connect
    head = posted.groupBy("token").agg(F.min("id").alias("h"))
    family = cut(connected_components(posted.join(head, "token").where("id <> h").select("h", "id").distinct(), "h", "id"))
    members = family.select("id", F.col("component").alias("family")).join(sets.select("id", "sig", "n_shingles"), "id")
    size = members.groupBy("family").agg(F.sum("n_shingles").alias("whole"))
    members = cut(members.join(size.select("family", (F.col("whole") > limit).alias("large")), "family"))
    # each text travels once, by shuffle at every size, and its set once more, to its family
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    held = texts.join(members.select("id", "family", "sig", "large").hint("shuffle_hash"), "id")
    rows = held.mapInArrow(_blobs(shingle), "family long, id long, sig array<bigint>, large boolean, shingles binary")
    total = members.agg(F.count_if("large").alias("large"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()
    if total["large"]:
        rows = cut(rows)
    blocks = rows.where("NOT large").select(F.col("family").alias("block"), "id", F.col("id").alias("comp"), F.lit(True).alias("asks"), F.lit(True).alias("all"), "sig", "shingles")
    second = _linked(blocks, max(64, 4 * total["n"] // limit), match, percent)
    if total["large"]:
        second = second.union(_large_links(rows.where("large").select("family", "id", "sig", "shingles"), posted, match, percent, limit))
    second = cut(second)
    for done in (posted, family, members, rows):
        discard(done)
    same = full.join(sets.select("h1", "h2", "n_shingles", "id"), ["h1", "h2", "n_shingles"]).groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("ids"))
    same = same.where("size(ids) > 1").select("a", F.explode("ids").alias("b"))
    found = connected_components(second.union(same), "a", "b")
    comp = sets.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    of_set = sets.join(comp, "id", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "id").alias("set_component"))
    out = base.select("doc_id", "n_shingles", "h1", "h2").join(of_set, ["h1", "h2", "n_shingles"], "left")
    label = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("set_component"))
    label = F.when(F.col("doc_id").isNotNull(), label)
    return out.select("doc_id", "n_shingles", label.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
