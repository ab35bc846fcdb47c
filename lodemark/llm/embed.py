"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length one and cut in halves. Two codebooks, fitted independently on a bounded
sample, span a product grid; every vector lies in one cell. A cosine of at least c means a distance
of at most sqrt(2 - 2c), so each vector walks the cells of its label in the order of a lower bound on
the distance (multi-sequence traversal over the two sorted half-distances) and stops where that bound
passes this radius. Every partner lies in a visited cell, so the walk's recall is 1; what it visits is
then verified by the cosine in double precision.

Equal vectors are one class from the start. Cells are dealt out in blocks of bounded size, so a cell
that holds a third of all vectors is many tasks. A block returns counts and a spanning forest of its
links, never the links themselves.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.operators.components import connected_components
from lodemark.session import cut

SAMPLE = 20_000
CELL_ROWS, BLOCK = 32, 2048


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Plain k-means from evenly spaced rows; an empty cluster keeps its centre."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def fit_codebooks(unit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """One codebook for each half of the rows of ``unit``; equal centres are merged."""
    half = unit.shape[1] // 2
    books = [_kmeans(x, min(k, len(x))) for x in (unit[:, :half], unit[:, half:])]
    return tuple(np.unique(b, axis=0) for b in books)


def half_bounds(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Own centre of each row, and the squared least distance from the row to each centre's region."""
    d = (x * x).sum(1)[:, None] + (book * book).sum(1)[None] - 2 * x @ book.T
    own = np.argmin(d, axis=1)
    gap = np.sqrt(np.maximum(((book[:, None] - book[None]) ** 2).sum(2), 1e-300))
    low = np.maximum(0.0, d - d[np.arange(len(x)), own][:, None]) / (2 * gap[own])
    low[np.arange(len(x)), own] = 0.0
    return own, low * low


def traverse(a: np.ndarray, b: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Cells (i, j) by ascending a[i] + b[j], as long as that is at most ``limit``."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap = [(a[ia[0]] + b[ib[0]], 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > limit:
            return
        yield int(ia[i]), int(ib[j])
        if j + 1 < len(ib):
            heapq.heappush(heap, (a[ia[i]] + b[ib[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(ia):
            heapq.heappush(heap, (a[ia[i + 1]] + b[ib[0]], i + 1, 0))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in col]) if len(col) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _walk(books: tuple[np.ndarray, np.ndarray], limit: float) -> Callable:
    one, two = books

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            u = _unit(_matrix(pdf["v"]))
            half = u.shape[1] // 2
            c1, l1 = half_bounds(u[:, :half], one)
            c2, l2 = half_bounds(u[:, half:], two)
            cid, label, own, cell = [], [], [], []
            for r, (i, g) in enumerate(zip(pdf["cid"], pdf["label"], strict=True)):
                home = int(c1[r]) * len(two) + int(c2[r])
                for a, b in traverse(l1[r], l2[r], limit):
                    to = a * len(two) + b
                    if to >= home:
                        cid.append(i)
                        label.append(g)
                        own.append(to == home)
                        cell.append(to)
            yield pd.DataFrame({"cid": cid, "label": label, "own": own, "cell": cell})

    return run


def _forest(hit: np.ndarray) -> np.ndarray:
    """For each column and row vertex of a bipartite boolean matrix its part's least vertex (rows first)."""
    n, m = hit.shape
    root = np.full(n + m, -1)
    for s in np.flatnonzero(hit.any(axis=1)):
        if root[s] >= 0:
            continue
        rows = np.array([s])
        while len(rows):
            root[rows] = s
            cols = np.flatnonzero(hit[rows].any(axis=0) & (root[n:] < 0))
            root[n + cols] = s
            rows = np.flatnonzero(hit[:, cols].any(axis=1) & (root[:n] < 0)) if len(cols) else np.zeros(0, int)
    return root


def _verify(cosine: float) -> Callable:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        res, vis = pdf[pdf["resident"]], pdf[~pdf["resident"]]
        out = {"cid": [], "links": [], "to": []}
        if len(res) and len(vis):
            rid, rn, rx = res["cid"].to_numpy(), res["n"].to_numpy(), _matrix(res["v"])
            rx = rx / np.abs(rx).max(axis=1, keepdims=True)
            ra = np.linalg.norm(rx, axis=1)
            for p in range(0, len(vis), BLOCK):
                part = vis.iloc[p : p + BLOCK]
                vid, vn, own, vx = part["cid"].to_numpy(), part["n"].to_numpy(), part["own"].to_numpy(), _matrix(part["v"])
                vx = vx / np.abs(vx).max(axis=1, keepdims=True)
                hit = (vx @ rx.T) / (np.linalg.norm(vx, axis=1)[:, None] * ra[None]) >= cosine
                hit &= ~own[:, None] | (vid[:, None] < rid[None])
                root = _forest(hit)
                ids = np.concatenate([vid, rid])
                links = np.concatenate([hit @ rn, vn @ hit])
                found = np.flatnonzero(root >= 0)
                out["cid"].append(ids[found])
                out["links"].append(links[found])
                out["to"].append(ids[root[found]])
        return pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()})

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, label).

    Only rows of one label are compared; a null label, or a vector that is null, zero or holds null
    or non-finite components, links with nothing. Vectors of different lengths do not link. Rows that
    repeat a vec_id are vectors of their own with the same id. A null vec_id takes no part. Other
    columns are ignored; an empty table gives an empty result.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    sound = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"
    usable = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(sound)
    label = F.concat_ws(":", F.size("v").cast("string"), "label")  # another length is another space
    classes = cut(usable.withColumn("label", label).groupBy("label", "v").agg(F.min("vec_id").alias("cid"), F.count(F.lit(1)).alias("n")))
    labels = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    size = labels.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    dims = [r[0] for r in classes.select(F.size("v").alias("d")).distinct().collect()]
    k = int(np.clip((size / cell_rows) ** 0.5, 4, 256))
    limit = 2 - 2 * cosine + 1e-9
    walks = None
    for d in dims:
        part = classes.where(F.size("v") == d)
        rows = part.orderBy(F.xxhash64("cid")).limit(sample).select("v").toPandas()["v"]
        books = fit_codebooks(_unit(_matrix(rows)), k) if d > 1 else (np.zeros((1, 0)), np.array([[-1.0], [1.0]]))
        walk = part.select("cid", "label", "v").mapInPandas(_walk(books, limit), "cid long, label string, own boolean, cell int")
        walks = walk if walks is None else walks.union(walk)
    if walks is None:
        out = vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return out.withColumn("kept", F.lit(True))
    walks = cut(walks)
    at = ["label", "cell"]
    homes = walks.where("own").groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nr"))
    visits = walks.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / (4 * BLOCK)).cast("int").alias("nv"))
    plan = homes.join(visits, at)
    h = F.abs(F.xxhash64("cid"))
    body = classes.select("cid", "label", "v", "n")
    seen = walks.join(plan, at)
    resident = seen.where("own").select(*at, "cid", F.lit(True).alias("resident"), "own", F.pmod(h, "nr").cast("int").alias("rb"), F.explode(F.expr("sequence(0, nv - 1)")).alias("vb"))
    visitor = seen.select(*at, "cid", F.lit(False).alias("resident"), "own", F.explode(F.expr("sequence(0, nr - 1)")).alias("rb"), F.pmod(h, "nv").cast("int").alias("vb"))
    rows = resident.unionByName(visitor).join(body, ["cid", "label"])
    found = cut(rows.groupBy("label", "cell", "rb", "vb").applyInPandas(_verify(cosine), "cid long, links long, to long"))
    degree = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found, "cid", "to")
    info = classes.join(degree, "cid", "left").join(comp, F.col("cid") == F.col("id"), "left")
    info = info.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id"))
    out = vectors.withColumn("label", label).join(info, ["label", "v"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
d AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT c.x AS vec_id, CAST(coalesce(d.n, 0) AS BIGINT) AS n_links, c.component_id, c.x = c.component_id AS kept
FROM c LEFT JOIN d USING (x)
"""
