"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is ``width`` consecutive words. Of the hashes of the 5-word runs inside a window the least
is its fingerprint, so equal windows have equal fingerprints and about one run in five is posted.
Documents come in batches of ascending doc_id. The index keeps the fingerprints of earlier batches
in immutable runs sorted by fingerprint; a new batch is merge-joined with them, which tells the
fingerprints that two documents share, and becomes a run itself. When ``fanout`` runs have piled up
they are compacted into one.

A shared fingerprint is only a hint. It is verified on whole windows: those that hold a shared
fingerprint are compared by a 96-bit hash of all their words, and a window is repeated where a
document of smaller doc_id starts it. The answer does not depend on the number of batches.

Entries travel as packed arrays, a few thousand of them in a row, dealt out by hash; the number of
buckets follows the size of the input, so a bucket has a bounded share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.llm import words as W
from lodemark.session import work_dir

WIDTH, RUN = 13, 5
U = np.uint64
ENTRY = "kind int, bucket int, a binary, b binary, c binary"
_SCHEMA = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
FLAG, HISTORY = 0, 1


def _window_fingerprints(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start (no regard to texts) its fingerprint and the place of that run."""
    g = W.grams(h, min(RUN, width))
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    best, at = g[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, width - min(RUN, width) + 1):
        less = g[j : j + m] < best
        best[less] = g[j : j + m][less]
        at[less] = j
    return best, at + np.arange(m)


def _starts(first: np.ndarray, width: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Which window starts lie in one text, and the text of each."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)[:m]
    return np.arange(m) + width <= first[1:][doc], doc


def _deal(kind: int, bucket: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that occurs, with its part of each column as bytes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut[1:], len(bucket))
    packed = [c[order] for c in cols]
    rows = [[c[p:q].tobytes() for p, q in zip(cut, ends, strict=True)] for c in packed] + [[b""] * len(cut)] * (3 - len(cols))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), kind, np.int32)), pa.array(bucket[cut].astype(np.int32)), *(pa.array(r, pa.binary()) for r in rows)], schema=_SCHEMA)


def _merged(table: pa.Table, name: str, dtype) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), dtype) for x in table.column(name)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def _ids(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return col.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), col.is_valid().to_numpy(zero_copy_only=False)


def _fingerprints(width: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs = [], []
            for p in range(0, batch.num_rows, 1024):
                part = batch.slice(p, 1024)
                ids, real = _ids(part.column("doc_id"))
                data, off = W.text_buffers(part.column("text"))
                h, _, _, first = W.word_hashes(data, off)
                best, at = _window_fingerprints(h, width)
                ok, doc = _starts(first, width, len(best))
                ok &= real[doc]
                best, at, doc = best[ok], at[ok], doc[ok]
                new = np.diff(at, prepend=-1) != 0
                keys.append(best[new])
                docs.append(ids[doc[new]])
            key, doc = np.concatenate(keys or [np.zeros(0, U)]), np.concatenate(docs or [np.zeros(0, np.int64)])
            yield from _deal(FLAG, (W.mix(key) % U(buckets)).astype(np.int64), key, doc)

    return run


def _merge(chunks: int) -> Callable:
    """Merge-join of a bucket: entries of the new batch (kind 0) and of the runs (kind 1)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        fresh = np.asarray(table.column("kind")) == FLAG
        lengths = np.array([len(x.as_buffer()) // 8 for x in table.column("a")], np.int64)
        k, d, new = _merged(table, "a", U), _merged(table, "b", np.int64), np.repeat(fresh, lengths)
        order = np.lexsort((d, k))
        k, d, new = k[order], d[order], new[order]
        once = np.ones(len(k), bool)
        once[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        k, d, new = k[once], d[once], new[once]
        head = np.flatnonzero(np.diff(k, prepend=~k[:1]) != 0) if len(k) else np.zeros(0, np.int64)
        group = np.zeros(len(k), np.int64)
        group[head[1:]] = 1
        group = np.cumsum(group)
        size = np.diff(np.append(head, len(k)))
        touched = np.bincount(group, weights=new, minlength=len(head)) > 0
        hit = (size > 1)[group] & touched[group] if len(k) else np.zeros(0, bool)
        out = list(_deal(FLAG, _chunk(d[hit], chunks), d[hit], k[hit]))
        if new.any():
            out.append(pa.RecordBatch.from_arrays([pa.array([HISTORY], pa.int32()), pa.array([int(key[0].as_py())], pa.int32()), pa.array([k[new].tobytes()], pa.binary()), pa.array([d[new].tobytes()], pa.binary()), pa.array([b""], pa.binary())], schema=_SCHEMA))
        return pa.Table.from_batches(out, _SCHEMA)

    return run


def _compact(key: tuple, table: pa.Table) -> pa.Table:
    k, d = _merged(table, "a", U), _merged(table, "b", np.int64)
    order = np.lexsort((d, k))
    return pa.Table.from_arrays([pa.array([HISTORY], pa.int32()), pa.array([int(key[0].as_py())], pa.int32()), pa.array([k[order].tobytes()], pa.binary()), pa.array([d[order].tobytes()], pa.binary()), pa.array([b""], pa.binary())], schema=_SCHEMA)


def _chunk(doc_id: np.ndarray, chunks: int) -> np.ndarray:
    return (W.mix(doc_id.astype(U)) % U(chunks)).astype(np.int64)


def _with_chunk(chunks: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _ = _ids(batch.column("doc_id"))
            yield pa.RecordBatch.from_arrays([pa.array(_chunk(ids, chunks).astype(np.int32)), batch.column("doc_id"), batch.column("text")], ["bucket", "doc_id", "text"])

    return run


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in a shared folder, one Parquet folder a run."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, chunks: int, width: int = WIDTH, fanout: int = 4):
        self.spark, self.path, self.buckets, self.chunks, self.width, self.fanout = spark, path, buckets, chunks, width, fanout
        self.runs: list[str] = []
        self.flags: list[str] = []
        self.made = 0

    def _read(self, paths: list[str], kind: int) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(*paths).where(F.col("kind") == kind)

    def append(self, batch: DataFrame) -> None:
        """Merge-join the fingerprints of ``batch`` (doc_id, text) with the runs; add its run."""
        rows = batch.select("doc_id", "text").mapInArrow(_fingerprints(self.width, self.buckets), ENTRY)
        if self.runs:
            rows = rows.unionByName(self._read(self.runs, HISTORY))
        self.made += 1
        out = f"{self.path}/run-{self.made}"
        rows.groupBy("bucket").applyInArrow(_merge(self.chunks), ENTRY).write.parquet(out)
        self.runs.append(out)
        self.flags.append(out)
        if len(self.runs) >= self.fanout:
            self.compact()

    def compact(self) -> None:
        """Merge all runs into one; the old ones are no longer read."""
        if len(self.runs) > 1:
            self.made += 1
            out = f"{self.path}/run-{self.made}"
            self._read(self.runs, HISTORY).groupBy("bucket").applyInArrow(_compact, ENTRY).write.parquet(out)
            self.runs = [out]

    def shared(self) -> DataFrame:
        """Packed (doc_id, fingerprint) entries that another document shares, by chunk of documents."""
        return self._read(self.flags, FLAG)


def _windows(width: int, buckets: int) -> Callable:
    """Windows of the documents of a chunk that hold a shared fingerprint, dealt out by fingerprint."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows or not flags.num_rows:
            return pa.Table.from_batches([], _SCHEMA)
        fd, fk = _merged(flags, "a", np.int64), _merged(flags, "b", U)
        order = np.lexsort((fk, fd))
        fd, fk = fd[order], fk[order]
        ids, real = _ids(docs.column("doc_id").combine_chunks())
        keep = np.flatnonzero(real & np.isin(ids, fd))
        part = docs.take(pa.array(keep))
        ids = ids[keep]
        out = []
        text = part.column("text").combine_chunks()
        for p in range(0, len(ids), 256):
            data, off = W.text_buffers(text.slice(p, 256))
            h, _, _, first = W.word_hashes(data, off)
            best, _ = _window_fingerprints(h, width)
            full = W.grams(h, width)
            ok, doc = _starts(first, width, len(best))
            hit = np.zeros(len(best), bool)
            for i in range(len(first) - 1):
                a, b = int(first[i]), int(first[i + 1]) - width + 1
                if b > a:
                    lo, hi = np.searchsorted(fd, [ids[p + i], ids[p + i] + 1])
                    hit[a:b] = np.isin(best[a:b], fk[lo:hi])
            hit &= ok
            place = np.flatnonzero(hit)
            n = len(place)
            who = np.empty((n, 3), np.int64)
            who[:, 0] = ids[p + doc[hit]]
            who[:, 1] = [0] * n if not n else _row_tags(text.slice(p, 256))[doc[hit]]
            who[:, 2] = place - first[doc[hit]]
            key = best[hit]
            digest = np.empty((n, 12), np.uint8)
            digest[:, :8] = full[hit].view(np.uint8).reshape(n, 8)
            digest[:, 8:] = (W.mix(key) >> U(32)).astype(np.uint32).view(np.uint8).reshape(n, 4)
            wb = (W.mix(key) % U(buckets)).astype(np.int64)
            order = np.argsort(wb, kind="stable")
            out.append((wb[order], digest[order], who[order]))
        wb, digest, who = (np.concatenate([x[i] for x in out]) if out else z for i, z in ((0, np.zeros(0, np.int64)), (1, np.zeros((0, 12), np.uint8)), (2, np.zeros((0, 3), np.int64))))
        return pa.Table.from_batches(list(_deal(FLAG, wb, digest, who[:, 0], who[:, 1:].astype(np.int32))), _SCHEMA)

    return run


def _row_tags(text: pa.Array) -> np.ndarray:
    """31 bits of each text, to tell rows that repeat a doc_id apart."""
    return np.array([int.from_bytes(hashlib.blake2b((t.as_py() or "").encode(), digest_size=4).digest(), "big") >> 1 for t in text], np.int64)


def _repeats(chunks: int) -> Callable:
    """Windows that a document of smaller doc_id starts, sent back to their chunks."""

    def run(table: pa.Table) -> pa.Table:
        digest, doc, place = _merged(table, "a", np.uint8).reshape(-1, 12), _merged(table, "b", np.int64), _merged(table, "c", np.int32).reshape(-1, 2)
        h, x = np.ascontiguousarray(digest[:, :8]).view(U).ravel(), np.ascontiguousarray(digest[:, 8:]).view(np.uint32).ravel()
        order = np.lexsort((doc, x, h))
        h, x, doc, place = h[order], x[order], doc[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
        least = doc[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))] if len(h) else doc
        hit = doc > least
        return pa.Table.from_batches(list(_deal(FLAG, _chunk(doc[hit], chunks), doc[hit], place[hit])), _SCHEMA)

    return run


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _apply(width: int, with_text: bool) -> Callable:
    def run(docs: pa.Table, cuts: pa.Table) -> pa.Table:
        cd, cp = _merged(cuts, "a", np.int64), _merged(cuts, "b", np.int32).reshape(-1, 2)
        order = np.lexsort((cp[:, 1], cp[:, 0], cd))
        cd, cp = cd[order], cp[order]
        ids, real = _ids(docs.column("doc_id").combine_chunks())
        n_words, gone, sha, kept_text = [], [], [], []
        lo, hi = np.searchsorted(cd, ids, side="left"), np.searchsorted(cd, ids, side="right")
        for i, value in enumerate(docs.column("text")):
            text = value.as_py() or ""
            words = text.encode().split()
            left = words
            if hi[i] > lo[i] and real[i]:
                tag = _row_tags(pa.array([text]))[0]
                at = cp[lo[i] : hi[i]]
                at = at[at[:, 0] == tag, 1]
                step = np.zeros(len(words) + width + 1, np.int64)
                np.add.at(step, at, 1)
                np.add.at(step, at + width, -1)
                stay = np.cumsum(step)[: len(words)] == 0
                left = [w for w, s in zip(words, stay, strict=True) if s]
            joined = b" ".join(left)
            n_words.append(len(words))
            gone.append(len(words) - len(left))
            sha.append(hashlib.sha256(joined).hexdigest())
            kept_text.append(joined.decode() if with_text else None)
        return pa.table([docs.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_text, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, batches: int = 2, fanout: int = 4, bucket_entries: int = 400_000, chunk_bytes: int = 4 << 20, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) for each row of ``docs`` (doc_id, text).

    A word is removed where it lies in a window that also starts in a document with a smaller
    doc_id. Fewer than ``width`` words: nothing is removed. Null or empty text: no words, and the
    digest of nothing. Null doc_id: the row is returned whole and counts for no other. Rows that
    repeat a doc_id do not remove from each other. Other columns are ignored. kept_text is null
    unless ``with_text``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    edges = [i / batches for i in range(1, batches)]
    stat = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.percentile_approx("doc_id", edges or [0.5], 10_000).alias("at")).first()
    buckets = max(16, int(stat["bytes"] / 32 / bucket_entries) + 1)
    chunks = max(16, int(stat["bytes"] / chunk_bytes) + 1)
    index = FingerprintIndex(spark, work_dir(spark, "fingerprints"), buckets, chunks, width, fanout)
    marks = sorted(set(stat["at"] or [])) if edges else []
    for low, high in zip([None, *marks], [*marks, None], strict=True):
        part = docs.where("doc_id IS NOT NULL")
        part = part.where(F.col("doc_id") > low) if low is not None else part
        index.append(part.where(F.col("doc_id") <= high) if high is not None else part)
    by_chunk = docs.mapInArrow(_with_chunk(chunks), "bucket int, doc_id long, text string").groupBy("bucket")
    flags = index.shared().select("bucket", "a", "b").groupBy("bucket")
    posted = by_chunk.cogroup(flags).applyInArrow(_windows(width, buckets), ENTRY)
    again = posted.groupBy("bucket").applyInArrow(_repeats(chunks), ENTRY).select("bucket", "a", "b").groupBy("bucket")
    return by_chunk.cogroup(again).applyInArrow(_apply(width, with_text), OUT)
