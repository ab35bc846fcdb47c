"""Alignment of the tokens of two tokenizers over a corpus.

Text a is cut by a byte-level BPE (A) and by a SentencePiece model (B). Both cut a space and the text
after it into runs of the same bytes, so each token is a range of bytes, and a token of A and one of B
are linked where their ranges overlap. Places where a token of A and one of B both end cut a text into
groups.

No token of either reaches across a place where a space follows something that is no white space: A's
pattern never puts a space behind another character, and no piece of B has its space mark behind another
character (looked up in the vocabulary; with one that has, the unit is the whole text). What lies
between two such places, a unit, is encoded and aligned once while it is remembered, and a text is the
sum of its units.

Counts of pairs: each task adds up packed keys (id of B << 32 | id of A) with ``np.unique`` and passes
them on when they get many; a sort by range brings equal keys together, where run lengths are summed
while the sorted keys and counts are written as shards to the shared folder. A second pass over the
texts maps the shards into memory and finds counts by ``np.searchsorted``.
"""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemark.session import cut, discard, work_dir

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Fixed pre-token pattern of the vocabulary of A.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANKS = re.compile(r"\s ")
#: Bounds of what a process keeps: remembered units (characters, and as many more for each), keys of a task's partial counts, texts taken together.
UNITS, UNIT, PARTIAL, TOGETHER = 32 << 20, 64, 2 << 20, 256
I8 = np.dtype("<i8")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder as Spark names it."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of ``n`` for each."""
    order = np.argsort(keys, kind="stable")
    out, first = np.unique(keys[order], return_index=True)
    return out, np.add.reduceat(n[order], first) if len(out) else n[:0]


class Tokenizers:
    """Both vocabularies, and the units met so far with their tokens aligned."""

    def __init__(self, path_a: str = MODEL_A, path_b: str = MODEL_B):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)["model"]
        at = byte_alphabet()
        ranks = {bytes(at[c] for c in token): i for token, i in model["vocab"].items() if all(c in at for c in token)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in pairs]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("the ids of the merges have to ascend")  # they serve as ranks
        special = {t: i for t, i in model["vocab"].items() if i > made[-1]}  # plain text inside a text
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={k: i for k, i in ranks.items() if i <= made[-1]}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        for token, i in special.items():
            self.bytes_a[i] = token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.space_b = self.b.piece_to_id(MARK)
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        self.size = [np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b)]
        # a token's text in the list of groups: even places before another token of its side, odd ones at the group's end
        self.names = [np.array([f"{i}{c}" for i in range(len(t)) for c in (",", end)], object) for t, end in ((self.bytes_a, "|"), (self.bytes_b, ";"))]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.groups: list[str] = []
        self._pieces: list[tuple[np.ndarray, np.ndarray]] = []
        self._counts, self._keys = np.zeros((0, 4), np.int64), np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        """The units of a text that is not empty, each without the space that it begins with."""
        if self.whole:
            return [text]
        parts = text.split(" ")
        if not BLANKS.search(" " + text):
            return parts
        out = parts[:1]
        for p in parts[1:]:
            if out[-1] == "" or out[-1][-1].isspace():
                out[-1] += " " + p
            else:
                out.append(p)
        return out

    def learn(self, units: set[str]) -> None:
        """Encode and align units that are not remembered."""
        new = [u for u in units if u not in self.place]
        plain = [u for u in new if u and not u[-1].isspace() and MARK not in u]
        for lo in range(0, len(plain), 4096):
            self._together(plain[lo : lo + 4096])
        for u in set(new).difference(plain):
            self._alone(u)

    def _together(self, new: list[str]) -> None:
        """Units one behind the other; none ends in a blank, so they stay units."""
        text = " ".join(new)
        a, b = np.array(self.a.encode_ordinary(" " + text), np.int64), np.array(self.b.encode(text, num_threads=1), np.int64)
        want = (" " + text).encode()
        if not self.whole and all(b"".join(map(t.__getitem__, ids.tolist())) == want for t, ids in ((self.bytes_a, a), (self.bytes_b, b))):
            self._align(new, a, b, np.cumsum([len(u.encode()) + 1 for u in new]))
        else:
            for u in new:
                self._alone(u)

    def _alone(self, u: str) -> None:
        ids_a = np.array(self.a.encode_ordinary(" " + u), np.int64)
        ids_b = np.array(self.b.encode(u, num_threads=1) if u else [self.space_b], np.int64)
        want = (" " + u).encode()
        if b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == want == b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())):
            self._align([u], ids_a, ids_b, np.array([len(want)]))
        else:
            self._align([u], ids_a[:0], ids_b[:0], np.zeros(1, np.int64))  # no tokens: its text has none

    def _align(self, new: list[str], a: np.ndarray, b: np.ndarray, unit_end: np.ndarray) -> None:
        # both sides have the same bytes, so ends in them are comparable
        end_a, end_b = np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b])
        ends, common = np.union1d(end_a, end_b), np.intersect1d(end_a, end_b, assume_unique=True)
        # between two neighbouring ends lies one token of each side, and no two stretches have the same two
        keys = b[np.searchsorted(end_b, ends)] << 32 | a[np.searchsorted(end_a, ends)]
        upto = [np.searchsorted(x, unit_end, "right") for x in (end_a, end_b, common, ends)]
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        names = np.empty(len(a) + len(b), object)
        upto_b = np.concatenate(([0], np.searchsorted(end_b, common, "right")))
        upto_a = np.searchsorted(end_a, common, "right")
        names[np.arange(len(a)) + upto_b[group_a]] = self.names[0][2 * a + (common[group_a] == end_a)]
        names[np.arange(len(b)) + upto_a[group_b]] = self.names[1][2 * b + (common[group_b] == end_b)]
        words, lo = names.tolist(), 0
        for u, hi in zip(new, (upto[0] + upto[1]).tolist(), strict=True):
            self.groups.append("".join(words[lo:hi]))
            self.place[u] = len(self.place)
            self.held += len(u) + UNIT
            lo = hi
        self._pieces.append((np.diff(np.stack(upto, axis=1), axis=0, prepend=0), keys))

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links) of all units, zeros for one that makes its text invalid; the keys of all links in their order."""
        if self._pieces:
            self._counts = np.concatenate([self._counts, *(c for c, _ in self._pieces)])
            self._keys = np.concatenate([self._keys, *(k for _, k in self._pieces)])
            self._pieces = []
        return self._counts, self._keys

    def texts(self, col: pa.Array) -> Iterator[list[np.ndarray | None]]:
        """For some texts at a time the places of their units; None for a text without tokens."""
        for lo in range(0, len(col), TOGETHER):
            if self.held > UNITS:
                self.forget()
            cut = [self.units(t) if t else () for t in col.slice(lo, TOGETHER).to_pylist()]
            self.learn(set().union(*cut))
            place = self.place
            at = np.array([place[x] for u in cut for x in u], np.int64)
            bad = np.concatenate(([0], np.cumsum(self.table()[0][at, 0] == 0)))
            to = np.cumsum([len(u) for u in cut])
            yield [at[hi - len(u) : hi] if u and bad[hi] == bad[hi - len(u)] else None for u, hi in zip(cut, to.tolist(), strict=True)]


_known: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(paths: tuple[str, str]) -> Tokenizers:
    if paths not in _known:
        _known[paths] = Tokenizers(*paths)
    return _known[paths]


def _partial(paths: tuple[str, str], limit: int) -> Callable:
    """Partial counts (key, n) of a task; keys come again where there are more than ``limit``."""

    def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + (1 << 16)]) for x in (keys, n)], ["key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(paths)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            for some in tok.texts(batch.column("text")):
                counts, keys = tok.table()
                times = np.bincount(np.concatenate([np.zeros(0, np.int64), *(at for at in some if at is not None)]), minlength=len(counts))
                times = np.repeat(times, counts[:, 3])
                held.append(summed(keys[times > 0], times[times > 0]))
                if sum(len(k) for k, _ in held) > limit:
                    held = [summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    if len(held[0][0]) > limit // 2:
                        yield from rows(*held[0])
                        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        yield from rows(*summed(*(np.concatenate(x) for x in zip(*held, strict=True))))

    return run


SHARD = "name string, first long, last long, size long"


def _shards(folder: str) -> Callable:
    """Writes the sorted rows of a task, equal keys summed, as one shard; a task that is tried again writes another file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        name, size, first, last = uuid.uuid4().hex, 0, None, None
        files: list[pa.NativeFile] = []
        left = (np.zeros(0, np.int64), np.zeros(0, np.int64))

        def put(keys: np.ndarray, n: np.ndarray) -> None:
            nonlocal size, first, last
            if not len(keys):
                return
            if not files:
                fs.create_dir(path, recursive=True)
                files.extend(fs.open_output_stream(f"{path}/{name}.{end}") for end in ("keys", "counts", "best"))
                first = int(keys[0])
            last = int(keys[-1])
            size += len(keys)
            b, at = np.unique(keys >> 32, return_index=True)
            best = np.stack((b, np.maximum.reduceat(n, at)), axis=1)
            for f, x in zip(files, (keys, n, best), strict=True):
                f.write(x.astype(I8).tobytes())

        for batch in batches:
            keys, n = summed(*(np.concatenate((x, batch.column(c).to_numpy())) for x, c in zip(left, ("key", "n"), strict=True)))
            put(keys[:-1], n[:-1])  # the last key may go on
            left = keys[-1:], n[-1:]
        put(*left)
        for f in files:
            f.close()
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (first, pa.int64()), (last, pa.int64()), (size, pa.int64()))], ["name", "first", "last", "size"])

    return run


class Shards:
    """Sorted counts of a folder, mapped into memory; files of a store without local paths are fetched first and have no name on this machine's disk."""

    def __init__(self, folder: str, rows: list[tuple[str, int, int, int]], n_b: int):
        self.fs, self.path = filesystem(folder)
        self.rows = sorted(rows, key=lambda r: r[1])
        self.first = np.array([r[1] for r in self.rows], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.best = np.zeros(n_b, np.int64)
        for name, *_ in self.rows:
            x = self._map(f"{name}.best").reshape(-1, 2)
            np.maximum.at(self.best, x[:, 0], x[:, 1])

    def _map(self, name: str) -> np.ndarray:
        if isinstance(self.fs, pafs.LocalFileSystem):
            return np.memmap(f"{self.path}/{name}", I8, "r")
        with tempfile.TemporaryFile() as out, self.fs.open_input_stream(f"{self.path}/{name}") as src:
            while piece := src.read(8 << 20):
                out.write(piece)
            out.flush()
            return np.memmap(out, I8, "r")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Counts of keys; 0 for one that the corpus does not have."""
        out = np.zeros(len(keys), np.int64)
        where = np.searchsorted(self.first, keys, "right") - 1
        for s in np.unique(where[where >= 0]).tolist():
            if s not in self.open:
                self.open[s] = self._map(f"{self.rows[s][0]}.keys"), self._map(f"{self.rows[s][0]}.counts")
            have, n = self.open[s]
            mine = np.flatnonzero(where == s)
            at = np.minimum(np.searchsorted(have, keys[mine]), len(have) - 1)
            out[mine] = np.where(have[at] == keys[mine], n[at], 0)
        return out


@dataclass
class PairCounts:
    """Counts of linked id pairs, as sorted shards of a shared folder with a manifest; the folder can be opened by another session."""

    folder: str
    shards: list[tuple[str, int, int, int]]  # one for each partition of the sort

    @staticmethod
    def build(docs: DataFrame, paths: tuple[str, str] = (MODEL_A, MODEL_B), limit: int = PARTIAL) -> PairCounts:
        spark = docs.sparkSession
        folder = work_dir(spark, "pairs")
        partial = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_partial(paths, limit), "key long, n long")
        partial = cut(partial)  # the ranges come from a sample of it, and texts are to be encoded once
        partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_shards(folder), SHARD).write.parquet(f"{folder}/manifest")
        discard(partial)
        return PairCounts.open(spark, folder)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> PairCounts:
        return PairCounts(folder, [tuple(r) for r in spark.read.schema(SHARD).parquet(f"{folder}/manifest").collect()])


OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(paths: tuple[str, str], index: PairCounts, with_groups: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(paths)
        shards = Shards(index.folder, index.shards, len(tok.bytes_b))
        known, sums = None, np.zeros((0, 6), np.int64)
        for batch in batches:
            rows, digests, groups = [], [], []
            for some in tok.texts(batch.column("text")):
                if known is not tok.place:
                    known, sums = tok.place, np.zeros((0, 6), np.int64)
                counts, all_keys = tok.table()
                if len(sums) < len(counts):  # units that are new
                    counts = counts[len(sums) :]
                    to = np.concatenate(([0], np.cumsum(counts[:, 3])))
                    keys, back = np.unique(all_keys[len(all_keys) - to[-1] :], return_inverse=True)
                    n = shards.find(keys)
                    best = (n == shards.best[keys >> 32])[back]
                    both = np.stack([np.concatenate(([0], np.cumsum(x))) for x in (best, n[back])], axis=1)
                    sums = np.concatenate((sums, np.concatenate((counts, both[to[1:]] - both[to[:-1]]), axis=1)))
                for at in some:
                    text = "" if at is None else "".join([tok.groups[i] for i in at.tolist()])[:-1]
                    rows.append(sums[at].sum(axis=0) if at is not None else np.zeros(6, np.int64))
                    digests.append(hashlib.sha256(text.encode()).hexdigest() if at is not None else "")
                    if with_groups:
                        groups.append(text)
            if rows:
                cols = [batch.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in np.stack(rows, axis=1)), pa.array(digests, pa.string())]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                if with_groups:
                    cols, names = [*cols, pa.array(groups, pa.string())], [*names, "groups"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def align(docs: DataFrame, paths: tuple[str, str] = (MODEL_A, MODEL_B), index: PairCounts | None = None, with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs`` (columns doc_id, text).

    Counts are those of ``docs`` unless an ``index`` of another corpus is given. A text that is null,
    empty, or not the bytes of its tokens (one with a literal space mark, say) has no tokens: zeros and an
    empty digest. Special tokens' names in a text are plain text. Rows that repeat count each time. With
    ``with_groups`` the groups themselves follow as a last column. Other columns are ignored.
    """
    index = index or PairCounts.build(docs, paths)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(paths, index, with_groups), OUT + (", groups string" if with_groups else ""))
