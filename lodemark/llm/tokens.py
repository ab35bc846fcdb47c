"""Token counts that follow edits.

A text is cut into pre-tokens by a pattern; byte-pair encoding never merges across their borders, so
its token count is the sum of theirs. A segment tree over the pre-tokens of a document keeps, in each
node, the characters and tokens below it. An edit finds the leaf it touches by descending over the
character sums, cuts only the touched stretch anew, with the pre-token before it as context and on
until an old border after the edit comes up again, re-encodes what changed there and updates the sums
on the way to the root.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pre-token pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 64
CACHE = 2_000_000


class Counter:
    """Token counts of pre-tokens, remembered up to a bound."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def cut(self, text: str, start: int = 0) -> Iterator[str]:
        for m in self.pattern.finditer(text, start):
            yield m[0]

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[piece] = n
        return n

    def full(self, text: str) -> int:
        return sum(map(self.count, self.pattern.findall(text)))


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str = RANKS, pattern: str = PATTERN) -> Counter:
    """The vocabulary, loaded once a process."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


@dataclass(frozen=True)
class Edit:
    """Replace the characters from ``start`` up to ``end`` by ``text``; out-of-range places are clamped."""

    start: int
    end: int
    text: str


class TokenTree:
    """Segment tree over the pre-tokens of one text; leaves hold up to ``LEAF`` pre-tokens when built."""

    def __init__(self, text: str, c: Counter):
        self.c, self.encoded = c, 0
        pieces = c.pattern.findall(text)
        self._build([pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]])

    def _build(self, leaves: list[list[str]]) -> None:
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.leaves = leaves + [[] for _ in range(self.size - len(leaves))]
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(self.leaves):
            self.chars[self.size + i] = sum(map(len, leaf))
            self.tokens[self.size + i] = sum(map(self.c.count, leaf))
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int, int]:
        """(leaf, place in it, its first character) of the pre-token that holds character ``at``; the last one at the end."""
        i, left = 1, at
        while i < self.size:
            i = 2 * i if left < self.chars[2 * i] or not self.chars[2 * i + 1] else 2 * i + 1
            left -= self.chars[i - 1] if i % 2 else 0
        leaf, start = i - self.size, at - left
        for k, p in enumerate(self.leaves[leaf]):
            if left < len(p) or k + 1 == len(self.leaves[leaf]):
                return leaf, k, start
            left -= len(p)
            start += len(p)
        return leaf, 0, start

    def _before(self, leaf: int, k: int) -> tuple[int, int] | None:
        while k == 0:
            leaf -= 1
            if leaf < 0:
                return None
            k = len(self.leaves[leaf])
        return leaf, k - 1

    def _after(self, leaf: int, k: int) -> Iterator[tuple[int, int, str]]:
        while leaf < self.size:
            for j in range(k, len(self.leaves[leaf])):
                yield leaf, j, self.leaves[leaf][j]
            leaf, k = leaf + 1, 0

    def _set(self, leaf: int, pieces: list[str]) -> None:
        self.leaves[leaf] = pieces
        i = self.size + leaf
        self.chars[i], self.tokens[i] = sum(map(len, pieces)), sum(map(self.c.count, pieces))
        while i > 1:
            i //= 2
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def apply(self, e: Edit) -> int:
        """Apply an edit; the number of pre-tokens encoded anew."""
        start = max(0, min(e.start, self.n_chars))
        end = max(start, min(e.end, self.n_chars))
        leaf, k, first = self._find(start)
        for _ in range(2):  # the pre-token before may grow into the edit
            back = self._before(leaf, k)
            if back is None:
                break
            leaf, k = back
            first -= len(self.leaves[leaf][k])
        old, taken, length = [], [], 0
        stream = self._after(leaf, k)
        ahead = max(32, len(e.text))
        done = False
        new: list[str] = []
        while not done:
            more = 0
            while more < ahead or first + length < end:
                nxt = next(stream, None)
                if nxt is None:
                    done = True
                    break
                taken.append(nxt)
                old.append(nxt[2])
                length += len(nxt[2])
                more += len(nxt[2])
            whole = "".join(old)
            fresh = whole[: start - first] + e.text + whole[end - first :]
            shift = len(e.text) - (end - start)
            borders, at = {}, 0
            for n, p in enumerate(old):
                if at >= end - first:
                    borders[at + shift] = n
                at += len(p)
            new, at = [], 0
            for p in self.c.cut(fresh):
                # an old border behind the edit: from here on the cut is as it was, if the next
                # pre-token is whole in view
                if at in borders and at > start - first + len(e.text) and borders[at] + 1 < len(old):
                    old, taken, done = old[: borders[at]], taken[: borders[at]], True
                    break
                new.append(p)
                at += len(p)
            ahead *= 2
        self._splice(leaf, k, taken, new)
        self.encoded += len(new)
        return len(new)

    def _splice(self, leaf: int, k: int, taken: list[tuple[int, int, str]], new: list[str]) -> None:
        gone: dict[int, int] = {}
        for i, _, _ in taken:
            gone[i] = gone.get(i, 0) + 1
        touched = sorted(gone) or [leaf]
        for i in touched:
            from_k = k if i == leaf else 0
            rest = self.leaves[i][from_k + gone.get(i, 0) :]
            keep = self.leaves[i][:from_k]
            self._set(i, keep + new + rest if i == touched[0] else keep + rest)
        if len(self.leaves[touched[0]]) > 4 * LEAF:
            flat = [p for x in self.leaves for p in x]
            self._build([flat[i : i + LEAF] for i in range(0, len(flat), LEAF)])


SCHEMA = "doc_id long, n_tokens long, n_tokens_edited long, n_pretokens_encoded long, n_edits long"


def _run(path: str, pattern: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, pattern)
        for batch in batches:
            before, after, encoded, n_edits = [], [], [], []
            for text, edits in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree = TokenTree(text.as_py() or "", c)
                before.append(tree.n_tokens)
                todo = edits.as_py() or []
                encoded.append(sum(tree.apply(Edit(e["start"], e["end"], e["text"] or "")) for e in todo))
                after.append(tree.n_tokens)
                n_edits.append(len(todo))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (before, after, encoded, n_edits))], ["doc_id", "n_tokens", "n_tokens_edited", "n_pretokens_encoded", "n_edits"])

    return run


def token_counts(docs: DataFrame, edits: str = "edits", path: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Token counts of each row of ``docs`` (doc_id, text, edits) before and after its edits.

    ``edits`` is array<struct<start: bigint, end: bigint, text: string>> in code points, applied in
    order, each to the text left by those before. A null text is empty; null edits are none; places out
    of range are clamped. Rows that repeat are counted each. Other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(edits).alias("edits"))
    return src.mapInArrow(_run(path, pattern), SCHEMA)


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits by rule: a word put in at a third, ten characters taken out at two thirds, one replaced at the end."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    at = lambda x: F.floor(x).cast("long")
    one = F.struct(at(n / 3).alias("start"), at(n / 3).alias("end"), F.lit(" revised").alias("text"))
    two = F.struct(at(n * 2 / 3).alias("start"), (at(n * 2 / 3) + 10).alias("end"), F.lit("").alias("text"))
    three = F.struct(F.greatest(n - 4, F.lit(0)).cast("long").alias("start"), F.greatest(n - 3, F.lit(0)).cast("long").alias("end"), F.lit("é").alias("text"))
    return docs.withColumn("edits", F.array(one, two, three))


def counts_with_edits(docs: DataFrame) -> DataFrame:
    """``token_counts`` of each row of ``docs`` (doc_id, text) under the three edits of ``sample_edits``.

    A null or empty text has no tokens before and those of the inserted ones after; rows that repeat are
    counted each; an empty table gives none; other columns are ignored, one named edits too.
    """
    return token_counts(sample_edits(docs.select("doc_id", "text")))
