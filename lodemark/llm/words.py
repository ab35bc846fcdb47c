"""Vectorised word and window hashes over Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D; these never occur inside a multi-byte
UTF-8 character, so bytes can be scanned. Hashes have 64 bits and are equal for equal words on
every machine. Work is done in pieces of about a megabyte, so memory stays bounded by the piece
and by eight bytes for each word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
_COEF = mix(np.arange(1, 65, dtype=U) * U(0xA0761D6478BD642F)) | U(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for places up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(PIECE * 2, n + 1)
        _powers[:] = [np.cumprod(np.concatenate(([U(1)], np.full(size, U(p), U))), dtype=U) for p in (_P, _PINV)]
    return _powers


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word, and for each text the place of its first word (n + 1 entries)."""
    table = BYTE_LOWER if lower else BYTE
    lo, hi = int(off[0]), int(off[-1])
    hashes, starts, ends = [], [], []
    at = lo
    while at < hi:
        to = min(hi, at + PIECE)
        if to < hi:  # cut at the last break; else at the next one
            sp = np.flatnonzero(SPACE[data[at:to]])
            k = int(np.searchsorted(off, to, side="right")) - 1
            best = max(int(sp[-1]) + at + 1 if len(sp) else at, int(off[k]) if off[k] > at else at)
            while best <= at:
                stop = min(hi, to + PIECE)
                sp = np.flatnonzero(SPACE[data[to:stop]])
                k = int(np.searchsorted(off, to, side="left"))
                best = min(to + int(sp[0]) + 1 if len(sp) else stop if stop == hi else at, int(off[k]) if k < len(off) and off[k] <= stop else hi)
                to = stop
            to = best
        b = data[at:to]
        word = ~SPACE[b]
        mark = np.zeros(len(b) + 1, bool)
        i, j = np.searchsorted(off, at, side="left"), np.searchsorted(off, to, side="right")
        mark[off[i:j] - at] = True
        mark[0] = mark[-1] = True
        pad = np.concatenate(([False], word, [False]))
        s = np.flatnonzero(word & (~pad[:-2] | mark[:-1]))
        e = np.flatnonzero(word & (~pad[2:] | mark[1:])) + 1
        if len(s):
            p, q = powers(len(b))
            c = np.concatenate(([U(0)], np.cumsum(table[b] * p[: len(b)], dtype=U)))
            h = (c[e] - c[s]) * q[s]
            hashes.append(mix(h + (e - s).astype(U) * U(0x8EBC6AF09C88C6E3)))
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not hashes:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U), z, z, np.zeros(len(off), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, off, side="left").astype(np.int64)


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n consecutive entries (no regard to texts)."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    g = np.full(m, (n * 0x2545F4914F6CDD1D) % (1 << 64), U)
    for j in range(n):
        g += w[j : j + m] * _COEF[j]
    return mix(g)


def whole(w: np.ndarray) -> np.ndarray:
    """One hash for a short sequence; differs from those of runs of another length."""
    return grams(w, len(w))
