"""SentencePiece encoding and decoding with sampled segmentations, drawn without replacement.

The model's pieces span a lattice over each text. Where no piece has two characters side by side, every
segmentation has a cut, so the lattice falls apart there: a unit is what lies between such places, and a
segmentation of the text is one of each unit. Piece weights follow the rank
in the vocabulary, log p = -alpha * log(rank + 2); a character without a piece falls back to the
pieces of its bytes.

Sampling is Gumbel top-k, found by a best-first search. The exact log mass of all completions
(backward sums over the lattice) is the heuristic: a node stands for all segmentations with a given
beginning, and its key is the largest perturbed log probability among them, drawn top-down as a
truncated Gumbel. The best node is opened until it is a whole segmentation; then the next best one is
taken. The samples are the k segmentations of largest perturbed log probability, all distinct, and
the (k + 1)-th largest gives each its inclusion score 1 - exp(-exp(log p - threshold)).

Random numbers are hashes of the seed, the row's key and the place, so a result depends on nothing
else: not on partitions, batches or retries.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemark.llm.words import PIECE, mix, powers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
U = np.uint64
BYTES = 1 << 24  # ids from here on stand for a character's bytes
TOGETHER = 1 << 16  # characters that the model encodes, and ids that it decodes, at once
KEEP = 5 << 20  # places of lattices that a process keeps, some 60 bytes each
_models: dict[tuple[str, float], Lattice] = {}


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(U) << U(21) | b.astype(U)) * U(0x9E3779B97F4A7C15)) >> U(44)


class _Grown:
    """An array that is added to; room is doubled, so adding costs no copy of the rest each time. ``all`` is what it holds."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(0, kind), 0

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def add(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.room):
            room = np.empty(max(n, 2 * self.n), self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : n] = more
        self.n = n


class Lattice:
    """The vocabulary of a model, and lattices over many units at once."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, n = self.sp, self.sp.get_piece_size()
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in plain]
        self.longest = max(map(len, pieces))
        #: hashes of all pieces and their beginnings; those that are no piece have the id -1
        spelt = dict.fromkeys((p[:n] for p in pieces for n in range(1, len(p))), -1) | dict(zip(pieces, plain, strict=True))
        keys = np.array([self._key(np.array([ord(c) for c in p], U)) for p in spelt], U)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(spelt.values()), np.int64)[order]
        inside = {c for p in pieces if len(p) > 1 for c in p}
        self.apart = next(c for c in ("\n", *map(chr, range(0xE000, 0xF900))) if c not in inside)  # no piece joins it to another character
        weight = -alpha * np.log(np.arange(n) + 2.0)
        self.weight, self.byte_weight = weight, -alpha * math.log(n + 2.0)
        spelled = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.piece_size = np.array([len(x) for x in spelled], np.int64)
        self.piece_start = np.concatenate(([0], np.cumsum(self.piece_size)[:-1]))
        self.piece_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        #: whether some piece has two characters side by side, by a hash of the two; a clash only means fewer cuts
        self.joined = np.zeros(1 << 20, bool)
        for p in pieces:
            c = np.array([ord(x) for x in p], np.uint32)
            self.joined[_pair(c[:-1], c[1:])] = True
        self.apart_pieces = len(sp.encode(self.apart)) - 1  # but for the space in front
        self.salt = 0
        self._forget()

    def _forget(self) -> None:
        self.hash1, self.hash2, self.number = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        self.best = np.zeros(0, np.int32)  # pieces of the model's own encoding of each unit
        self.base, self.mass = _Grown(np.int64), _Grown(np.float64)
        self.base.add(np.zeros(1, np.int64))
        self.first, self.cum, self.piece, self.step = _Grown(np.int64), _Grown(np.float32), _Grown(np.int32), _Grown(np.int8)

    def units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The code points of all texts, the begins of their units (and the end of the last one), and
        for each text the place of its first unit (one more entry than texts)."""
        whole = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        first = np.concatenate(([0], np.cumsum([len(t) for t in whole]))).astype(np.int64)
        cps = np.frombuffer("".join(whole).encode("utf-32-le"), np.uint32)
        cut = np.ones(len(cps) + 1, bool)
        if len(cps):
            cut[1:-1] = ~self.joined[_pair(cps[:-1], cps[1:])]
            cut[first] = True
        starts = np.flatnonzero(cut) if len(cps) else np.zeros(1, np.int64)
        return cps, starts, np.searchsorted(starts, first)

    def known(self, cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The number of each unit and the lattices of all numbered ones.

        Lattices stay for later batches, since few units are new; beyond ``KEEP`` places all are
        forgotten, so memory is bounded by that and one batch. Units are told apart by 128 bits: two
        with one first hash start the table anew under another salt.
        """
        h1, h2 = (_unit_hashes(cps, starts, self.salt * 2 + j) for j in (0, 1))
        keys, one, which = np.unique(h1, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash1, keys)
        old = np.append(self.hash1, 0)[at] == keys
        new = one[~old]
        lens = starts[new + 1] - starts[new]
        if len(self.hash1) and self.base.all[-1] + int(lens.sum()) + len(new) > KEEP:
            self._forget()
            return self.known(cps, starts)
        if len(new):
            self._add(_pieces_of(cps, starts[new], lens), lens)
            count = len(self.hash1)
            h = np.concatenate((self.hash1, h1[new]))
            order = np.argsort(h, kind="stable")
            self.hash1, self.hash2 = h[order], np.concatenate((self.hash2, h2[new]))[order]
            self.number = np.concatenate((self.number, np.arange(count, count + len(new))))[order]
            at = np.searchsorted(self.hash1, keys)
        if not np.array_equal(self.hash2[at][which], h2):
            self.salt += 1
            self._forget()
            return self.known(cps, starts)
        return self.number[at][which], tuple(x.all for x in (self.base, self.first, self.cum, self.piece, self.step, self.mass))

    def _add(self, cps: np.ndarray, lens: np.ndarray) -> None:
        """Append lattices. The edges of a place begin at ``first``; ``cum`` ends a place's edges with 2."""
        base, cum, ids, mass = self.build(cps, lens)
        row, col = np.nonzero(ids >= 0)
        count = np.bincount(row, minlength=len(ids))
        self.first.add(len(self.cum.all) + np.cumsum(count) - count)
        self.cum.add(cum[row, col])
        self.piece.add(ids[row, col])
        self.step.add((col + 1).astype(np.int8))
        self.base.add(self.base.all[-1] + base[1:])
        self.mass.add(mass)
        self.best = np.concatenate((self.best, self.best_sizes(cps, base)))

    def best_sizes(self, cps: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Pieces of the model's own encoding of each unit (characters as for ``build``).

        No merge goes across the bounds of units, so units are encoded end to end, with a character between
        them that joins with nothing; lengths in bytes tell whose a piece is.
        """
        cps = cps.copy()
        cps[base[1:] - 1] = ord(self.apart)
        size = 1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF).astype(np.int64)
        size[cps == ord(MARK)] = 1
        out, i = [np.zeros(0, np.int32)], 0
        while i < len(base) - 1:
            j = max(i + 1, int(np.searchsorted(base, base[i] + TOGETHER, side="right")) - 1)
            lo, hi = int(base[i]), int(base[j])
            # the model puts a space of its own in front
            ids = np.array(self.sp.encode(self.apart + cps[lo:hi].astype("<u4").tobytes().decode("utf-32-le"), num_threads=1), np.int64)
            ends = np.cumsum(self.piece_size[ids])
            head = 1 + len(self.apart.encode())
            whole = head + np.cumsum(size[lo:hi])[base[i + 1 : j + 1] - 1 - lo]  # with the character behind each unit
            upto = np.concatenate(([head], whole))
            at = np.searchsorted(ends, upto)
            if at[-1] >= len(ends) or not np.array_equal(ends[at], upto):
                raise ValueError("the model joins characters that no piece of it has side by side")
            out.append((np.diff(at) - self.apart_pieces).astype(np.int32))
            i = j
        return np.concatenate(out)

    @staticmethod
    def _key(cps: np.ndarray) -> int:
        h = 0
        for c in cps.tolist():
            h = (h * 0x9E3779B97F4A7C15 + c + 1) % (1 << 64)
        return h

    def build(self, cps: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat arrays over all places of all units (one more than characters each): place of each unit's
        start, cumulative probabilities of the pieces by length, their ids, and the log mass from here on.
        ``cps`` holds the units' characters, each unit followed by a zero."""
        base = np.concatenate(([0], np.cumsum(lens + 1)))
        wide = self.longest
        cum = np.zeros((base[-1], wide), np.float32)
        ids = np.full((base[-1], wide), -1, np.int32)
        logw = np.full((base[-1], wide), -np.inf, np.float32)
        mass = np.full(base[-1], -np.inf)
        mass[base[1:] - 1] = 0.0
        cps = cps.astype(U)
        left = np.repeat(lens, lens + 1) - (np.arange(base[-1]) - np.repeat(base[:-1], lens + 1))  # characters from here to the end
        h = np.zeros(base[-1], U)
        alive = np.flatnonzero(left > 0)
        for n in range(1, wide + 1):
            alive = alive[left[alive] >= n]
            if not len(alive):
                break
            h[alive] = h[alive] * U(0x9E3779B97F4A7C15) + cps[alive + n - 1] + U(1)
            at = np.minimum(np.searchsorted(self.keys, h[alive]), len(self.keys) - 1)
            begun = self.keys[at] == h[alive]
            alive, found = alive[begun], self.ids[at[begun]]
            hit = found >= 0
            ids[alive[hit], n - 1] = found[hit]
            logw[alive[hit], n - 1] = self.weight[found[hit]]
        bare = np.flatnonzero((left > 0) & (ids[:, 0] < 0))
        c = cps[bare].astype(np.int64)
        size = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        ids[bare, 0] = BYTES + c
        logw[bare, 0] = size * self.byte_weight
        by_left = np.argsort(left, kind="stable")
        bounds = np.searchsorted(left[by_left], np.arange(1, int(left.max()) + 2))
        for n in range(1, int(left.max()) + 1):  # from the ends backwards, all units together
            rows = by_left[bounds[n - 1] : bounds[n]]
            k = min(n, wide)
            s = logw[rows, :k] + mass[rows[:, None] + np.arange(1, k + 1)]
            top = s.max(axis=1)
            e = np.exp(s - top[:, None])
            total = e.sum(axis=1)
            mass[rows] = top + np.log(total)
            c = np.cumsum(e / total[:, None], axis=1)
            c[c >= c[:, -1:]] = 2.0
            cum[rows, :k] = c
        return base, cum, ids, mass


def _unit_hashes(cps: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of each unit, in pieces of about a megabyte."""
    out, i = [np.zeros(0, U)], 0
    while i < len(starts) - 1:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE, side="right")) - 1)
        lo, hi = int(starts[i]), int(starts[j])
        p, q = powers(hi - lo)
        c = np.concatenate((np.zeros(1, U), np.cumsum(mix(cps[lo:hi].astype(U) + U(1 + (salt << 32))) * p[: hi - lo], dtype=U)))
        s, e = starts[i:j] - lo, starts[i + 1 : j + 1] - lo
        out.append(mix((c[e] - c[s]) * q[s] + (e - s).astype(U)))
        i = j
    return np.concatenate(out)


def _pieces_of(cps: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The characters of some units, each unit followed by a zero."""
    ends = np.cumsum(lens + 1)
    own = np.arange(ends[-1]) - np.repeat(ends - lens - 1, lens + 1)
    spot = np.repeat(at, lens + 1) + own
    out = cps[np.minimum(spot, len(cps) - 1)].copy()
    out[ends - 1] = 0
    return out


def lattice(path: str, alpha: float) -> Lattice:
    """The model, loaded once a process."""
    if (path, alpha) not in _models:
        _models[path, alpha] = Lattice(path, alpha)
    return _models[path, alpha]


def hashed(*parts: np.ndarray | int) -> np.ndarray:
    """64 bits from the parts."""
    h = np.zeros(1, U)
    for p in parts:
        h = mix(h + np.asarray(p).astype(np.int64).astype(U) * U(0x9E3779B97F4A7C15) + U(0xD1342543DE82EF95))
    return h


def unit_interval(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((h >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _draw(lat: tuple, unit: np.ndarray, key: np.ndarray, place: np.ndarray, draw: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An ancestral sample for each occurrence of a unit: piece ids in order, where each occurrence's
    begin (one more entry than occurrences), and the log mass of all segmentations of its unit."""
    base, begin, cum, ids, step_of, mass = lat
    n = len(unit)
    at, end = base[unit].copy(), base[unit + 1] - 1
    noise = np.broadcast_to(hashed(seed, draw, key, place), n)
    got: list[tuple[np.ndarray, np.ndarray]] = []
    live, step = np.flatnonzero(at < end), 0
    count = np.zeros(n, np.int64)
    while len(live):
        u = unit_interval(mix(noise[live] + U((step * 0xA0761D6478BD642F) % (1 << 64)))).astype(np.float32)
        here = at[live]
        edge = begin[here]
        more = np.flatnonzero(cum[edge] <= u)
        while len(more):
            edge[more] += 1
            more = more[cum[edge[more]] <= u[more]]
        got.append((live, ids[edge]))
        count[live] += 1
        here += step_of[edge]
        at[live] = here
        live = live[here < end[live]]
        step += 1
    first = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(first[-1], np.int64)
    for s, (rows, piece) in enumerate(got):
        out[first[rows] + s] = piece
    return out, first, mass[base[unit]]


def _redraw(model: Lattice, lat: tuple, unit: int, barred: list[tuple[int, ...]], rng: Iterator[float]) -> tuple[tuple[int, ...], float]:
    """A sample of one unit from all segmentations but the barred ones, and its log probability in the unit."""
    base, begin, cum, ids, step_of, mass = lat
    start, end = int(base[unit]), int(base[unit + 1]) - 1
    log = lambda p: model.weight[p] if p < BYTES else _char_bytes(p) * model.byte_weight
    at, path, lp = start, [], 0.0
    left = [(list(b), sum(log(p) for p in b)) for b in barred]
    while at < end:
        a = b = int(begin[at])
        while cum[b] < 2.0:
            b += 1
        options = list(zip(step_of[a : b + 1].tolist(), ids[a : b + 1].tolist(), strict=True))
        weights = []
        for n, p in options:
            own = lp + log(p) + mass[at + n]
            bad = sum(math.exp(total - own) for b, total in left if b[len(path)] == p)
            weights.append((own, max(0.0, 1.0 - bad)))
        top = max(o for o, _ in weights)
        w = [math.exp(o - top) * f if f > 1e-9 else 0.0 for o, f in weights]
        if not sum(w):
            break
        u, k = next(rng) * sum(w), 0
        while k + 1 < len(w) and (u >= w[k] or not w[k]):
            u -= w[k]
            k += 1
        while not w[k]:
            k -= 1
        n, p = options[k]
        path.append(p)
        lp += log(p)
        at += n
        left = [(b, t) for b, t in left if len(b) > len(path) and b[len(path) - 1] == p]
    return tuple(path), lp - mass[start]


def _char_bytes(code: int) -> int:
    c = code - BYTES
    return 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)


def _truncated(loc: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel at ``loc``, given that it is below ``bound``."""
    with np.errstate(divide="ignore", invalid="ignore"):
        value = -np.logaddexp(-bound, np.log(-np.log(u)) - loc)
    value[~np.isfinite(loc)] = -np.inf
    return value


def _weights(model: Lattice, pieces: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The summed piece weights of each occurrence."""
    byte = pieces >= BYTES
    c = np.where(byte, pieces - BYTES, 0)
    w = np.where(byte, (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)) * model.byte_weight, model.weight[np.where(byte, 0, pieces)])
    total = np.concatenate(([0.0], np.cumsum(w)))
    return total[first[1:]] - total[first[:-1]]


class _Row:
    """The search of one text: its paths so far and the queue of what differs from them."""

    __slots__ = ("found", "key", "paths", "queue", "units")

    def __init__(self, key: int, units: np.ndarray):
        self.key, self.units = key, units
        self.paths: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # pieces, begin of each unit, log p of each unit
        self.found: list[float] = []
        self.queue: list[tuple[float, int, int, int, tuple]] = []


def _siblings(rows: list[_Row], since: list[int], barred: list[tuple], draw: int, k: int, seed: int) -> None:
    """Queue, for each row, what differs from its newest path first at unit ``since`` or later, below that path's key."""
    sizes = np.array([len(r.units) - s for r, s in zip(rows, since, strict=True)], np.int64)
    if not sizes.sum():
        return
    logp = np.concatenate([r.paths[-1][2][s:] for r, s in zip(rows, since, strict=True)])
    head = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    ran = np.cumsum(logp) - logp
    lead = np.array([r.paths[-1][2][:s].sum() for r, s in zip(rows, since, strict=True)])
    before = ran - np.repeat(ran[np.minimum(head, len(ran) - 1)] - lead, sizes)
    gone = np.exp(np.minimum(logp, 0.0))
    for h, b in zip(head, barred, strict=True):
        if b:
            gone[h] += sum(math.exp(lp) for _, lp in b)
    with np.errstate(divide="ignore"):
        rest = np.where(gone < 1 - 1e-9, np.log1p(-np.minimum(gone, 1.0)), -np.inf) + before
    place = np.arange(len(logp)) - np.repeat(head - np.array(since), sizes)
    noise = hashed(seed, 2, np.repeat(np.array([r.key for r in rows], np.int64), sizes), draw, place)
    value = _truncated(rest, np.repeat(np.array([r.found[-1] for r in rows]), sizes), unit_interval(noise))
    for r, h, n, s, b in zip(rows, head, sizes, since, barred, strict=True):
        part = value[h : h + n]
        best = np.argpartition(-part, k)[: k + 1] if n > k + 1 else range(n)
        for i in best:
            if part[i] > -np.inf:
                heapq.heappush(r.queue, (-float(part[i]), len(r.paths) - 1, int(i) + s, draw, b if i == 0 else ()))


def _search(model: Lattice, lat: tuple, rows: list[_Row], k: int, seed: int) -> None:
    """Best-first search of all rows in step: each row's next best node is opened in each round."""
    if not rows:
        return
    roots = -np.log(-np.log(unit_interval(hashed(seed, 1, np.array([r.key for r in rows], np.int64)))))
    for r, g in zip(rows, roots.tolist(), strict=True):
        r.found.append(g)
    _siblings(rows, [0] * len(rows), [()] * len(rows), 0, k, seed)
    for draw in range(1, k):
        open_rows, since, barred, swaps = [], [], [], []
        for r in rows:
            if not r.queue:
                continue
            g, path, i, _, bad = heapq.heappop(r.queue)
            pieces, first, logp = r.paths[path]
            bad = (*bad, (tuple(pieces[first[i] : first[i + 1]].tolist()), float(logp[i])))
            rng = iter(random.Random(f"{seed}/{r.key}/{draw}").random, None)
            swaps.append((path, *_redraw(model, lat, int(r.units[i]), [b for b, _ in bad], rng)))
            open_rows.append(r)
            since.append(i)
            barred.append(bad)
            r.found.append(-g)
        if not open_rows:
            return
        tails = [r.units[i + 1 :] for r, i in zip(open_rows, since, strict=True)]
        sizes = np.array([len(t) for t in tails], np.int64)
        head = np.concatenate(([0], np.cumsum(sizes)))
        key = np.repeat(np.array([r.key for r in open_rows], np.int64), sizes)
        place = np.arange(head[-1]) - np.repeat(head[:-1] - np.array(since) - 1, sizes)
        pieces, first, total = _draw(lat, np.concatenate(tails), key, place, draw, seed)
        logp = _weights(model, pieces, first) - total
        for n, (r, i, (path, swap, lp)) in enumerate(zip(open_rows, since, swaps, strict=True)):
            old, begin, old_lp = r.paths[path]
            a, b = head[n], head[n + 1]
            new = np.concatenate((old[: begin[i]], np.array(swap, np.int64), pieces[first[a] : first[b]]))
            starts = np.concatenate((begin[: i + 1], begin[i] + len(swap) + first[a : b + 1] - first[a]))
            r.paths.append((new, starts, np.concatenate((old_lp[:i], [lp], logp[a:b]))))
        _siblings(open_rows, since, barred, draw, k, seed)


def _spelled(model: Lattice, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the vocabulary for each path, end to end, and where each path begins; characters in bytes are spelled out."""
    flat = np.concatenate([np.zeros(0, np.int64), *paths])
    c = np.where(flat >= BYTES, flat - BYTES, 0)
    size = np.where(flat >= BYTES, 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF), 1)
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.repeat(flat, size)
    for code in np.unique(flat[flat >= BYTES]).tolist():
        spots = at[:-1][flat == code]
        for j, b in enumerate(chr(code - BYTES).encode()):
            out[spots + j] = model.byte_id[b]
    return out, at[np.concatenate(([0], np.cumsum([len(p) for p in paths]))).astype(np.int64)]


def decode_ids(model: Lattice, ids: np.ndarray) -> bytes:
    """The text of ids, with the space that encoding puts in front."""
    size = model.piece_size[ids]
    shift = model.piece_start[ids] - (np.cumsum(size) - size)
    return model.piece_bytes[np.repeat(shift, size) + np.arange(size.sum())].tobytes()


def _texts_of(model: Lattice, ids: np.ndarray, at: np.ndarray) -> Iterator[bytes]:
    """The text of each path of ``_spelled``, decoded some paths at a time."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + TOGETHER, side="right")) - 1)
        some = ids[at[i] : at[j]]
        text, ends = decode_ids(model, some), np.concatenate(([0], np.cumsum(model.piece_size[some])))[at[i : j + 1] - at[i]].tolist()
        yield from (text[a:b] for a, b in pairwise(ends))
        i = j


FULL = "key long, sample int, n_best long, n_pieces long, log_prob double, perturbed double, inclusion double, ids array<int>, ids_sha256 string, decoded boolean"
_FIELDS = pa.schema([("key", pa.int64()), ("sample", pa.int32()), ("n_best", pa.int64()), ("n_pieces", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("inclusion", pa.float64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded", pa.bool_())])


def encode_batch(texts: list[str | None], keys: list[int], k: int, alpha: float, seed: int, path: str = MODEL, with_ids: bool = True) -> pa.RecordBatch:
    """Samples of each text; see ``sample_encodings``."""
    model = lattice(path, alpha)
    cps, starts, firsts = model.units(texts)
    occ, lat = model.known(cps, starts)
    sizes = np.concatenate(([0], np.cumsum(model.best[occ])))
    n_best = (sizes[firsts[1:]] - sizes[firsts[:-1]]).tolist()
    key = np.array([0 if x is None else x for x in keys], np.int64)
    n = np.diff(firsts)
    place = np.arange(len(occ)) - np.repeat(firsts[:-1], n)
    pieces, first, total = _draw(lat, occ, np.repeat(key, n), place, 0, seed)
    logp = _weights(model, pieces, first) - total
    rows = []
    for r, (a, b) in enumerate(zip(firsts[:-1], firsts[1:], strict=True)):
        row = _Row(int(key[r]), occ[a:b])
        row.paths.append((pieces[first[a] : first[b]], first[a : b + 1] - first[a], logp[a:b]))
        rows.append(row)
    _search(model, lat, rows, k, seed)
    ids, at = _spelled(model, [p for r in rows for p, _, _ in r.paths])
    spelled = _texts_of(model, ids, at)
    cols: dict[str, list] = {f.name: [] for f in _FIELDS}
    line = 0
    for r, row in enumerate(rows):
        threshold = -row.queue[0][0] if row.queue else -math.inf
        plain = (" " + texts[r]).encode() if texts[r] else b""
        for s, ((_, _, lp), g) in enumerate(zip(row.paths, row.found, strict=True)):
            own = ids[at[line] : at[line + 1]]
            line += 1
            p = float(lp.sum())
            cols["key"].append(keys[r])
            cols["sample"].append(s)
            cols["n_best"].append(n_best[r])
            cols["n_pieces"].append(len(own))
            cols["log_prob"].append(round(p, 9))
            cols["perturbed"].append(round(g, 9))
            cols["inclusion"].append(1.0 if threshold == -math.inf else round(-math.expm1(-math.exp(min(700.0, p - threshold))), 9))
            cols["ids_sha256"].append(hashlib.sha256(own.astype("<i4").tobytes()).hexdigest())
            cols["decoded"].append(next(spelled) == plain)
    arrays = {f.name: pa.array(cols[f.name], f.type) for f in _FIELDS if f.name != "ids"}
    lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
    arrays["ids"] = lists if with_ids else pa.nulls(line, _FIELDS.field("ids").type)
    return pa.RecordBatch.from_arrays([arrays[f.name] for f in _FIELDS], schema=_FIELDS)


def _runner(k: int, alpha: float, seed: int, path: str, rows: int, with_ids: bool, carry: tuple[str, ...] = ()) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, start = 0, 0
            lengths = [len(x.as_buffer()) if x.is_valid else 0 for x in batch.column("text")]
            for i, n in enumerate(lengths):
                size += n
                if i + 1 == len(lengths) or i + 1 - start >= rows or size >= rows * 2000:
                    part = batch.slice(start, i + 1 - start)
                    out = encode_batch(part.column("text").to_pylist(), part.column("key").to_pylist(), k, alpha, seed, path, with_ids)
                    if carry:
                        row = pa.array(np.cumsum(out.column("sample").to_numpy() == 0) - 1)  # each row has a sample 0, its first
                        out = pa.RecordBatch.from_arrays([*out.columns, *(part.column(c).take(row) for c in carry)], [*out.schema.names, *carry])
                    yield out
                    size, start = 0, i + 1

    return run


def sample_encodings(docs: DataFrame, key: str = "doc_id", k: int = 2, alpha: float = 0.3, seed: int = 0, path: str = MODEL, rows: int = 750, with_ids: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Up to k rows for each row of ``docs`` (``key``, text): key, sample, n_best, n_pieces, log_prob,
    perturbed, inclusion, ids, ids_sha256, decoded.

    n_best is the length of the model's own (best) encoding. decoded tells whether the ids decode to
    the text; a text that holds the space mark U+2581 itself decodes to a space there, so it is false. A null or empty text has one sample, the empty one, of log probability 0 and inclusion 1.
    A text with fewer than k segmentations has all of them, with inclusion 1. Rows that repeat a key
    and text get the same samples; a null key draws like key 0. Scores are rounded to 9 places. Columns named
    in ``carry`` come after the others, the rows stay in their order; further columns are ignored.
    """
    src = docs.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text"), *carry)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    out = src.mapInArrow(_runner(k, alpha, seed, path, rows, with_ids, carry), FULL + kinds)
    return out.withColumnRenamed("key", key)
