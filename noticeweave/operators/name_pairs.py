"""Pairs of alike names within one cell: maps of bits rule out nearly all pairs, the others are scored on their bigrams."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: What ``text.dice`` gives at least where the shorter text of six characters or more, so five bigrams, lies in the other.
WITHIN, WITHIN_LEAST = 0.85, 5
#: Pairs that are looked at in one step, so that they stay in a core's cache, and pairs that are scored at a time.
TILE, SCORED = 100_000, 100_000


def numbered_bigrams(names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """``(row, token, bound)`` by row and token of names of two or more characters; the k-th copy of a bigram is a token of its own."""
    signs = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(names)), [len(x) for x in names])
    inside = row[1:] == row[:-1]
    kinds, gram = np.unique((signs[:-1] << 21 | signs[1:])[inside], return_inverse=True)
    key = np.sort(row[1:][inside] * len(kinds) + gram)
    at = np.arange(len(key))
    copy = at - np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0))
    copies = int(copy.max()) + 1
    return key // len(kinds), key % len(kinds) * copies + copy, len(kinds) * copies


class Names:
    """Names as sets of tokens, smaller sets first.

    Each has a map of 64 bits (``short``) and one of 256 (``bits``); bits in which two maps differ stem from tokens that only one set has.
    """

    def __init__(self, text: list[str], row: np.ndarray, tok: np.ndarray, bound: int):
        self.text, self.tok, self.bound, self.key = text, tok, bound, row * bound + tok
        self.size = np.bincount(row, minlength=len(text))
        self.begins = np.cumsum(self.size) - self.size
        h = tok.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.short = np.bitwise_or.reduceat(np.uint64(1) << (h >> np.uint64(58)), self.begins)
        word, bit = h >> np.uint64(32) & np.uint64(3), np.uint64(1) << (h >> np.uint64(40) & np.uint64(63))
        self.bits = np.stack([np.bitwise_or.reduceat(np.where(word == w, bit, np.uint64(0)), self.begins) for w in range(4)], axis=1)


def maybe_alike(x: Names, y: Names, rows: np.ndarray, cols: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``rows`` of x and ``cols`` of y, both by size, that may reach a Dice of ``t`` or lie in each other."""
    ratio, sizes, short = t / (2 - t), y.size[cols], y.short[cols]
    edges = np.append(np.nonzero(np.diff(x.size[rows], prepend=-1))[0], len(rows))
    for first, last in zip(edges[:-1], edges[1:]):
        size = int(x.size[rows[first]])
        # Partners of about this size differ in few tokens; of two others, the smaller one must lie in the other.
        lo = int(np.searchsorted(sizes, size * ratio - 1e-9))
        hi = int(np.searchsorted(sizes, size / ratio + 1e-9, side="right")) if ratio > 0 else len(cols)
        parts = [("near", lo, hi)]
        if t <= WITHIN:
            parts += [("smaller", int(np.searchsorted(sizes, WITHIN_LEAST)), lo), ("larger", hi, len(cols) if size >= WITHIN_LEAST else hi)]
        for kind, a, b in parts:
            if a >= b:
                continue
            apart = np.floor((1 - t) * (size + sizes[a:b]) + 1e-9).astype(np.int64)
            most, step = np.clip(apart, 0, 64).astype(np.uint8), max(1, TILE // (b - a))
            for i in range(first, last, step):
                one, other = x.short[rows[i : min(i + step, last)], None], short[None, a:b]
                if kind == "near":
                    ok = np.bitwise_count(one ^ other) <= most
                else:
                    ok = (other & ~one if kind == "smaller" else one & ~other) == 0
                k, j = np.divmod(np.flatnonzero(ok), b - a)
                p, q = rows[i + k], cols[a + j]
                if kind == "near":
                    ok = np.bitwise_count(x.bits[p] ^ y.bits[q]).sum(axis=1, dtype=np.int64) <= apart[j]
                else:
                    ok = ((y.bits[q] & ~x.bits[p] if kind == "smaller" else x.bits[p] & ~y.bits[q]) == 0).all(axis=1)
                yield p[ok], q[ok]


def scores(x: Names, y: Names, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``text.dice`` of pairs of names."""
    n = x.size[p]
    begins = np.cumsum(n) - n
    own = np.arange(int(n.sum())) + np.repeat(x.begins[p] - begins, n)
    want = np.repeat(q, n) * y.bound + x.tok[own]
    found = y.key[np.minimum(np.searchsorted(y.key, want), len(y.key) - 1)] == want
    shared = np.add.reduceat(found.astype(np.int64), begins)
    score, least = 2 * shared / (n + y.size[q]), np.minimum(n, y.size[q])
    for i in np.nonzero((shared == least) & (least >= WITHIN_LEAST) & (score < WITHIN))[0]:
        a, b = x.text[p[i]], y.text[q[i]]
        if a in b or b in a:
            score[i] = WITHIN
    return score


def _by_agency(agency: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The agencies in order, the rows of one after those of another, and where each agency's rows begin."""
    kinds = sorted(set(agency))
    at = {a: i for i, a in enumerate(kinds)}
    code = np.array([at[a] for a in agency])
    return kinds, np.argsort(code, kind="stable"), np.append(0, np.cumsum(np.bincount(code, minlength=len(kinds))))


def related(ax: list[str], ay: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of both sides, in their order, whose agencies begin with each other; every related pair of rows is met once."""
    kx, ox, ex = _by_agency(ax)
    ky, oy, ey = _by_agency(ay)

    def below(kinds: list[str], agency: str) -> tuple[int, int]:
        first = bisect_left(kinds, agency)
        return first, bisect_left(kinds, True, first, key=lambda k: not k.startswith(agency))

    for i, agency in enumerate(kx):
        first, last = below(ky, agency)
        if first < last:
            yield ox[ex[i] : ex[i + 1]], np.sort(oy[ey[first] : ey[last]])
    for i, agency in enumerate(ky):
        first, last = below(kx, agency)
        first += first < last and kx[first] == agency
        if first < last:
            yield np.sort(ox[ex[first] : ex[last]]), oy[ey[i] : ey[i + 1]]


def similar_in_cell(t: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of two tables with ``node, agency, name`` the pairs ``(a, b, score)`` of names of related agencies with a score of at least ``t``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
        sides = []
        for side in (left, right):
            text = side["name"].to_pylist()
            order = sorted(range(len(text)), key=lambda i: len(text[i]))
            agency = side["agency"].to_pylist()
            sides.append((side["node"].take(pa.array(order, pa.int64())), [agency[i] for i in order], [text[i] for i in order]))
        (left_nodes, ax, nx), (right_nodes, ay, ny) = sides
        if nx and ny:
            row, tok, bound = numbered_bigrams(nx + ny)
            cut = int(np.searchsorted(row, len(nx)))
            x, y = Names(nx, row[:cut], tok[:cut], bound), Names(ny, row[cut:] - len(nx), tok[cut:], bound)
            wait: list[tuple[np.ndarray, np.ndarray]] = []

            def score(least: int) -> None:
                if sum(len(p) for p, _ in wait) >= least:
                    p, q = (np.concatenate(c) for c in zip(*wait))
                    wait.clear()
                    for i in range(0, len(p), SCORED):
                        s = scores(x, y, p[i : i + SCORED], q[i : i + SCORED])
                        ok = (s >= t) & (s > 0)
                        found.append((p[i : i + SCORED][ok], q[i : i + SCORED][ok], s[ok]))

            for rows, cols in related(ax, ay):
                for pair in maybe_alike(x, y, rows, cols, t):
                    wait.append(pair)
                    if len(wait) % 16 == 0:
                        score(SCORED)
            score(1)
        p, q, s = (np.concatenate(c) for c in zip(*found))
        return pa.table({"a": left_nodes.take(pa.array(p)), "b": right_nodes.take(pa.array(q)), "score": pa.array(s, pa.float64())})

    return run
