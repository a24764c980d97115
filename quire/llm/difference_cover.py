"""Order of the suffixes of a block of bytes, with ties resolved by a difference cover.

A cover of period v holds residues such that for any two positions i and j some shift
below v takes both into it. The suffixes that start at covered positions are ranked
first, by doubling: a covered position stays covered v further on. Any two suffixes
are then compared by their first v bytes and, if these tie, by the ranks at their
common shift. Memory is that of the block, whatever the length of the ties.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

PERIOD = 32


@lru_cache(maxsize=4)
def cover(v: int) -> tuple[np.ndarray, np.ndarray]:
    """(covered residues as a mask, shift[i mod v, j mod v]); residues are added while one gives new differences, that with most of them first."""
    chosen, met = [0], {0}
    while len(met) < v:
        new = lambda x: {d for c in (*chosen, x) for d in ((x - c) % v, (c - x) % v)} - met
        best = max((x for x in range(v) if x not in chosen), key=lambda x: (len(new(x)), -x))
        met |= new(best)
        chosen.append(best)
    mask = np.zeros(v, bool)
    mask[chosen] = True
    i, j, k = np.ogrid[:v, :v, :v]
    return mask, np.argmax(mask[(i + k) % v] & mask[(j + k) % v], axis=2)


def _words(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The n bytes from each place on, as numbers in the order of the bytes."""
    padded = np.concatenate([data, np.zeros(n + 8, np.uint8)])
    every = np.lib.stride_tricks.sliding_window_view(padded, 8)
    return [np.ascontiguousarray(every[at + k]).view(">u8").ravel().astype(np.uint64) for k in range(0, n, 8)]


def _dense(order: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Number of the class of each row, classes by equality in all columns, in the given order."""
    new = np.zeros(len(order), bool)
    for c in columns:
        x = c[order]
        new[1:] |= x[1:] != x[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(data: np.ndarray, depth: int, v: int = PERIOD) -> np.ndarray:
    """At each covered position, the rank of what starts there by `depth` bytes at least; -1 elsewhere. Past the end are zeros."""
    mask, _ = cover(v)
    at = np.flatnonzero(mask[np.arange(len(data)) % v])
    w = _words(data, at, v)
    rank = np.full(len(data) + depth * 2 + v, -1, np.int64)
    rank[at] = _dense(np.lexsort(w[::-1]), w)
    reach = v
    while reach < depth:
        pair = (rank[at] << 32) | (rank[at + reach] + 1)
        rank[at] = _dense(np.argsort(pair, kind="stable"), [pair])
        reach *= 2
    return rank


def sort_suffixes(data: np.ndarray, starts: np.ndarray, depth: int, v: int = PERIOD) -> np.ndarray:
    """`starts` in an order where those that agree in `depth` bytes are neighbours.

    By the first v bytes, then, all ties at once, by quicksort on the ranks: each tie's first
    suffix divides it into lesser, equal and greater ones. Beyond `depth` the order is arbitrary.
    """
    if len(starts) < 2:
        return starts
    _, shift = cover(v)
    rank = sample_ranks(data, depth, v)
    w = _words(data, starts, v)
    order = np.lexsort(w[::-1])
    tie = _dense(order, w)[order]
    place, done = starts[order], np.zeros(len(order), bool)
    while True:
        edge = np.flatnonzero(np.concatenate([[True], tie[1:] != tie[:-1]]))
        size = np.diff(np.append(edge, len(tie)))
        open_ = np.flatnonzero(np.repeat(size > 1, size) & ~done)
        if not len(open_):
            return place
        pivot = place[np.repeat(edge, size)[open_]]
        mine = place[open_]
        k = shift[mine % v, pivot % v]
        side = np.sign(rank[mine + k] - rank[pivot + k])
        again = np.lexsort((side, tie[open_]))
        place[open_] = mine[again]
        side = side[again]
        done[open_] = side == 0
        # Thirds of one tie become ties of their own; their numbers keep the order.
        tie *= 3
        tie[open_] += side + 1
        tie = np.cumsum(np.concatenate([[0], tie[1:] != tie[:-1]]))


def repeated(data: np.ndarray, starts: np.ndarray, depth: int, v: int = PERIOD) -> np.ndarray:
    """Those of `starts` whose `depth` bytes start at another of them too; neighbours in the order are compared byte by byte."""
    place = sort_suffixes(data, starts, depth, v)
    if len(place) < 2:
        return place[:0]
    same = np.ones(len(place) - 1, bool)
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    # Eight bytes a step; the last step ends at depth.
    for k in dict.fromkeys([*range(0, depth - 7, 8), depth - 8]):
        live = np.flatnonzero(same)
        x = np.ascontiguousarray(windows[place + k]).view(np.uint64).ravel()
        same[live] = x[live] == x[live + 1]
    hit = np.zeros(len(place), bool)
    hit[1:] |= same
    hit[:-1] |= same
    return place[hit]
