"""Rolling hashes and content-chosen anchors over the bytes of a text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_B = 0x9E3779B97F4A7C15 | 1
_B_INVERSE = pow(_B, -1, 1 << 64)


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            m = 1 << (n - 1).bit_length()
            for name, base in (("up", _B), ("down", _B_INVERSE)):
                step = np.full(m, np.uint64(base))
                step[0] = 1
                setattr(cls, name, np.multiply.accumulate(step))
        return cls.up[:n], cls.down[:n]


class Rolling:
    """Hashes of any substring of data, each in constant time."""

    def __init__(self, data: np.ndarray):
        up, self._down = _Powers.get(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_byte_values()[data] * up[: len(data)], out=self._sums[1:])

    def every(self, length: int) -> np.ndarray:
        """The hash of each substring of that length."""
        n = len(self._sums) - length
        h = (self._sums[length:] - self._sums[:n]) * self._down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hashes of the substrings from start to end."""
        h = (self._sums[end] - self._sums[start]) * self._down[start]
        h = h + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: one pass forwards and one back over blocks of that width."""
    n = len(x)
    blocks = -(-n // width)
    pad = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    pad = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(r: Rolling, n: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each window's anchor is its gram of least hash, the first of equals. Runs of windows with one anchor:
    (place of the anchor, first window, last window, hash of the gram)."""
    if n < window:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, np.uint64)
    h = r.every(gram)
    bits = np.uint64(max(1, (n - 1).bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    least = sliding_min(key, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))
    at = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([at[1:] - 1, [len(least) - 1]])
    place = least[at].astype(np.int64)
    return place, at, last, h[place]
