"""The difference cover and the order it gives, against sorting the bytes themselves."""

import numpy as np
import pytest

from quire.llm.difference_cover import cover, repeated, sample_ranks, sort_suffixes


@pytest.mark.parametrize("v", [8, 32, 64])
def test_every_pair_of_residues_has_a_shift(v):
    mask, shift = cover(v)
    for i in range(v):
        for j in range(v):
            assert mask[(i + shift[i, j]) % v] and mask[(j + shift[i, j]) % v]
    assert mask.sum() < 3 * v**0.5


def _texts():
    r = np.random.default_rng(3)
    base = r.integers(97, 100, 300, dtype=np.uint8)
    yield np.concatenate([base, r.integers(97, 123, 50, dtype=np.uint8), base[40:], base[:260]])
    yield np.zeros(700, np.uint8)
    yield np.tile(np.frombuffer(b"abcab", np.uint8), 150)
    yield r.integers(0, 256, 600, dtype=np.uint8)


@pytest.mark.parametrize("data", list(_texts()))
@pytest.mark.parametrize("depth", [40, 200])
def test_classes_are_neighbours_in_byte_order(data, depth):
    starts = np.arange(len(data) - depth + 1)
    got = [data[i : i + depth].tobytes() for i in sort_suffixes(data, starts, depth)]
    assert got == sorted(got)
    counts = {x: got.count(x) for x in set(got)}
    want = [i for i in starts if counts[data[i : i + depth].tobytes()] > 1]
    assert sorted(repeated(data, starts, depth)) == want


def test_sample_ranks_follow_the_bytes():
    data = next(_texts())
    rank = sample_ranks(data, 64)
    at = np.flatnonzero(rank >= 0)
    by_rank = at[np.argsort(rank[at], kind="stable")]
    strings = [data[i : i + 64].tobytes().ljust(64, b"\0") for i in by_rank]
    assert strings == sorted(strings)


def test_small_inputs():
    none = np.empty(0, np.int64)
    assert not len(repeated(np.zeros(300, np.uint8), none, 200))
    assert not len(repeated(np.zeros(300, np.uint8), np.array([4]), 200))
    assert sorted(repeated(np.zeros(300, np.uint8), np.array([4, 9]), 200)) == [4, 9]
