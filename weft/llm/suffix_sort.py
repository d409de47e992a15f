"""Suffixes in order by hashes: merge sort whose comparisons find the common extension by binary search.

``H[j] - H[i]`` of a prefix polynomial gives the hash of any span at once, so that the longest common prefix of two
suffixes takes about log2(width) comparisons of hashes, and their order one more byte.  All groups are merged at the
same time, level by level.  The order is verified on the bytes, neighbour by neighbour; if it ever fails, the bytes decide.
"""

from __future__ import annotations

import numpy as np

from weft.llm.textblock import BLOCK_BYTES, equal_spans

#: A random odd 64-bit value for each byte, and the base of the prefix polynomial with its inverse mod 2**64.
BYTE_CODE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, kept for the next call unless the text was unusually long."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[k] * BASE**k for i <= k < j."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


class Suffixes:
    def __init__(self, text: np.ndarray, width: int):
        """Suffixes are compared on their first ``width`` bytes, which the text must have."""
        self.text, self.width = text, width
        self.prefix = prefix_hash(BYTE_CODE[text])
        self.scale = powers(INVERSE, len(self.prefix))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length of the longest common prefix of suffixes a and b, up to the width."""
        low, high = np.zeros(len(a), dtype=np.int64), np.full(len(a), self.width)
        prefix, of_a, of_b, by_a, by_b = self.prefix, self.prefix[a], self.prefix[b], self.scale[a], self.scale[b]
        for _ in range(self.width.bit_length()):
            middle = (low + high + 1) >> 1
            equal = (prefix[a + middle] - of_a) * by_a == (prefix[b + middle] - of_b) * by_b
            low = np.where(equal, middle, low)
            high = np.where(equal, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether a's suffix comes before b's, or where or_equal is set, isn't after it."""
        common = self.common(a, b)
        at = np.minimum(common, self.width - 1)
        return np.where(common == self.width, or_equal, self.text[a + at] < self.text[b + at])

    def sort(self, suffix: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The suffixes sorted within groups; start and size are of each entry's group, whose entries stand together."""
        order, run = suffix.copy(), 1
        most = int(size.max(initial=0))
        while run < most:
            place = np.flatnonzero(size > run)
            rank = place - start[place]
            base = rank // (2 * run) * (2 * run)
            right = rank - base >= run
            other = np.where(right, start[place] + base, start[place] + base + run)
            room = np.where(right, run, np.clip(size[place] - base - run, 0, run))
            x = order[place]
            low, high = np.zeros(len(place), dtype=np.int64), room.copy()
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) >> 1
                less = self.before(order[other[open_] + middle], x[open_], right[open_])
                low[open_] = np.where(less, middle + 1, low[open_])
                high[open_] = np.where(less, high[open_], middle)
            order[start[place] + base + rank - base - np.where(right, run, 0) + low] = x
            run *= 2
        return order

    def steps(self, order: np.ndarray, together: np.ndarray) -> np.ndarray:
        """For each entry but the last, -1, 0 or 1 as its suffix is before, equal to or after the next one's, on the bytes;
        looked at where ``together`` is set, else -1."""
        out = np.full(max(len(order) - 1, 0), -1)
        pair = np.flatnonzero(together)
        a, b = order[pair], order[pair + 1]
        common = self.common(a, b)
        # The hashes' answer is taken as a claim: the bytes must agree up to there, and differ next.
        right = equal_spans(self.text, a, b, common)
        at = np.minimum(common, self.width - 1)
        x, y = self.text[a + at], self.text[b + at]
        out[pair] = np.where(common == self.width, 0, np.where(x < y, -1, 1))
        if not (right & ((common == self.width) | (x != y))).all():
            raise HashCollision
        return out


class HashCollision(Exception):
    """Two different spans had the same hash."""


def equal_classes(text: np.ndarray, width: int, suffix: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for each suffix, the same for those in the same group that agree on ``width`` bytes. ``group`` ascends.

    The order that the hashes gave is checked on the bytes between all neighbours; if a collision ever put it wrong, the
    bytes alone decide.
    """
    n = len(suffix)
    if not n:
        return np.zeros(0, dtype=np.int64)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(edge, n))
    place = np.empty(len(text) + 1, dtype=np.int64)
    try:
        found = Suffixes(text, width)
        order = found.sort(suffix, np.repeat(edge, sizes), np.repeat(sizes, sizes))
        step = found.steps(order, group[1:] == group[:-1])
        if (step > 0).any():
            raise HashCollision
        differ = step < 0
    except HashCollision:
        rows = np.lexsort([*(text[suffix + k] for k in range(width - 1, -1, -1)), group])
        order = suffix[rows]
        differ = (text[order[1:, None] + np.arange(width)] != text[order[:-1, None] + np.arange(width)]).any(axis=1) | (group[rows][1:] != group[rows][:-1])
    place[order] = np.concatenate([[0], np.cumsum(differ)])  # a suffix is in one group only
    return place[suffix]
