"""Whole texts as flat byte arrays: words, hashes and digests for many documents at once.

Everything here works on the UTF-8 bytes of a block of documents laid end to end, without a Python loop per word or
byte.  A null text is an empty text.  Blocks are cut between documents only, so that no text is ever split; a block
holds about ``BLOCK_BYTES`` or one longer document.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: The first k bytes of a little-endian number of 8.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_TIMES, _SEED, _SIZE = np.uint64(0x9E3779B97F4A7C15), 0xD1B54A32D192ED03, np.uint64(0x8BB84B93962EACC9)
#: Longer spans are hashed, and compared, one by one.
_LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one), which maps no two numbers to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def salt(k: int) -> np.uint64:
    return np.uint64(_SEED * (k + 1) & (1 << 64) - 1)


def absorb(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A step of a hash: different values give different states, and the product's high bits come back to the low ones, so
    that no structure of a sequence cancels out as it does in a polynomial."""
    state = (state ^ value) * _TIMES
    state ^= state >> np.uint64(32)
    return state


def eights(data: np.ndarray) -> np.ndarray:
    """The little-endian number of the 8 bytes from each place on, and one more; beyond the end are zeros. A view."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each data[start:end]. Spans of up to 7 bytes have the same only if they are equal."""
    x, size = eights(data), end - start
    code = x[start] & _FIRST[np.minimum(size, 8)]
    code = np.where(size < 8, code | size.astype(np.uint64) << np.uint64(56), code + (size.astype(np.uint64) + np.uint64(1)) * _SIZE)
    code = mix(code ^ salt(seed))
    left, at = np.flatnonzero(size > 8), 8
    while len(left) and at < _LONG:
        code[left] = absorb(code[left], x[start[left] + at] & _FIRST[np.minimum(size[left] - at, 8)])
        at += 8
        left = left[size[left] > at]
    for i in left.tolist():
        code[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), seed))
    long = size > 8
    code[long] = mix(code[long])
    return code


def sequence_codes(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each values[start:end], in as many steps as the longest has values."""
    size = end - start
    code = mix(size.astype(np.uint64) + salt(seed))
    left, at = np.flatnonzero(size > 0), 0
    while len(left):
        code[left] = absorb(code[left], values[start[left] + at])
        at += 1
        left = left[size[left] > at]
    return mix(code)


def equal_spans(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] is data[b : b + size], byte by byte."""
    x, out = eights(data), np.ones(len(a), dtype=bool)
    left, at = np.flatnonzero((a != b) & (size > 0)), 0
    while len(left) and at < _LONG:
        first = _FIRST[np.minimum(size[left] - at, 8)]
        out[left] = (x[a[left] + at] & first) == (x[b[left] + at] & first)
        at += 8
        left = left[out[left] & (size[left] > at)]
    for i in left.tolist():
        out[i] = np.array_equal(data[a[i] : a[i] + size[i]], data[b[i] : b[i] + size[i]])
    return out


def equal_sequences(values: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether values[a : a + size] is values[b : b + size]."""
    out, left, at = np.ones(len(a), dtype=bool), np.flatnonzero((a != b) & (size > 0)), 0
    while len(left):
        out[left] = values[a[left] + at] == values[b[left] + at]
        at += 1
        left = left[out[left] & (size[left] > at)]
    return out


def verified_classes(keys: tuple[np.ndarray, ...], same, content) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by equal content: an order, the place in it where each class starts, and each entry's class.

    Entries of a class have equal keys, by the first of which they are in order. ``same(i, j)`` compares pairs of entries
    with equal keys; where it ever finds a difference, ``content(i)`` tells all that share the keys apart.
    """
    n = len(keys[0])
    order = np.lexsort(keys[::-1])
    new = np.ones(n, dtype=bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    pair = np.flatnonzero(~new[1:])
    bad = pair[~same(order[pair], order[pair + 1])] if len(pair) else pair
    if len(bad):
        start = np.append(np.flatnonzero(new), n)
        for g in np.unique(np.searchsorted(start, bad, side="right") - 1).tolist():
            mine = sorted((content(i), i) for i in order[start[g] : start[g + 1]].tolist())
            order[start[g] : start[g + 1]] = [i for _, i in mine]
            new[start[g] + 1 : start[g + 1]] = [x[0] != y[0] for x, y in zip(mine[1:], mine, strict=False)]
    number = np.empty(n, dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that aren't white space; no run crosses documents."""
    n = len(data)
    solid = ~SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | first[:n]))
    after = np.zeros(n, dtype=bool)
    after[: n - 1] = solid[1:]
    return start, np.flatnonzero(solid & (~after | first[1:])) + 1


class Block:
    """Documents laid end to end. ``bounds[i]:bounds[i+1]`` are the bytes of document i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, self.n = data, bounds.astype(np.int64), len(bounds) - 1
        self._words: tuple | None = None
        self._numbers: np.ndarray | None = None

    @classmethod
    def of(cls, texts: pa.Array) -> "Block":
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        if texts.null_count:
            texts = texts.fill_null("")
        _, offsets, data = texts.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        flat = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        return cls(flat, bounds - bounds[0])

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    @property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end (bytes), hash of each word, and the index of each document's first word (n + 1 entries)."""
        if self._words is None:
            start, end, code = self.spans(word_bounds)
            self._words = start, end, code, np.searchsorted(start, self.bounds)
        return self._words

    def spans(self, find) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and hash of what ``find(data, bounds)`` finds, looked for in some documents at a time."""
        parts, at = [], 0
        while at < self.n:
            to = int(np.searchsorted(self.bounds, self.bounds[at] + BLOCK_BYTES, side="right")) - 1
            to = min(max(to, at + 1), self.n)
            base = self.bounds[at]
            data = self.data[base : self.bounds[to]]
            start, end = find(data, self.bounds[at : to + 1] - base)
            parts.append((start + base, end + base, span_codes(data, start, end)))
            at = to
        return tuple(np.concatenate([p[k] for p in parts] or [np.zeros(0, (np.int64, np.int64, np.uint64)[k])]) for k in range(3))

    @property
    def numbers(self) -> np.ndarray:
        """The number of each word among the block's distinct words."""
        if self._numbers is None:
            self._numbers = self.distinct(*self.words[:3])[0]
        return self._numbers

    def distinct(self, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each span among the distinct ones, and where each of these comes first; compared byte by byte."""
        number, seen = pd.factorize(code)
        first = np.zeros(len(seen), dtype=np.int64)
        first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
        size, one = end - start, first[number]
        long = np.flatnonzero((size > 7) | (size[one] > 7))
        if (size[long] == size[one[long]]).all() and equal_spans(self.data, start[long], start[one[long]], size[long]).all():
            return number, first
        raw = self.data.tobytes()
        number, _ = pd.factorize(np.array([raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)], dtype=object))
        first = np.zeros(int(number.max()) + 1, dtype=np.int64)
        first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
        return number, first

    def split(self, size: int = BLOCK_BYTES):
        """Blocks of some of the documents, with their words."""
        start, end, code, first = self.words
        at = 0
        while at < self.n:
            to = int(np.searchsorted(self.bounds, self.bounds[at] + size, side="right")) - 1
            to = min(max(to, at + 1), self.n)
            base, a, z = self.bounds[at], first[at], first[to]
            part = Block(self.data[base : self.bounds[to]], self.bounds[at : to + 1] - base)
            part._words = start[a:z] - base, end[a:z] - base, code[a:z], first[at : to + 1] - a
            yield part
            at = to

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many set flags (one for each byte) each document has."""
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def blocks(batches, column: str = "text", size: int = BLOCK_BYTES):
    """(rows, Block of their texts) for about ``size`` bytes of text at a time: batches are gathered, or cut, for that."""
    waiting, held = [], 0
    for batch in batches:
        texts = batch.column(column)
        if held and held + texts.nbytes > size:
            yield from _cut(waiting, column, size)
            waiting, held = [], 0
        waiting.append(batch)
        held += texts.nbytes
    yield from _cut(waiting, column, size)
    waiting.clear()
    give_back()


def give_back() -> None:
    """Free memory goes back to the system: a worker keeps waiting for its next task with what it holds."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def _cut(batches: list[pa.RecordBatch], column: str, size: int):
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    batch = batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    whole = Block.of(batch.column(column))
    at, bounds = 0, whole.bounds
    while at < whole.n:
        to = int(np.searchsorted(bounds, bounds[at] + size, side="right")) - 1
        to = min(max(to, at + 1), whole.n)
        yield batch.slice(at, to - at), Block(whole.data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to


def window_codes(code: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` codes, by doubling; entry i stands for codes i .. i+width-1. Ignores document bounds."""
    if len(code) < width:
        return np.zeros(0, dtype=np.uint64)
    out, span = mix(code + salt(width)), 1
    while span < width:
        step = min(span, width - span)  # the last two spans may overlap
        out = mix(out[:-step] * _TIMES + out[step:])
        span += step
    return out


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """For each word, whether a window of ``width`` words of the same document starts there."""
    n = int(first[-1])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return left >= width


def covered(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of n places are covered by [s, s + width) for some s in starts (no end goes beyond n)."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, starts, 1) if len(starts) < 64 else step.__iadd__(np.bincount(starts, minlength=n + 1))
    np.subtract.at(step, starts + width, 1) if len(starts) < 64 else step.__isub__(np.bincount(starts + width, minlength=n + 1))
    return np.cumsum(step[:n]) > 0
