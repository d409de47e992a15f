"""Word-level deduplication by recompression: words covered by a 35-word window that also starts anywhere else.

Rounds rewrite every document's words: first runs of one symbol get a name, then pairs of a left and a right symbol.
A name is a fingerprint of what it stands for, and a symbol's side is a bit of its name, so that naming is the same in
every partition and needs no exchange, and equal word sequences get equal symbols inside.  At the ends of a window a
round may use words outside it; what a window alone determines is tracked exactly, and with the number of rounds
chosen something always is, but beside runs of one word, where the window itself serves as its symbol.

A window's anchor is the least, by a hash, of the groups of three neighbours among its determined high-level symbols (of
single symbols where there are fewer).  Anchors that two windows share reveal repeats; the windows under them are then
verified on their words (:mod:`weft.llm.repeats`).

Defined results.  A null text has no words.  Texts of fewer than 35 words keep everything; texts of any length are
read whole.  Every occurrence of a repeated window is removed, the first too, also within one document and in repeated
rows.  A null doc_id is a document like any other.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.repeats import Runs, find, groups
from weft.llm.textblock import Block, absorb, covered, equal_sequences, mix, verified_classes, window_codes, window_starts

_RUN, _PAIR, _SIDE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def rounds_for(width: int) -> int:
    """The most rounds after which a window of ``width`` words still determines a symbol where no word repeats at once.

    A round takes at most two symbols from each end, and its symbols stand for at most 2**round words.
    """
    n = 0
    while width - 4 * ((2 << n) - 1) > 0:
        n += 1
    return n


def name_runs(symbol: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names after runs of one symbol are named, their documents, and each symbol's run."""
    head = np.ones(len(symbol), dtype=bool)
    head[1:] = (symbol[1:] != symbol[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(symbol)))
    name = symbol[at]
    name = np.where(length > 1, mix(name + length.astype(np.uint64) * _RUN), name)
    return name, doc[at], np.cumsum(head) - 1


def name_pairs(symbol: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names after left-right pairs are named, their documents, each symbol's new place, and which were left symbols."""
    left = (mix(symbol ^ mix(np.array([k + 1], dtype=np.uint64))) & np.uint64(1)) == 0
    second = np.zeros(len(symbol), dtype=bool)
    second[1:] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
    at = np.flatnonzero(~second)
    paired = np.append(second, False)[at + 1]
    name = symbol[at]
    name[paired] = mix(mix(name[paired] + _PAIR) + symbol[at[paired] + 1])
    return name, doc[at], np.cumsum(~second) - 1, left


def _least(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(key[low:high]) for each pair, none of them empty."""
    level, out, size = key, np.empty(len(low), dtype=np.uint64), high - low
    width = 1
    while len(low):
        mine = np.flatnonzero((size >= width) & (size < 2 * width))
        out[mine] = np.minimum(level[low[mine]], level[high[mine] - width])
        if size.max(initial=0) < 2 * width:
            break
        level = np.minimum(level[:-width], level[width:])
        width *= 2
    return out


class WordWindows:
    def __init__(self, width: int = 35, symbols: int = 3):
        self.width, self.rounds, self.symbols = width, rounds_for(width), symbols

    def ids(self, rows) -> np.ndarray:
        return np.zeros(rows.num_rows, dtype=np.int64)

    def runs(self, block: Block, _) -> Runs:
        _, _, code, first = block.words
        width, n = self.width, len(code)
        start = np.flatnonzero(window_starts(first, width))
        if not len(start):
            return Runs(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64)))
        words_of = np.repeat(np.arange(block.n), np.diff(first))
        symbol, doc, begin = code, words_of, np.arange(n)
        # For each window, its first determined symbol and the one after its last.
        low, high = start, start + width
        for k in range(self.rounds):
            symbol, doc, run = name_runs(symbol, doc)
            low, high = run[np.minimum(low, len(run) - 1)] + 1, run[high - 1]  # runs at the ends may go on outside
            begin = begin[np.flatnonzero(np.diff(run, prepend=-1))]
            symbol, doc, place, left = name_pairs(symbol, doc, k)
            begin = begin[np.flatnonzero(np.diff(place, prepend=-1))]
            some = low < high
            at = np.minimum(low, len(place) - 1)
            low = np.where(left[at], place[at], place[np.minimum(at + 1, len(place) - 1)])
            last = np.maximum(high - 1, 0)
            high = np.where(left[last], place[last], place[last] + 1)
            low, high = np.where(some, low, 0), np.where(some, np.maximum(high, 0), 0)
            if not some.all():
                lost = ~some
                low[lost], high[lost] = 1, 1  # stays empty: the next round only moves low up and high down
        some = low < high
        name, anchor = np.empty(len(start), dtype=np.uint64), np.empty(len(start), dtype=np.int64)
        many = high - low >= self.symbols
        for n_symbols, mine in ((self.symbols, some & many), (1, some & ~many)):
            gram = window_codes(symbol, n_symbols)
            key = (mix(gram) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
            best = (_least(key, low[mine], high[mine] - n_symbols + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            # Not the hash that was minimised, whose small values would crowd the first buckets.
            name[mine], anchor[mine] = mix(gram[best] + _SIDE), begin[best]
        print_ = self.prints(block)
        name[~some] = mix(print_[start[~some]])
        anchor[~some] = -1 - start[~some]  # a window of its own
        edge = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (name[1:] != name[:-1])]))
        a, z = start[edge], start[np.append(edge[1:], len(start)) - 1] + 1
        offset = np.where(anchor[edge] < 0, 0, anchor[edge] - a)
        # The first and the last window of a run have all its words, since both have the anchor.
        content = absorb(absorb(mix(print_[a]), print_[z - 1]), ((z - a) * 4096 + offset).astype(np.uint64))
        return Runs(name[edge] & ~np.uint64(1), words_of[a], a, z, offset, content)

    def window_names(self, block: Block, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A name for each window by its words alone, and a key that tells it from others."""
        print_ = self.prints(block)[start]
        return absorb(_PAIR, print_), mix(print_)

    def prints(self, block: Block) -> np.ndarray:
        """The hash of the window from each word on, worked out once for a block."""
        if getattr(block, "prints", None) is None:
            block.prints = window_codes(block.words[2], self.width)
        return block.prints

    def flat(self, blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all blocks' words among their distinct words, and where each block's begin."""
        sizes, at = [len(b.words[0]) for b in blocks], np.cumsum([0, *(len(b.data) for b in blocks)])
        whole = Block(np.concatenate([b.data for b in blocks] or [np.zeros(0, np.uint8)]), at[[0, -1]])
        start, end, code = (np.concatenate([b.words[k] + (base if k < 2 else np.uint64(0)) for b, base in zip(blocks, at.tolist(), strict=False)] or [np.zeros(0, np.int64)]) for k in range(3))
        return whole.distinct(start, end, code)[0] if len(start) else start, np.cumsum([0, *sizes])[:-1]

    equal = staticmethod(equal_sequences)

    def many(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.append(at, len(ids))) > 1

    def statistic(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.append(at, len(ids)))

    def within(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.zeros(len(ids), dtype=bool)

    def load(self, spans) -> bytes:
        """The words of each run, each followed by one space."""
        out = []
        for block, a, z in spans:
            if getattr(block, "spaced", None) is None:
                block.spaced = spaced(block.data, *block.words[:2])
            flat, begin = block.spaced
            out.append(flat[begin[a] : begin[z + self.width - 1]])
        return b"".join(out)

    def settle(self, every, name, key, count, length, anchor, load) -> np.ndarray:
        """For each window of each run: whether its words also start anywhere else."""
        width = self.width
        block = Block(load, np.array([0, len(load)]))
        code, word = block.words[2], block.numbers
        begin = np.cumsum(length + width - 1) - (length + width - 1)
        order, at, number = every.same_runs(name, key, word, begin, length)
        one, total = order[at], np.add.reduceat(count[order], at)
        m = length[one]
        start = np.cumsum(m) - m
        step = np.arange(int(m.sum())) - np.repeat(start, m)
        times = np.repeat(total, m)
        of_name = groups(name[one])
        runs = np.diff(np.append(of_name, len(one)))
        mixed = np.flatnonzero(np.repeat(np.repeat(runs > 1, runs), m))  # windows of names with runs that differ
        if len(mixed):
            window = (np.repeat(begin[one], m) + step)[mixed]
            same = lambda i, j: equal_sequences(word, window[i], window[j], np.full(len(i), width))
            by, edge, _ = verified_classes((np.repeat(name[one], m)[mixed], window_codes(code, width)[window]), same, lambda i: word[window[i] : window[i] + width].tobytes())
            times[mixed[by]] = np.repeat(np.add.reduceat(times[mixed[by]], edge), np.diff(np.append(edge, len(by))))
        where = np.repeat(start[number] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        return times[where] > 1


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of a text, each followed by one space, and where each begins (one entry more)."""
    size = end - start + 1
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    flat = np.append(data, np.uint8(32))[np.arange(total) + np.repeat(start - stop + size, size)]
    flat[stop - 1] = 32
    return flat.tobytes(), np.concatenate([[0], stop])


def dedup(documents: DataFrame, width: int = 35, hot: int = 4096) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space, for every document."""

    def finish(rows, block: Block, starts: np.ndarray) -> dict:
        start, end, code, first = block.words
        gone = covered(starts, len(code), width)
        raw, begin = spaced(block.data, start[~gone], end[~gone])
        kept = np.concatenate([[0], np.cumsum(~gone)])[first]
        cut = begin[kept].tolist()
        removed = np.diff(first) - np.diff(kept)
        return {"doc_id": rows.column("doc_id"), "n_words": np.diff(first), "n_removed": removed, "kept": pa.array([raw[x : max(y - 1, x)] for x, y in zip(cut, cut[1:])], pa.binary())}

    return find(WordWindows(width), documents, finish, "doc_id long, n_words long, n_removed long, kept string", hot)
