"""Byte-level deduplication: every byte covered by a 50-byte string that also starts in a document with a smaller doc_id.

Anchors are minimisers, the smallest hash of 24 bytes in a 50-byte window.  Runs of windows under one anchor travel as
their text, by which equal runs are told; where a name has runs that differ, their suffixes are put in order by :mod:`weft.llm.suffix_sort`, which
tells equal windows from others, and the smallest doc_id of each class of equal windows decides.

Defined results.  A null text is empty.  A document with a null doc_id has no order: it neither loses bytes nor takes
them.  Rows with the same doc_id count as one document.  Texts of fewer than 50 bytes lose nothing; texts of any length
are read whole.  What is kept may break a character, so it is binary.  An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm.repeats import Runs, find, groups
from weft.llm.suffix_sort import equal_classes
from weft.llm.textblock import Block, absorb, covered, eights, equal_spans, mix, span_codes

NO_ID = np.iinfo(np.int64).max


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


class ByteWindows:
    def __init__(self, width: int = 50, seed: int = 24):
        self.width, self.seed = width, seed

    def ids(self, rows) -> np.ndarray:
        return np.array(rows.column("doc_id").fill_null(NO_ID), dtype=np.int64)

    def runs(self, block: Block, doc_ids: pa.Array) -> Runs:
        data, width, k = block.data, self.width, self.seed
        n = len(data) - width + 1
        if n <= 0:
            return Runs(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64, np.uint64)))
        eight, m = eights(data), len(data) - k + 1
        code = absorb(np.full(m, k, dtype=np.uint64), eight[:m])
        for at in range(8, k, 8):
            code = absorb(code, eight[at : at + m])
        best = sliding_min((code & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(code), dtype=np.uint64), width - k + 1)
        place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # A window is valid if it ends in its document; documents without an id take no part.
        valid = np.ones(n + 1, dtype=bool)
        for end in block.bounds[1:-1].tolist():
            valid[max(0, end - width + 1) : end] = False
        if doc_ids.null_count:
            for d in np.flatnonzero(np.array(doc_ids.is_null())).tolist():
                valid[block.bounds[d] : block.bounds[d + 1]] = False
        valid[n] = False
        edge = np.ones(n + 1, dtype=bool)
        edge[1:n] = (place[1:] != place[:-1]) | ~valid[1:n] | ~valid[: n - 1]
        edge = np.flatnonzero(edge)
        run = np.flatnonzero(valid[edge])
        start, end = edge[run], edge[run + 1]
        anchor = place[start]
        key = absorb(span_codes(data, start, end + width - 1), (anchor - start).astype(np.uint64))
        doc = np.searchsorted(block.bounds, start, side="right") - 1
        return Runs(mix(code[anchor]) & ~np.uint64(1), doc, start, end, anchor - start, key)

    def window_names(self, block: Block, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A name for each window by its bytes alone, and a key that tells it from others."""
        end = start + self.width
        return span_codes(block.data, start, end, 1), span_codes(block.data, start, end, 2)

    def flat(self, blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all blocks, and where each block's begin."""
        sizes = [len(b.data) for b in blocks]
        return np.concatenate([b.data for b in blocks] or [np.zeros(0, np.uint8)]), np.cumsum([0, *sizes])[:-1]

    equal = staticmethod(equal_spans)

    def many(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(ids, at) < np.maximum.reduceat(ids, at) if len(at) else np.zeros(0, bool)

    def statistic(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.minimum.reduceat(ids, at) if len(at) else np.zeros(0, np.int64)

    def within(self, ids: np.ndarray, smallest: np.ndarray) -> np.ndarray:
        return ids > smallest

    def load(self, spans) -> bytes:
        return b"".join(block.data[a : z + self.width - 1].tobytes() for block, a, z in spans)

    def settle(self, every, name, key, smallest, length, anchor, load) -> np.ndarray:
        """For each window of each run: whether it also starts in a document below the run's smallest."""
        width = self.width
        text = np.cumsum(length + width - 1) - (length + width - 1)
        order, first, number = every.same_runs(name, key, load, text, length)
        least = np.minimum.reduceat(smallest[order], first)
        one = order[first]  # a run for each class
        begin = np.concatenate([[0], np.cumsum(length[one])])
        window_least = np.repeat(least, length[one])
        of_name = groups(name[one])
        count = np.diff(np.append(of_name, len(one)))
        mixed = np.flatnonzero(np.repeat(count > 1, count))  # classes of names with runs that differ
        if len(mixed):
            m = length[one[mixed]]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            suffix = np.repeat(text[one[mixed]], m) + step
            window = np.repeat(begin[mixed], m) + step
            # Equal windows have their anchor at the same place, so that groups are by name and that place.
            name_number = np.repeat(np.repeat(np.arange(len(of_name)), count)[mixed], m)
            group = name_number * (2 * width) + np.repeat(anchor[one[mixed]], m) - step + width
            by = np.argsort(group, kind="stable")
            edge = groups(group[by])
            size = np.diff(np.append(edge, len(by)))
            by = by[np.repeat(size > 1, size)]
            equal = equal_classes(load, width, suffix[by], group[by])
            low = np.full(int(equal.max(initial=-1)) + 1, NO_ID)
            np.minimum.at(low, equal, window_least[window[by]])
            window_least[window[by]] = low[equal]
        at = np.repeat(begin[number], length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return window_least[at] < np.repeat(smallest, length)


def dedup(documents: DataFrame, width: int = 50, hot: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and what is kept (binary) of every document."""

    def finish(rows, block: Block, starts: np.ndarray) -> dict:
        gone = covered(starts, len(block.data), width)
        first = np.zeros(len(gone) + 1, dtype=bool)
        first[block.bounds] = True
        head = gone.copy()
        head[1:] &= ~gone[:-1] | first[1:-1]
        kept = block.data[~gone].tobytes()
        end = np.concatenate([[0], np.cumsum(~gone)])[block.bounds].tolist()
        return {
            "doc_id": rows.column("doc_id"), "n_bytes": np.diff(block.bounds), "n_removed": block.per_doc(gone), "n_spans": block.per_doc(head),
            "kept": [kept[a:b] for a, b in zip(end, end[1:])],
        }

    return find(ByteWindows(width), documents, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", hot)
