"""Counts and shares over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np

from weft.llm.textblock import SPACE, Block, covered, equal_sequences, verified_classes, window_codes, window_starts

#: Fixed: the characters counted as symbols.
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
REPEAT_WORDS = 8


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each word, from the index of each document's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def repeat_words(block: Block, width: int = REPEAT_WORDS) -> np.ndarray:
    """Words of each document in windows of ``width`` words that it has twice or more, the first included."""
    _, _, code, first = block.words
    n = len(code)
    starts = np.flatnonzero(window_starts(first, width))
    if not len(starts):
        return np.zeros(block.n, dtype=np.int64)
    doc, key = doc_of(first)[starts], window_codes(code, width)[starts]

    def same(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return equal_sequences(block.numbers, starts[i], starts[j], np.full(len(i), width))

    order, at, _ = verified_classes((key, doc), same, lambda i: tuple(block.numbers[starts[i] : starts[i] + width].tolist()))
    sizes = np.diff(np.append(at, len(order)))
    mask = covered(np.sort(starts[order[np.repeat(sizes > 1, sizes)]]), n, width)
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[first[1:]] - total[first[:-1]]


def lines(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every \\n-split line that has a word."""
    data = block.data
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    marks = np.zeros(len(data) + 1, dtype=bool)
    marks[1:] = data == 10
    marks[block.bounds] = True
    start = np.flatnonzero(marks[:-1])
    end = np.append(start[1:], len(data))
    end = end - ((end > start) & (data[end - 1] == 10))
    solid = np.concatenate([[0], np.cumsum(~SPACE[data])])
    keep = solid[end] > solid[start]
    start, end = start[keep], end[keep]
    return start, end, np.searchsorted(block.bounds, start, side="right") - 1


def repeated_lines(block: Block) -> np.ndarray:
    """How many lines of each document equal an earlier one of it, compared as they are."""
    start, end, doc = lines(block)
    raw, out = block.data.tobytes(), np.zeros(block.n, dtype=np.int64)
    found = [raw[a:z] for a, z in zip(start.tolist(), end.tolist(), strict=True)]
    edge = np.searchsorted(doc, np.arange(block.n + 1)).tolist()
    for k in np.flatnonzero(np.bincount(doc, minlength=block.n) > 1).tolist():
        mine = found[edge[k] : edge[k + 1]]
        out[k] = len(mine) - len(set(mine))
    return out


def base_stats(block: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    first = block.words[3]
    data = block.data
    return {
        "n_words": np.diff(first),
        "word_chars": block.per_doc(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": block.per_doc(SYMBOLS[data]),
        "n_dup_lines": repeated_lines(block),
        "n_repeat_words": repeat_words(block),
    }
