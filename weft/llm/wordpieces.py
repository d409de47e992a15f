"""Tokenising word by word with public vocabularies, each distinct word of a block once.

White space never joins two words into one token in the vocabularies used here, so that a text's ids are its words'
ids in order.  A worker keeps the words it has met in a dictionary of bounded size.
"""

from __future__ import annotations

import itertools

import numpy as np

from weft.llm.textblock import Block, word_bounds

#: A worker keeps at most so many words, those that a block has KEEP_FROM times or more (time, never results, depends on it).
CACHE_WORDS, KEEP_FROM = 60_000, 6
#: Bytes of text that are looked at together: the more, the fewer distinct words a byte.
WORD_BLOCK = 4 << 20

_loaded: dict[tuple[str, str], "Pieces"] = {}


def load(kind: str, path: str) -> "Pieces":
    """The tokenizer of the vocabulary file at ``path``; kind is 'tokenizers', 'sentencepiece' or 'tiktoken'."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = Pieces(kind, path)
    return _loaded[kind, path]


class Pieces:
    def __init__(self, kind: str, path: str):
        self.kept: dict[bytes, list[int]] = {}
        if kind == "tokenizers":
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self.encode = lambda words: [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        elif kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.model = model
            self.encode = lambda words: model.encode(words, num_threads=1)
        elif kind == "tiktoken":
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = lambda words: [model.encode_ordinary(" " + w) for w in words]
        else:
            raise ValueError(f"unknown tokenizer library: {kind}")

    def words(self, words: list[bytes], count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and where each word's ids start (one more entry than words)."""
        kept = self.kept
        found = [kept.get(w) for w in words]
        new = [i for i, x in enumerate(found) if x is None]
        often = (count >= KEEP_FROM).tolist()
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            for i, ids in zip(some, self.encode([words[i].decode("utf-8", "replace") for i in some]), strict=True):
                found[i] = ids
                if often[i] and len(kept) < CACHE_WORDS and len(words[i]) <= 64:
                    kept[words[i]] = ids
        starts = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in found], out=starts[1:])
        return np.fromiter(itertools.chain.from_iterable(found), dtype=np.int32, count=int(starts[-1])), starts


def distinct_words(block: Block) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The number of each word of the block among its distinct words, those words, and how often each stands there."""
    return _distinct(block, *block.words[:3])


def _distinct(block: Block, start, end, code) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    number, first = block.distinct(start, end, code)
    raw = block.data.tobytes()
    words = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
    return number, words, np.bincount(number, minlength=len(first))


# Classes of bytes for LowerWords: ASCII letters, two-byte letters from U+00C0 (but the signs there), other ASCII signs.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[0x21:0x7F] = ~_LETTER[_LOWER[0x21:0x7F]]
_SIGN[ord("'")] = False
_TWO_BYTE = np.zeros(256, dtype=bool)
_TWO_BYTE[0x80:0xC0] = True
_TWO_BYTE[[0x97, 0xB7]] = False  # the signs for multiplication and division


def _letters(data: np.ndarray) -> np.ndarray:
    out = _LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_TWO_BYTE[data[lead + 1]]]
    out[lead] = out[lead + 1] = True
    return out


def _unit_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, cut where letters and ASCII signs meet; a word with an apostrophe stays whole."""
    start, end = word_bounds(data, bounds)
    if not len(start):
        return start, end
    letter, sign = _letters(data), _SIGN[data]
    turn = np.flatnonzero((letter[:-1] & sign[1:]) | (sign[:-1] & letter[1:])) + 1
    word = np.searchsorted(start, turn, side="right") - 1
    quotes = np.concatenate([[0], np.cumsum(data == ord("'"))])
    turn = turn[(turn > start[word]) & (turn < end[word]) & (quotes[end[word]] == quotes[start[word]])]
    marks = np.zeros(len(data) + 1, dtype=bool)
    marks[start] = marks[turn] = True
    starts = np.flatnonzero(marks)
    marks[:] = False
    marks[end] = marks[turn] = True
    return starts, np.flatnonzero(marks)


class LowerWords:
    """A ``tokenizers`` vocabulary that folds case, drops white space, and ends the last token of letters or signs in </w>.

    Its pre-tokens are runs of letters, single digits, runs of other signs, and endings with an apostrophe.  Texts are
    cut into units no smaller than these; each distinct unit is tokenised once.  Units that are one pre-token are
    tokenised many to a text, for their last tokens tell them apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[k for x, k in vocabulary.items() if x.endswith("</w>")]] = True
        self.special = [x.content.encode()[:2] for x in self.tokenizer.get_added_tokens_decoder().values()]

    def ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each document's ids start (n + 1 entries)."""
        raw = block.data.tobytes()
        if any(x in raw for x in self.special):  # text that may hold a special token: whole words, as they stand
            start, end, code = block.words[:3]
            number, words, _ = _distinct(block, start, end, code)
            plain = np.zeros(len(words), dtype=bool)
        else:
            block = Block(_LOWER[block.data], block.bounds)
            start, end, code = block.spans(_unit_bounds)
            number, words, _ = _distinct(block, start, end, code)
            size = np.array([len(w) for w in words], dtype=np.int64)
            joined, at = np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size
            plain = np.logical_and.reduceat(_letters(joined), at) | np.logical_and.reduceat(_SIGN[joined] & ~_DIGIT[joined], at) if len(words) else np.zeros(0, bool)
        flat, starts = self._each(words, plain)
        if flat is None:  # a vocabulary whose ends don't tell pre-tokens apart
            flat, starts = self._each(words, np.zeros(len(words), dtype=bool))
        ids, length = expand(number, flat, starts)
        return ids, np.concatenate([[0], np.cumsum(length)])[np.searchsorted(start, block.bounds)]

    def _each(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
        simple, odd = np.flatnonzero(plain), np.flatnonzero(~plain)
        texts = [" ".join([words[i].decode() for i in simple[at : at + 500].tolist()]) for at in range(0, len(simple), 500)]
        one = [np.array(x.ids, dtype=np.int32) for k in range(0, len(texts), 64) for x in self.tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False)]
        one = np.concatenate([*one, np.zeros(0, np.int32)])
        ends = np.flatnonzero(self.ends[one]) + 1
        if len(ends) != len(simple) or (len(one) and ends[-1:].tolist() != [len(one)]):
            return None, None
        two = [x.ids for k in range(0, len(odd), 20_000) for x in self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in odd[k : k + 20_000].tolist()], add_special_tokens=False)]
        size = np.zeros(len(words), dtype=np.int64)
        size[simple] = np.diff(ends, prepend=0)
        size[odd] = [len(x) for x in two]
        starts = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(int(starts[-1]), dtype=np.int32)
        flat[np.repeat(starts[:-1][simple] - (ends - size[simple]), size[simple]) + np.arange(len(one))] = one
        n = np.array([len(x) for x in two], dtype=np.int64)
        flat[np.repeat(starts[:-1][odd] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = np.fromiter(itertools.chain.from_iterable(two), np.int32, count=int(n.sum()))
        return flat, starts


_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_lower: dict[str, LowerWords] = {}


def lower_words(path: str) -> LowerWords:
    if path not in _lower:
        _lower[path] = LowerWords(path)
    return _lower[path]


def expand(number: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words in text order, and how many each word has."""
    length = np.diff(starts)[number]
    end = np.cumsum(length)
    at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(starts[number] - end + length, length)
    return flat[at], length
