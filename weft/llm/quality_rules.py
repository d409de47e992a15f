"""Quality rules from tokeniser fertility.

Public vocabularies are measured on whole texts: characters per token of a vocabulary of pieces and of one of bytes, the
share of tokens that are single fallback bytes, and the entropy of a text's tokens.  A text outside the bands of its language, or of its script where the
language has no bands, is rejected.  Tokenizers are only applied, never trained.

Defined results.  Null or empty text: all counts 0, base rule fails, not kept.  Very long texts are measured whole.
Repeated rows are judged each alone; a null ``lang`` takes the script's bands; an empty table gives an empty table.
Columns of the input that are not named here are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm import wordpieces
from weft.llm.shared import small_batches
from weft.llm.stats import base_stats, doc_of
from weft.llm.textblock import Block, blocks


#: Tokens up to which the entropy of a text could rise with their number.
EVEN_TOKENS = 256


@dataclass(frozen=True)
class Band:
    """What a text may have: characters per token of both vocabularies (least, most), the share of byte tokens (most), and
    evenness (least), which is entropy over the most it could be for the number of tokens, or for EVEN_TOKENS of them: the
    entropy of a longer text hardly rises, and a long text is not to be rejected for its length."""

    chars_per_token: tuple[float, float]
    chars_per_byte_token: tuple[float, float]
    byte_share: float
    evenness: float

    def holds(self, measures: dict[str, float]) -> bool:
        a, b = self.chars_per_token, self.chars_per_byte_token
        inside = a[0] <= measures["chars_per_token"] <= a[1] and b[0] <= measures["chars_per_byte_token"] <= b[1]
        return inside and measures["byte_share"] <= self.byte_share and measures["evenness"] >= self.evenness


@dataclass(frozen=True)
class FertilityRules:
    """Bands by language, and by script for every other text. A vocabulary is (library, path)."""

    pieces: tuple[str, str]
    bytes: tuple[str, str]
    by_language: dict[str, Band] = field(default_factory=dict)
    by_script: dict[str, Band] = field(default_factory=dict)
    min_words: int = 20
    max_repeat_percent: int = 30


#: Leading UTF-8 bytes of the scripts told apart (two-byte and three-byte sequences).
SCRIPT_BYTES = {"greek": range(0xCD, 0xD0), "cyrillic": range(0xD0, 0xD5), "hebrew_arabic": range(0xD6, 0xDD), "indic": range(0xE0, 0xE1), "cjk": range(0xE3, 0xEE)}
SCRIPTS = ["latin", *SCRIPT_BYTES]
_SCRIPT_OF = np.zeros(256, dtype=np.int8)
_SCRIPT_OF[ord("A") : ord("Z") + 1] = _SCRIPT_OF[ord("a") : ord("z") + 1] = 1
_SCRIPT_OF[0xC3:0xCA] = 1
for _k, _bytes in enumerate(SCRIPT_BYTES.values()):
    _SCRIPT_OF[list(_bytes)] = _k + 2

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, chars_per_token double, chars_per_byte_token double, byte_share double, evenness double"
)


def script_of(block: Block) -> np.ndarray:
    """The script with the most letters; latin for a text without letters and in a tie."""
    kind = _SCRIPT_OF[block.data]
    counts = np.stack([block.per_doc(kind == k + 1) for k in range(len(SCRIPTS))])
    return np.array(SCRIPTS)[counts.argmax(axis=0)]


def fertility(block: Block, rules: FertilityRules, chars: np.ndarray) -> dict[str, np.ndarray]:
    number, words, count = wordpieces.distinct_words(block)
    first = block.words[3]
    doc = doc_of(first)
    per = lambda x: np.bincount(doc, weights=x, minlength=block.n)
    pieces = wordpieces.load(*rules.pieces)
    flat, starts = pieces.words(words, count)
    model = pieces.model
    single = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    fallback = np.concatenate([[0], np.cumsum(single[flat])])
    n_pieces, n_single = np.diff(starts)[number], (fallback[starts[1:]] - fallback[starts[:-1]])[number]
    flat, starts = wordpieces.load(*rules.bytes).words(words, count)
    ids, length = wordpieces.expand(number, flat, starts)
    key = np.sort(np.repeat(doc, length) * (1 << 20) + ids)
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(edge, len(key)))
    total = per(length)
    weighted = np.bincount(key[edge] >> 20, weights=times * np.log(np.maximum(times, 1)), minlength=block.n)
    entropy = np.log(np.maximum(total, 1)) - weighted / np.maximum(total, 1)
    pieces_total = per(n_pieces)
    return {
        "chars_per_token": chars / np.maximum(pieces_total, 1),
        "chars_per_byte_token": chars / np.maximum(total, 1),
        "byte_share": per(n_single) / np.maximum(pieces_total, 1),
        "evenness": np.where(total > 1, entropy / np.log(np.clip(total, 2, EVEN_TOKENS)), 0.0),
    }


def judged(block: Block, langs: list, rules: FertilityRules) -> dict:
    """Counts, measures and verdict for each document of the block."""
    parts = [base_stats(part) | {"script": script_of(part)} for part in block.split()]
    stats = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
    n, repeats = stats["n_words"], stats["n_repeat_words"]
    measures = fertility(block, rules, stats["word_chars"])
    scripts = stats.pop("script")
    failed = (n < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n)
    inside = []
    for k, (lang, script) in enumerate(zip(langs, scripts, strict=True)):
        band = rules.by_language.get(lang) or rules.by_script.get(script)
        inside.append(band is None or band.holds({name: x[k] for name, x in measures.items()}))
    return stats | measures | {"base_failed": failed, "kept": ~failed & np.array(inside, dtype=bool), "script": scripts}


def score(documents: DataFrame, rules: FertilityRules) -> DataFrame:
    """Counts, measures and verdict of every document; one row a row of ``documents``, which needs doc_id, text, lang."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def of(batches):
        for part, block in blocks(batches, size=wordpieces.WORD_BLOCK):
            columns = judged(block, part.column("lang").to_pylist(), rules)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(columns[x]) for x in names[1:])], names=names)

    return small_batches(documents).select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(of, SCHEMA)


def keep(documents: DataFrame, rules: FertilityRules) -> DataFrame:
    """The documents whose verdict is to keep them, all columns as they are."""

    def of(batches):
        for part, block in blocks(batches, size=wordpieces.WORD_BLOCK):
            yield part.filter(pa.array(judged(block, part.column("lang").to_pylist(), rules)["kept"]))

    return small_batches(documents).mapInArrow(of, documents.schema)
