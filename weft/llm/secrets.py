"""Secret scans through a trigram index, in DataFrame operations only.

Each rule's regular expression gives a Boolean query over trigrams (:mod:`weft.llm.trigram_query`).  The index holds,
for the trigrams that some query names, which documents have them, as a bitmap beside each document: bit k is the
posting of trigram k.  Intersecting postings is then an AND of bits in the row, for which no text moves.  Only
documents that meet a rule's query are matched against the rule; a rule without mandatory trigrams scans every text.

Positions come from the texts between matches: Java's ``split`` and ``regexp_extract_all`` walk the same leftmost
matches, so that running lengths of both give code-point offsets.  Running sums and maxima double their reach step by
step and texts are cut by halves, so that work grows as n log n with the spans and the length of a text.

Defined results.  Null text is empty and has no spans.  Every text is scanned whole, whatever its length: no rule
repeats a group but possessively, which Java does in a loop, and no rule reads a run of characters from more than a
bounded number of starts in it.  Rows with the same or a null doc_id are scanned each alone.  An empty table gives an
empty table.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.trigram_query import trigram_query


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``; with ``group``, only those in which that group has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def query(self):
        return trigram_query(self.pattern)

    @property
    def scans(self) -> bool:
        return frozenset() in self.query


#: The three rules that every result has. Runs of 24 hex digits or more are the runs of hex digits that are that long;
#: the same holds for the access keys.
BASE = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of other credentials. The words before PRIVATE KEY are read in a possessive loop that stops
#: at them; what follows a jwt's start is read once for each run of its characters.
MORE = (
    Rule("pem", r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z]+ )*+PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"://[^\x20/:@]{1,64}:[^\x20/:@]{3,64}@"),
)
RULES = BASE + MORE

#: Postings in a word of the bitmap.
BITS = 62
#: Characters in the pieces that a text is cut into for redaction.
PIECE = 512
SPANS = "array<struct<start:int,number:int,end:int>>"


def named(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that the queries name, in the order of their bits."""
    return sorted({g for r in rules if not r.scans for a in r.query for g in a})


def index(documents: DataFrame, rules: tuple[Rule, ...] = RULES, *others: Column) -> DataFrame:
    """doc_id, text, the ``others``, and the postings grams0, grams1, ..: documents with the words of their bitmap.

    Written once, it serves any number of scans.
    """
    text, others = F.coalesce(F.col("text").cast("string"), F.lit("")), [*others]
    read = documents.select(F.col("doc_id").cast("long"), text.alias("text"), F.lower(text).alias("low"), *others)
    kept = [c for c in read.columns if c != "low"]
    none, words, grams = F.lit(0).cast("long"), [], named(rules)
    for at in range(0, len(grams), BITS):
        word = none
        for k, g in enumerate(grams[at : at + BITS]):
            word = word.bitwiseOR(F.when(F.contains("low", F.lit(g)), F.lit(1 << k).cast("long")).otherwise(none))
        words.append(word.alias(f"grams{at // BITS}"))
    return read.select(*kept, *words)


def candidate(rule: Rule, rules: tuple[Rule, ...]) -> Column:
    """Whether the postings meet the rule's query: all trigrams of one of its alternatives."""
    number = {g: k for k, g in enumerate(named(rules))}
    met = F.lit(rule.scans)
    for alternative in [] if rule.scans else sorted(rule.query, key=sorted):
        words: dict[int, int] = {}
        for g in alternative:
            words[number[g] // BITS] = words.get(number[g] // BITS, 0) | 1 << number[g] % BITS
        every = F.lit(True)
        for word, mask in words.items():
            every &= F.col(f"grams{word}").bitwiseAND(F.lit(mask).cast("long")) == F.lit(mask).cast("long")
        met |= every
    return met


def _running(values: Column, join, none: int) -> Column:
    """What ``join`` makes of the values up to each, itself included, by doubling how far each looks back."""
    reach = F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda k: k < F.size(values))
    return F.aggregate(reach, values, lambda state, k: F.transform(state, lambda x, i: join(x, F.when(i >= k, F.get(state, i - k)).otherwise(F.lit(none)))))


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _found(text: Column, rule: Rule) -> Column:
    """array<struct<gap, size, inner>>: each match's length, that of its group, and that of the text before it from the last."""
    size = lambda group: F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = size(0)
    return F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), (size(rule.group) if rule.group else sizes).alias("inner"))


def _placed(each: Column) -> Column:
    """The spans of a rule's matches from their lengths; ``each`` is a struct<number, least, found>."""
    found = F.filter(each["found"], lambda x: x["size"].isNotNull())
    ends = lambda some: _running(F.transform(some, lambda x: x["gap"] + x["size"]), lambda a, b: a + b, 0)
    both = F.zip_with(found, ends(found), lambda x, end: F.struct((end - x["size"]).alias("start"), each["number"].alias("number"), end.alias("end"), x["inner"].alias("inner")))
    return F.transform(F.filter(both, lambda x: x["inner"] >= each["least"]), lambda x: F.struct(x["start"], x["number"], x["end"]))


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, keep: bool = False) -> DataFrame:
    """doc_id, text, with ``keep`` the whole input row as the struct ``row``, and ``found``: array<struct<start, number, end>> by start, then rule."""
    row = [F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")] if keep else []
    listed = index(documents, rules, *row)
    parts = []
    for k, rule in enumerate(rules):
        ask = candidate(rule, rules) & F.col("text").rlike(rule.pattern)
        found = F.when(ask, _found(F.col("text"), rule)).otherwise(F.array().cast("array<struct<gap:int,size:int,inner:int>>"))
        parts.append(F.struct(F.lit(k).alias("number"), F.lit(rule.least if rule.group else 0).alias("least"), found.alias("found")))
    matched = F.filter(F.array(*parts), lambda x: F.size(x["found"]) > 0)
    return listed.select("doc_id", "text", *(["row"] if keep else []), F.array_sort(F.flatten(F.transform(matched, _placed))).cast(SPANS).alias("found"))


def listing(found: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["number"]), s["start"], s["end"])), ",")


def report(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, the digest of the base spans, and all spans, for every document."""
    found = F.col("found")
    base = F.filter(found, lambda s: s["number"] < len(BASE))
    number = F.transform(found, lambda s: s["number"])
    counts = [(F.size(number) - F.size(F.array_remove(number, k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return scan(documents, rules).select("doc_id", *counts, F.sha2(listing(base, rules), 256).alias("base_sha256"), listing(found, rules).alias("spans"))


def _pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters, the last ones short or empty, by cutting halves of halves."""
    halves = F.filter(F.array(*[F.lit(PIECE << k) for k in range(21, -1, -1)]), lambda half: half <= F.length(text))
    two = lambda half: lambda x: F.array(F.substring(x, F.lit(1), half), F.substring(x, half + 1, F.length(x)))
    return F.aggregate(halves, F.array(text), lambda state, half: F.flatten(F.transform(state, two(half))))


def _between(pieces: Column, start: Column, end: Column) -> Column:
    """Characters start to end of the text in pieces."""
    i, j = F.floor(start / PIECE).cast("int"), F.floor(end / PIECE).cast("int")
    within = F.substring(F.get(pieces, i), start - i * PIECE + 1, end - start)
    over = F.concat(
        F.substring(F.get(pieces, i), start - i * PIECE + 1, F.lit(PIECE)),
        F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""),
        F.substring(F.get(pieces, j), F.lit(1), end - j * PIECE),
    )
    return F.when(i == j, within).otherwise(over)


def redacted(text: Column, found: Column, mark: str) -> Column:
    """The text with one mark for each run of overlapping spans."""

    def written(both: Column) -> Column:
        spans, pieces = both["spans"], both["pieces"]
        before = lambda i: F.when(i > 0, F.get(spans, i - 1)["most"]).otherwise(F.lit(0))
        heads = F.transform(spans, lambda s, i: F.struct(before(i).alias("after"), s["start"].alias("start")))
        heads = F.filter(heads, lambda h: h["start"] >= h["after"])
        kept = F.transform(heads, lambda h: F.concat(_between(pieces, h["after"], h["start"]), F.lit(mark)))
        rest = _between(pieces, F.element_at(spans, -1)["most"], F.length(text))
        return F.array_join(F.concat(kept, F.array(rest)), "")

    ends = _running(F.transform(found, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
    spans = F.zip_with(found, ends, lambda s, most: F.struct(s["start"].alias("start"), most.alias("most")))
    return _with(F.struct(spans.alias("spans"), _pieces(text).alias("pieces")), written)


def redact(documents: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every span replaced by ``mark`` (overlapping spans by one); n_chars follows the new text.

    Columns and their order stay; a null text stays null.
    """
    row, some = F.col("row"), F.size("found") > 0
    done = scan(documents, rules, keep=True).select("row", "found", F.when(some, redacted(F.col("text"), F.col("found"), mark)).otherwise(row["text"]).alias("new"))
    new = {"text": F.col("new")}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(some, F.length("new").cast("long")).otherwise(row["n_chars"])
    return done.select(*[new.get(c, row.getField(c)).alias(c) for c in documents.columns])
