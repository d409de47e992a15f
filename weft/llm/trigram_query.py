"""Boolean trigram queries that a text must meet to match a regular expression.

The expression is parsed with the standard library's parser.  For every part we keep the whole strings it can match, if
they are few, else what it must begin and end with, and a condition on trigrams.  A condition is in disjunctive form: a
set of alternatives, each a set of trigrams that must all be there; ``ANY`` has one empty alternative and holds for
every text.  Letters are folded to lower case, as in the index.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

Condition = frozenset  # of frozensets of trigrams
ANY: Condition = frozenset([frozenset()])
MOST_STRINGS, MOST_ALTERNATIVES = 64, 64


@dataclass(frozen=True)
class Part:
    exact: frozenset[str] | None
    prefix: frozenset[str]
    suffix: frozenset[str]
    must: Condition


ANYTHING = Part(None, frozenset([""]), frozenset([""]), ANY)
EMPTY = Part(frozenset([""]), frozenset([""]), frozenset([""]), ANY)


def grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def one_of(strings) -> Condition:
    return simplify(frozenset(grams(s) for s in strings))


def simplify(condition: Condition) -> Condition:
    """Drop alternatives that ask for more than another; give up (ANY) where too many are left."""
    kept = frozenset(a for a in condition if not any(b < a for b in condition))
    return kept if len(kept) <= MOST_ALTERNATIVES else ANY


def both(a: Condition, b: Condition) -> Condition:
    out = frozenset(x | y for x in a for y in b)
    return simplify(out) if len(out) <= MOST_ALTERNATIVES**2 else a


def inexact(part: Part) -> Part:
    if part.exact is None:
        return part
    return Part(None, frozenset(s[:2] for s in part.exact), frozenset(s[-2:] for s in part.exact), one_of(part.exact))


def follow(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return Part(frozenset(x + y for x in a.exact for y in b.exact), *EMPTY_ENDS)
    across = one_of(x[-2:] + y[:2] for x in (a.exact or a.suffix) for y in (b.exact or b.prefix)) if len(a.exact or a.suffix) * len(b.exact or b.prefix) <= MOST_STRINGS else ANY
    # What begins with a short string and then something else begins with both; likewise at the end.
    prefix = frozenset((x + y)[:2] for x in a.exact for y in (b.exact or b.prefix)) if a.exact is not None else a.prefix
    suffix = frozenset((x + y)[-2:] for x in (a.exact or a.suffix) for y in b.exact) if b.exact is not None else b.suffix
    a, b = inexact(a), inexact(b)
    return Part(None, prefix, suffix, both(both(a.must, b.must), across))


EMPTY_ENDS = (frozenset([""]), frozenset([""]), ANY)


def either(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= MOST_STRINGS:
        return Part(a.exact | b.exact, *EMPTY_ENDS)
    a, b = inexact(a), inexact(b)
    return Part(None, a.prefix | b.prefix, a.suffix | b.suffix, simplify(a.must | b.must))


def _members(items) -> frozenset[str] | None:
    out: set[str] = set()
    for kind, value in items:
        if str(kind) == "LITERAL":
            out.add(chr(value).lower())
        elif str(kind) == "RANGE" and value[1] - value[0] < 16:
            out.update(chr(c).lower() for c in range(value[0], value[1] + 1))
        else:
            return None
    return frozenset(out) if len(out) <= 8 else None


def _walk(tree) -> Part:
    out = EMPTY
    for kind, value in tree:
        kind = str(kind)
        if kind == "LITERAL":
            part = Part(frozenset([chr(value).lower()]), *EMPTY_ENDS)
        elif kind == "IN":
            members = _members(value)
            part = Part(members, *EMPTY_ENDS) if members else ANYTHING
        elif kind == "SUBPATTERN":
            part = _walk(value[3])
        elif kind == "BRANCH":
            parts = [_walk(x) for x in value[1]]
            part = parts[0]
            for x in parts[1:]:
                part = either(part, x)
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            once = _walk(inner)
            if (low, high) == (0, 1):
                part = either(once, EMPTY)
            elif low == 0:
                part = ANYTHING
            else:
                part = once
                for _ in range(min(low, 4) - 1):
                    part = follow(part, once)
                if high != low or low > 4:
                    part = inexact(part)
        elif kind == "AT":
            part = EMPTY
        else:
            part = ANYTHING
        out = follow(out, part)
    return out


@functools.cache
def trigram_query(pattern: str, most: int = 4) -> Condition:
    """What must be in a text that matches; at most ``most`` trigrams of an alternative are kept, which only weakens it."""
    must = inexact(_walk(re._parser.parse(pattern))).must
    return frozenset(frozenset(sorted(a)[:: max(1, -(-len(a) // most))]) for a in must)
