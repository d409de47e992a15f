"""Guesses about files to import: separators, headers and column types. A file that can't be read gives no guess."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import SparkSession

from weft.errors import PlanError
from weft.plans.model import Column
from weft.sources.tables import split_line

SEPARATORS = (",", ";", "\t", "|")
SAMPLE = 5


@dataclass(frozen=True)
class Guess:
    columns: tuple[str, ...] = ()
    samples: tuple[tuple[str, ...], ...] = ()
    separator: str = ","
    delimiter: str = '"'
    header_line: int = 1
    record_element: str | None = None
    types: tuple[str, ...] = ()


def sniff_csv(spark: SparkSession, path: str, header_line: int = 1, separator: str | None = None) -> Guess:
    """The separator under which the header has most columns and most sample rows fit it; and sample rows."""
    try:
        lines = [r.value.rstrip("\r") for r in spark.read.text(path).head(header_line + SAMPLE)]
    except Exception:
        return Guess()
    if len(lines) < header_line:
        return Guess()
    header, rows = lines[header_line - 1], [x for x in lines[header_line:] if x.strip()]
    best, chosen = -1, SEPARATORS[0]
    for s in (separator,) if separator else SEPARATORS:
        width = len(split_line(header, s, '"'))
        score = 100 * width + sum(len(split_line(r, s, '"')) == width for r in rows)
        if score > best:
            best, chosen = score, s
    names = unique_names([x.strip() for x in split_line(header, chosen, '"')])
    samples = tuple(tuple(x.strip() for x in split_line(r, chosen, '"')) for r in rows)
    types = tuple(column_type([r[i] for r in samples if i < len(r)]) for i in range(len(names)))
    return Guess(tuple(names), samples, chosen, '"', header_line, None, types)


def sniff_xml(spark: SparkSession, path: str, record: str | None = None) -> Guess:
    from weft.sources import xml_table

    try:
        record, columns = xml_table.record_schema(spark, path, record)
    except (PlanError, ValueError):
        return Guess()
    return Guess(tuple(c.name for c in columns), (), record_element=record, types=tuple(c.type for c in columns))


def unique_names(names: list[str]) -> list[str]:
    """Blank names become 'column'; a name that was there before gets _1, _2 and so on."""
    used: set[str] = set()
    out = []
    for n in names:
        n = n or "column"
        k, unique = 0, n
        while unique.lower() in used:
            k += 1
            unique = f"{n}_{k}"
        used.add(unique.lower())
        out.append(unique)
    return out


def text_type(text: str) -> str:
    if re.fullmatch(r"-?\d+", text):
        return "INT"
    try:
        float(text)
        return "DOUBLE"
    except ValueError:
        return "BOOLEAN" if text.lower() in ("true", "false") else "STRING"


def column_type(samples: list[str]) -> str:
    """The type that most samples have; whole numbers among decimal ones are decimal."""
    kinds = Counter(text_type(s) for s in samples if s)
    if not kinds:
        return "STRING"
    if set(kinds) == {"INT", "DOUBLE"}:
        return "DOUBLE"
    return kinds.most_common(1)[0][0]


def columns_of(guess: Guess) -> tuple[Column, ...]:
    return tuple(Column(n, t) for n, t in zip(guess.columns, guess.types, strict=True))
