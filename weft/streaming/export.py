"""Rows as CSV or SQL text.

``export`` gives an iterator of lines on the driver, for a result that streams through it; ``write`` has the executors
write the same lines, a file a partition, for a result of any size.
"""

from __future__ import annotations

import csv
import io
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.streaming.results import SchemaColumn

# Names of the document types in MySQL.
SQL_TYPES = {"INT": "INT", "LONG": "BIGINT", "FLOAT": "FLOAT", "DOUBLE": "DOUBLE", "BOOLEAN": "BOOLEAN", "STRING": "TEXT"}
#: What a backslash and a quote become within a quoted text.
ESCAPES = {"\\": "\\\\", "'": "\\'"}


def headers(schema: list[SchemaColumn]) -> list[str]:
    """Bare names; every name with its source if two are the same."""
    twice = max(Counter(c.name for c in schema).values(), default=0) > 1
    return [f"{c.source}.{c.name}" if twice else c.name for c in schema]


class _Lines:
    """A file for the csv writer that hands on what is written to it."""

    def write(self, text: str) -> str:
        return text


def _csv(table: str, schema: list[SchemaColumn], rows: Iterable) -> Iterator[str]:
    write = csv.writer(_Lines(), lineterminator="\r\n").writerow
    yield write(headers(schema))
    for row in rows:
        cells = [str(x).lower() if isinstance(x, bool) else x for x in row]
        yield "\r\n" if cells == [None] else write(cells)  # the writer would quote a lone empty cell


def _quoted(text: str) -> str:
    return "'" + text.translate(str.maketrans(ESCAPES)) + "'"


#: How a value is written in SQL, by its type; any other as quoted text.
_SQL_VALUES = {type(None): lambda _: "NULL", bool: lambda x: str(x).upper(), int: str, float: str}


def _name(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _create(table: str, schema: list[SchemaColumn]) -> str:
    names = [_name(h) for h in headers(schema)]
    lines = [f"{n} {SQL_TYPES.get(c.type, SQL_TYPES['STRING'])}" for n, c in zip(names, schema, strict=True)]
    if key := ", ".join(n for n, c in zip(names, schema, strict=True) if c.primary_key):
        lines.append(f"PRIMARY KEY ({key})")
    return "".join([f"CREATE TABLE IF NOT EXISTS {_name(table)} (\n", ",\n".join("    " + x for x in lines), "\n);\n\n"])


def _insert(table: str, schema: list[SchemaColumn]) -> str:
    return f"INSERT INTO {_name(table)} ({', '.join(map(_name, headers(schema)))}) VALUES ("


def _sql(table: str, schema: list[SchemaColumn], rows: Iterable) -> Iterator[str]:
    yield _create(table, schema)
    head = _insert(table, schema)
    for row in rows:
        yield head + ", ".join(_SQL_VALUES.get(type(x), lambda x: _quoted(str(x)))(x) for x in row) + ");\n"


FORMATS = {"CSV": _csv, "SQL": _sql}


def _known(form: str) -> str:
    if form.upper() not in FORMATS:
        raise ValueError(f"unknown format '{form}'; there are {', '.join(FORMATS)}")
    return form.upper()


def export(form: str, table: str, schema: list[SchemaColumn], rows: Iterable) -> Iterator[str]:
    return FORMATS[_known(form)](table, schema, rows)


def _sql_value(column: Column, kind: str) -> Column:
    if kind == "string":
        text = F.lit("'")
        escaped = column
        for a, b in ESCAPES.items():
            escaped = F.replace(escaped, F.lit(a), F.lit(b))
        text = F.concat(text, escaped, F.lit("'"))
    else:
        text = F.upper(column.cast("string")) if kind == "boolean" else column.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def write(form: str, table: str, schema: list[SchemaColumn], frame: DataFrame, path: str) -> None:
    """Files of ``frame``'s rows under ``path``: CSV each with a header, or SQL statements, the table's own in the first lines
    of a folder "create" beside "rows"."""
    form, names = _known(form), headers(schema)
    frame = frame.toDF(*names)
    if form == "CSV":
        frame.write.csv(path, header=True, quote='"', escape='"', lineSep="\n", emptyValue="", nullValue="")
        return
    spark = frame.sparkSession
    spark.createDataFrame([(_create(table, schema).rstrip("\n"),)], "value string").coalesce(1).write.text(f"{path}/create")
    values = [_sql_value(F.col(_name(n)), kind) for n, (_, kind) in zip(names, frame.dtypes, strict=True)]
    frame.select(F.concat(F.lit(_insert(table, schema)), F.concat_ws(", ", *values), F.lit(");")).alias("value")).write.text(f"{path}/rows")


def text(form: str, table: str, schema: list[SchemaColumn], rows: Iterable) -> str:
    """The whole export as one string, for small results."""
    out = io.StringIO()
    out.writelines(export(form, table, schema, rows))
    return out.getvalue()
