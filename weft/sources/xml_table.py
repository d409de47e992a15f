"""XML records as flat rows.

Spark's reader finds the records (at any depth) and turns each into a struct; nested elements and attributes become
columns such as ``address.zip``, ``@id`` and ``address.@kind``.  Of an element that repeats, the last one counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.errors import PlanError
from weft.operators.relation import SPARK_TYPES
from weft.plans import model as m

# An attribute's value may hold ">", but no "<".
_TAG = re.compile(r"""<(/?)([A-Za-z_][\w.:-]*)((?:"[^"<]*"|'[^'<]*'|[^<>"'])*?)(/?)>""")
_UNFINISHED = re.compile(r"""</?(?:[A-Za-z_][\w.:-]*(?:"[^"<]*"|'[^'<]*'|[^<>"'])*(?:"[^"<]*|'[^'<]*)?)?\Z""")
_SKIPPED = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>"}


def head(spark: SparkSession, path: str, size: int = 1 << 20) -> str:
    """The beginning of a file, through Spark's readers, without what is no element."""
    try:
        rows = spark.read.text(path).head(20_000)
    except Exception as error:
        raise PlanError(f"'{path}' can't be read: {str(error).splitlines()[0]}") from error
    text = "\n".join(r.value for r in rows)[:size]
    if re.search(r"<!DOCTYPE", text, re.I):
        raise PlanError(f"'{path}' has a DOCTYPE, which isn't read")
    return re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>", "", text, flags=re.S)


def lines(spark: SparkSession, path: str) -> Iterator[str]:
    """All lines, one partition at a time; files of a folder by name."""
    files = spark.read.text(path).inputFiles()
    for file in [path] if len(files) == 1 else sorted(map(unquote, files)):
        yield from (f"{r.value}\n" for r in spark.read.text(file).toLocalIterator())


def tags(text: Iterable[str]) -> Iterator[tuple[str, str, str, str]]:
    """The tags of a text in pieces, of which no more is held than what is not finished."""
    held, until = "", None
    for piece in text:
        held, at = held + piece, 0
        while True:
            if until:
                end = held.find(until, at)
                if end < 0:
                    at = max(at, len(held) - len(until) + 1)
                    break
                at, until = end + len(until), None
            start = held.find("<", at)
            if start < 0:
                at = len(held)
                break
            opened = next((k for k in _SKIPPED if held.startswith(k, start)), None)
            if opened:
                at, until = start + len(opened), _SKIPPED[opened]
            elif found := _TAG.match(held, start):
                yield found.groups()
                at = found.end()
            elif _UNFINISHED.match(held, start) or any(k.startswith(held[start:]) for k in _SKIPPED):
                at = start
                break
            else:
                at = start + 1
        held = held[at:]


def record_element(spark: SparkSession, path: str) -> str:
    """The most frequent child of the root in the whole file, the first of those in a tie."""
    head(spark, path)
    depth, children = 0, Counter()
    for closing, name, _, empty in tags(lines(spark, path)):
        if closing:
            depth -= 1
            continue
        if depth == 1:
            children[name] += 1
        depth += not empty
    if not children:
        raise PlanError(f"'{path}' has no records")
    return children.most_common(1)[0][0]


def read(spark: SparkSession, path: str, tag: str) -> DataFrame:
    head(spark, path)
    try:
        return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "@").option("valueTag", "#text").option("inferSchema", "false").option("nullValue", "").load(path)
    except Exception as error:
        raise PlanError(f"'{path}' can't be read: {str(error).splitlines()[0]}") from error


def flattened(schema: T.StructType, column: SparkColumn | None = None, prefix: str = "") -> dict[str, SparkColumn]:
    """Flat column names for what a record's struct holds."""
    out: dict[str, SparkColumn] = {}
    for f in schema:
        value = F.col(f"`{f.name}`") if column is None else column.getField(f.name)
        kind = f.dataType
        if isinstance(kind, T.ArrayType):
            value, kind = F.element_at(value, -1), kind.elementType
        if f.name == "#text":
            out[prefix[:-1] if prefix else "value"] = value
        elif isinstance(kind, T.StructType):
            out |= flattened(kind, value, f"{prefix}{f.name}.")
        else:
            out[prefix + f.name] = value
    return out


def typed(value: SparkColumn | None, kind: str) -> SparkColumn:
    if value is None:
        return F.lit(None).cast(SPARK_TYPES[kind])
    text = F.trim(value.cast("string"))
    empty = text == ""
    if kind == "BOOLEAN":
        return F.when(~empty, F.lower(text) == "true")
    return F.when(~empty, text if kind == "STRING" else text.try_cast(SPARK_TYPES[kind]))


def nested_columns(spark: SparkSession, path: str, record: str, columns: tuple[m.Column, ...]) -> tuple[DataFrame, list[SparkColumn]]:
    df = read(spark, path, record)
    flat = flattened(df.schema)
    return df, [typed(flat.get(c.name), c.type) for c in columns]


def json_columns(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records with each nested element as a column of JSON text."""
    df = read(spark, path, record)
    nested = lambda f: isinstance(f.dataType, T.StructType | T.ArrayType)
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if nested(f) else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])


def separate_table(spark: SparkSession, path: str, parent: str, child: str, columns: tuple[m.Column, ...]) -> tuple[DataFrame, list[SparkColumn]]:
    """A row for each child element of a parent, with ``parent_id``: the parent's id, or a hash of it."""
    df = read(spark, path, parent)
    if child not in df.columns:
        raise PlanError(f"'{parent}' has no element '{child}'")
    own = {f.name: f for f in df.schema}
    ids = [n for n in ("@id", "id", f"@{parent}_id", f"{parent}_id") if n in own and not isinstance(own[n].dataType, T.StructType | T.ArrayType)]
    key = F.coalesce(*[F.col(f"`{n}`").cast("string") for n in ids], F.sha2(F.to_json(F.struct("*")), 256))
    many = F.col(f"`{child}`")
    kind = own[child].dataType
    rows = df.select(key.alias("parent_id"), F.explode(many if isinstance(kind, T.ArrayType) else F.array(many)).alias("row"))
    inner = rows.schema["row"].dataType
    flat = flattened(inner, F.col("row")) if isinstance(inner, T.StructType) else {"value": F.col("row")}
    flat = flat | {"parent_id": F.col("parent_id")}
    return rows, [typed(flat.get(c.name), c.type) for c in columns]


def record_schema(spark: SparkSession, path: str, record: str | None = None, sample: int = 100) -> tuple[str, list[m.Column]]:
    """The record element and the columns of the first records: INT, DOUBLE or STRING, text where they disagree."""
    record = record or record_element(spark, path)
    df = read(spark, path, record)
    flat = flattened(df.schema)
    rows = df.select(*[v.cast("string").alias(f"v{i}") for i, v in enumerate(flat.values())]).head(sample)
    out = []
    for i, name in enumerate(flat):
        values = [r[i].strip() for r in rows if r[i] is not None and r[i].strip()]
        kind = "STRING"
        if values and all(re.fullmatch(r"[+-]?\d{1,9}", v) for v in values):
            kind = "INT"
        elif values and all(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) for v in values):
            kind = "DOUBLE"
        out.append(m.Column(name, kind))
    return record, out
