"""Tables as relations: in memory, CSV, XML, and Parquet (also for B-tree tables)."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.errors import PlanError
from weft.operators.relation import SPARK_TYPES, Field, Relation, SourceFields, fresh, type_name
from weft.plans import model as m

#: What stands for an empty CSV value in sentinel mode.
SENTINELS = {"STRING": "", "INT": -(2**31), "LONG": -(2**63), "FLOAT": 1.401298464324817e-45, "DOUBLE": 5e-324, "BOOLEAN": False}
_PYTHON = {"INT": int, "LONG": int, "FLOAT": float, "DOUBLE": float, "STRING": str, "BOOLEAN": bool}


def open_table(spark: SparkSession, table: m.Table, alias: str, options) -> Relation:
    match table:
        case m.MemoryTable():
            return _memory(spark, table, alias)
        case m.CsvTable():
            return _csv(spark, table, alias, options.csv_nulls)
        case m.XmlTable():
            return _xml(spark, table, alias)
        case m.BTreeTable():
            return _parquet(spark, table.path, None, alias)
        case m.ParquetTable():
            return _parquet(spark, table.path, table.keys, alias)
    raise PlanError(f"unknown table {table!r}")


def _relation(df: DataFrame, columns: tuple[m.Column, ...], values: list[SparkColumn], alias: str, order: SparkColumn) -> Relation:
    names, ordinal = [fresh() for _ in columns], fresh("o")
    df = df.select(*[v.alias(n) for v, n in zip(values, names, strict=True)], order.alias(ordinal))
    fields = tuple(Field(c.name, n, c.type, c.primary_key) for c, n in zip(columns, names, strict=True))
    return Relation(df, (SourceFields(alias, fields),), ((ordinal, True),))


def _memory(spark: SparkSession, table: m.MemoryTable, alias: str) -> Relation:
    columns = m.validate_columns(table.columns)
    kinds = {c.name: c.type for c in columns}
    rows = []
    for i, row in enumerate(table.rows):
        cells = dict(row)
        unknown = [c for c in cells if c not in kinds]
        if unknown:
            raise PlanError(f"table '{table.name}' has no column '{unknown[0]}'")
        rows.append((i, *[None if cells.get(c) is None else _PYTHON[k](cells[c].value) for c, k in kinds.items()]))
    schema = T.StructType([T.StructField("o", T.LongType())] + [T.StructField(f"v{i}", SPARK_TYPES[c.type]) for i, c in enumerate(columns)])
    df = spark.createDataFrame(rows, schema)
    return _relation(df, columns, [F.col(f"v{i}") for i in range(len(columns))], alias, F.col("o"))


def parsed(text: SparkColumn, kind: str, nulls: str) -> SparkColumn:
    """A CSV value: empty, blank or 'null' is NULL or the type's sentinel; what doesn't parse is NULL."""
    trimmed = F.trim(text)
    empty = text.isNull() | (trimmed == "") | (F.lower(trimmed) == "null")
    value = text if kind == "STRING" else F.lower(trimmed) == "true" if kind == "BOOLEAN" else trimmed.try_cast(SPARK_TYPES[kind])
    missing = F.lit(None) if nulls == "null" else F.lit(SENTINELS[kind])
    return F.when(empty, missing.cast(SPARK_TYPES[kind])).otherwise(value)


def csv_records(spark: SparkSession, table: m.CsvTable) -> tuple[list[str], DataFrame]:
    """The header's fields, and value and ordinal of each line after a file's header; ordinals follow files and lines.

    A folder's files each have the header, and the same one.  Lines are numbered within a part of a file by Spark's own
    numbers, which only ascend; those of a file's first part less the smallest among them are line numbers.  The smallest
    ones are a row a file.
    """
    part = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(table.path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("id"), *part)
    firsts = lines.filter("block = 0").groupBy("file").agg(F.min("id").alias("first"))
    lines = lines.join(firsts, "file").withColumn("line", F.when(F.col("block") == 0, F.col("id") - F.col("first")))
    heads = [r.value for r in lines.filter(F.col("line") == table.header_line - 1).select("value").distinct().limit(2).collect()]
    if not heads:
        raise PlanError(f"table '{table.name}' has no header on line {table.header_line}")
    if len(heads) > 1:
        raise PlanError(f"the files of '{table.name}' have different headers: {heads[0]!r} and {heads[1]!r}")
    kept = lines.filter((F.col("line").isNull() | (F.col("line") >= table.header_line)) & (F.trim("value") != ""))
    return split_line(heads[0], table.separator, table.delimiter), kept.select("value", F.struct("file", "block", "id").alias("ordinal"))


def _csv(spark: SparkSession, table: m.CsvTable, alias: str, nulls: str) -> Relation:
    """One record a line; the header is line ``header_line``, and declared columns are found in it by name."""
    columns = m.validate_columns(table.columns)
    try:
        header, lines = csv_records(spark, table)
    except PlanError:
        raise
    except Exception as error:
        raise PlanError(f"table '{table.name}' can't be read: {str(error).splitlines()[0]}") from error
    if lines.isEmpty():
        raise PlanError(f"table '{table.name}' has no line after its header")
    header = [h.strip() for h in header]
    place = {h.lower(): i for i, h in reversed(list(enumerate(header)))}
    for c in columns:
        if c.name.lower() not in place:
            raise PlanError(f"column '{c.name}' not found in the header of '{table.name}'")
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(len(header))])
    options = {"sep": table.separator, "quote": table.delimiter, "escape": table.delimiter, "mode": "PERMISSIVE"}
    record = F.from_csv(F.col("value"), schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    read = lines.select("ordinal", record.alias("r"))
    values = [parsed(F.col(f"r.f{place[c.name.lower()]}"), c.type, nulls) for c in columns]
    return _relation(read, columns, values, alias, F.col("ordinal"))


def split_line(line: str, separator: str, delimiter: str) -> list[str]:
    """The fields of a line; a field may stand in delimiters, a doubled one inside is one."""
    out, at, size = [], 0, len(line)
    while True:
        if at < size and line[at] == delimiter:
            part, at = [], at + 1
            while at < size:
                if line[at] != delimiter:
                    part.append(line[at])
                elif at + 1 < size and line[at + 1] == delimiter:
                    part.append(delimiter)
                    at += 1
                else:
                    break
                at += 1
            at += 1
            end = line.find(separator, at)
            end = size if end < 0 else end
            out.append("".join(part) + line[at:end].strip())
        else:
            end = line.find(separator, at)
            end = size if end < 0 else end
            out.append(line[at:end])
        if end >= size:
            return out
        at = end + len(separator)


def _xml(spark: SparkSession, table: m.XmlTable, alias: str) -> Relation:
    from weft.sources import xml_table

    columns = m.validate_columns(table.columns)
    record = table.record_element or xml_table.record_element(spark, table.path)
    if record.startswith("SEPARATE_TABLE:"):
        df, values = xml_table.separate_table(spark, table.path, *record.split(":")[1:3], columns)
    else:
        df, values = xml_table.nested_columns(spark, table.path, record, columns)
    return _relation(df, columns, values, alias, F.monotonically_increasing_id())


def _parquet(spark: SparkSession, path: str, keys: tuple[str, ...] | None, alias: str) -> Relation:
    try:
        df = spark.read.parquet(path)
    except Exception as error:
        raise PlanError(f"'{path}' can't be read: {str(error).splitlines()[0]}") from error
    if keys is None:  # a B-tree table says in its schema which columns are its key
        keys = tuple(f.name for f in df.schema if f.metadata.get("pk"))
    fields = [Field(f.name, fresh(), type_name(f.dataType), f.name in keys) for f in df.schema]
    fields.sort(key=lambda f: not f.primary_key)
    df = df.select(*[F.col(f"`{f.name}`").alias(f.physical) for f in fields])
    order = tuple((f.physical, True) for k in keys for f in fields if f.name == k)
    return Relation(df, (SourceFields(alias, tuple(fields)),), order)


def write_btree(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """A clustered table: Parquet dealt and sorted by its key, so that row groups cover narrow key ranges."""
    marked = df.select(*[F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata | {"pk": True}) if f.name in keys else F.col(f"`{f.name}`") for f in df.schema])
    dealt = marked.repartitionByRange(partitions, *keys) if partitions else marked.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.parquet(path)


