"""The document model: tables, conditions and the operators of a graph, as plain immutable values.

Every class checks itself when it is made, so that a value that exists is well formed.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

PLACEHOLDER = "?"

# Names in documents.
TYPES = ("INT", "LONG", "FLOAT", "DOUBLE", "STRING", "BOOLEAN")
COMPARISONS = ("EQ", "NEQ", "GT", "GTE", "LT", "LTE")
AGGREGATES = ("MAX", "MIN", "COUNT", "AVG", "SUM", "FIRST", "LAST", "COUNT_ALL", "COUNT_NULL")
JOIN_TYPES = ("INNER", "LEFT", "RIGHT", "FULL", "LEFT_SEMI", "RIGHT_SEMI", "LEFT_ANTI", "RIGHT_ANTI")
ALGORITHMS = ("NESTED_LOOP", "HASH", "MERGE")
SET_KINDS = ("UNION", "INTERSECT", "EXCEPT", "APPEND")
LOGICAL_KINDS = ("AND", "OR", "XOR")


def split_reference(reference: str) -> tuple[str | None, str]:
    """(source, column), cut at the first dot; without a dot there is no source."""
    source, dot, column = reference.partition(".")
    return (source, column) if dot else (None, reference)


def _check(holds: bool, message: str) -> None:
    if not holds:
        raise ValueError(message)


def _filled(value: str, what: str) -> None:
    _check(bool(value and value.strip()), f"{what} must not be blank")


def _qualified(reference: str) -> None:
    source, column = split_reference(reference)
    _check(bool(source and source.strip() and column.strip()), f"'{reference}' must name its source, as in 'o.{reference}'")


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> None:
    _check(value in allowed, f"{what} '{value}' is not one of {', '.join(allowed)}")


# Tables


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    primary_key: bool = False
    nullable: bool = True

    def __post_init__(self):
        _filled(self.name, "a column's name")
        _check(len(self.name) <= 240, f"column '{self.name[:20]}...' has more than 240 characters")
        _one_of(self.type, TYPES, "column type")


@dataclass(frozen=True)
class Literal:
    """A typed constant; ``tag`` is int, long, float, double, bool or str."""

    tag: str
    value: Any

    def __post_init__(self):
        _one_of(self.tag, ("int", "long", "float", "double", "bool", "str"), "literal tag")


@dataclass(frozen=True)
class Ref:
    column: str

    def __post_init__(self):
        _filled(self.column, "a referenced column")


@dataclass(frozen=True)
class MemoryTable:
    name: str
    columns: tuple[Column, ...]
    rows: tuple[tuple[tuple[str, Literal | None], ...], ...] = ()


@dataclass(frozen=True)
class CsvTable:
    name: str
    path: str
    columns: tuple[Column, ...]
    separator: str = ","
    delimiter: str = '"'
    header_line: int = 1


@dataclass(frozen=True)
class XmlTable:
    name: str
    path: str
    columns: tuple[Column, ...]
    root_element: str | None = None
    record_element: str | None = None


@dataclass(frozen=True)
class BTreeTable:
    """A table clustered by its primary key. Here its files are Parquet, written sorted by that key."""

    name: str
    path: str
    cache_size: int = 100_000


@dataclass(frozen=True)
class ParquetTable:
    """Parquet files with the schema they have; ``keys`` name the primary key, which also gives the row order."""

    name: str
    path: str
    keys: tuple[str, ...] = ()


Table = MemoryTable | CsvTable | XmlTable | BTreeTable | ParquetTable


def validate_columns(columns: tuple[Column, ...]) -> tuple[Column, ...]:
    """The columns with the primary key in front, or an error that says what is wrong with them."""
    _check(bool(columns), "a table needs at least one column")
    seen: set[str] = set()
    for c in columns:
        _check(not (c.primary_key and c.nullable), f"primary key '{c.name}' must not be nullable")
        _check(not (c.primary_key and c.type == "STRING"), f"primary key '{c.name}' must have a fixed size, not STRING")
        _check(c.name.lower() not in seen, f"column '{c.name}' is there twice")
        seen.add(c.name.lower())
    return tuple(sorted(columns, key=lambda c: not c.primary_key))


# Conditions


@dataclass(frozen=True)
class Comparison:
    left: str
    op: str
    right: Literal | Ref

    def __post_init__(self):
        _filled(self.left, "a compared column")
        _one_of(self.op, COMPARISONS, "comparison")


@dataclass(frozen=True)
class IsNull:
    column: str


@dataclass(frozen=True)
class IsNotNull:
    column: str


@dataclass(frozen=True)
class And:
    conditions: tuple["Condition", ...]

    def __post_init__(self):
        _check(len(self.conditions) >= 2, "and() needs two conditions or more")


@dataclass(frozen=True)
class Or:
    conditions: tuple["Condition", ...]

    def __post_init__(self):
        _check(len(self.conditions) >= 2, "or() needs two conditions or more")


Condition = Comparison | IsNull | IsNotNull | And | Or


# Operators


@dataclass(frozen=True)
class SortKey:
    column: str
    ascending: bool = True


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: str

    def __post_init__(self):
        _one_of(self.function, AGGREGATES, "aggregate")


@dataclass(frozen=True)
class JoinTerm:
    left: str
    right: str

    def __post_init__(self):
        _qualified(self.left)
        _qualified(self.right)


class Node:
    """An operator. ``kind`` names it in documents; ``ports`` are its inputs."""

    kind = ""
    ports: tuple[str, ...] = ("ONLY",)


class Source(Node):
    ports = ()


class Binary(Node):
    ports = ("LEFT", "RIGHT")


@dataclass(frozen=True)
class TableNode(Source):
    table: int
    alias: str
    kind = "table"

    def __post_init__(self):
        _filled(self.alias, "a table's alias")


@dataclass(frozen=True)
class ConditionNode(Source):
    condition: Condition
    alias: str = "condition"
    kind = "condition"

    def __post_init__(self):
        _filled(self.alias, "a condition's alias")


@dataclass(frozen=True)
class ReferenceNode(Source):
    columns: tuple[str, ...]
    alias: str = "ref"
    kind = "reference"

    def __post_init__(self):
        _check(bool(self.columns), "a reference needs at least one column")
        for c in self.columns:
            _qualified(c)
        _filled(self.alias, "a reference's alias")


@dataclass(frozen=True)
class FilterNode(Node):
    condition: Condition
    kind = "filter"


@dataclass(frozen=True)
class ProjectNode(Node):
    columns: tuple[str, ...]
    kind = "project"

    def __post_init__(self):
        _check(bool(self.columns), "a projection needs at least one column")


@dataclass(frozen=True)
class SortNode(Node):
    keys: tuple[SortKey, ...]
    kind = "sort"

    def __post_init__(self):
        _check(bool(self.keys), "a sort needs at least one key")
        _check(len({k.ascending for k in self.keys}) == 1, "all sort keys have one direction")


@dataclass(frozen=True)
class DistinctNode(Node):
    hashed: bool = True
    kind = "distinct"


@dataclass(frozen=True)
class LimitNode(Node):
    count: int
    offset: int = 0
    kind = "limit"

    def __post_init__(self):
        _check(self.count > 0, "a limit must be positive")
        _check(self.offset >= 0, "an offset must not be negative")


@dataclass(frozen=True)
class AliasNode(Node):
    from_: str
    to: str
    kind = "alias"

    def __post_init__(self):
        _filled(self.from_, "the name to change")
        _filled(self.to, "the new name")


@dataclass(frozen=True)
class CollapseNode(Node):
    alias: str
    kind = "collapse"

    def __post_init__(self):
        _filled(self.alias, "a collapse's alias")


@dataclass(frozen=True)
class ExplodeNode(Node):
    column: str
    delimiter: str = ","
    kind = "explode"

    def __post_init__(self):
        _filled(self.column, "the column to explode")
        _check(bool(self.delimiter), "explode needs a delimiter")


@dataclass(frozen=True)
class RowNumberNode(Node):
    alias: str
    column: str
    start: int = 1
    kind = "rowNumber"

    def __post_init__(self):
        _filled(self.alias, "a row number's alias")
        _filled(self.column, "a row number's column")


@dataclass(frozen=True)
class AggNode(Node):
    alias: str
    by: str | None = None
    aggregates: tuple[Aggregate, ...] = ()
    hashed: bool = True
    kind = "agg"

    def __post_init__(self):
        _filled(self.alias, "an aggregation's alias")
        _check(bool(self.aggregates), "an aggregation needs at least one aggregate")
        if self.by is not None:
            _qualified(self.by)


@dataclass(frozen=True)
class RemoveColumnsNode(Node):
    columns: tuple[str, ...]
    alias: str = "Projection"
    kind = "removeColumns"

    def __post_init__(self):
        _check(bool(self.columns), "removing columns needs at least one column")
        _filled(self.alias, "the alias of what is left")


@dataclass(frozen=True)
class MaterializeNode(Node):
    kind = "materialize"


@dataclass(frozen=True)
class MemoizeNode(Node):
    kind = "memoize"


@dataclass(frozen=True)
class HashIndexNode(Node):
    kind = "hashIndex"


@dataclass(frozen=True)
class ScanNode(Node):
    kind = "scan"


@dataclass(frozen=True)
class JoinNode(Binary):
    type: str = "INNER"
    algorithm: str = "NESTED_LOOP"
    on: tuple[JoinTerm, ...] = ()
    kind = "join"

    def __post_init__(self):
        _one_of(self.type, JOIN_TYPES, "join type")
        _one_of(self.algorithm, ALGORITHMS, "join algorithm")
        _check(bool(self.on) or self.algorithm == "NESTED_LOOP", "this join needs at least one equality")


@dataclass(frozen=True)
class CrossNode(Binary):
    kind = "cross"


@dataclass(frozen=True)
class SetOpNode(Binary):
    kind_: str = field(metadata={"name": "kind"})
    hashed: bool = True
    alias: str = ""
    kind = "setOp"

    def __post_init__(self):
        _one_of(self.kind_, SET_KINDS, "set operation")


@dataclass(frozen=True)
class LogicalOpNode(Binary):
    kind_: str = field(metadata={"name": "kind"})
    alias: str = "condition"
    kind = "logicalOp"

    def __post_init__(self):
        _one_of(self.kind_, LOGICAL_KINDS, "logical operation")
        _filled(self.alias, "a logical operation's alias")


@dataclass(frozen=True)
class ExistsNode(Binary):
    bilateral: bool = False
    kind = "exists"


NODES: dict[str, type[Node]] = {
    n.kind: n
    for n in (
        TableNode, ConditionNode, ReferenceNode, FilterNode, ProjectNode, SortNode, DistinctNode, LimitNode, AliasNode, CollapseNode, ExplodeNode,
        RowNumberNode, AggNode, RemoveColumnsNode, MaterializeNode, MemoizeNode, HashIndexNode, ScanNode, JoinNode, CrossNode, SetOpNode, LogicalOpNode, ExistsNode,
    )
}


def own_alias(node: Node) -> str | None:
    """The source a node names in its output, if it names one. INTERSECT and EXCEPT keep their left input's names."""
    if isinstance(node, SetOpNode) and node.kind_ not in ("UNION", "APPEND"):
        return None
    return getattr(node, "alias", None) or None
