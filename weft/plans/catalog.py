"""The palette of operators, captions for nodes, and renaming a source with everything that reads it."""

from __future__ import annotations

import dataclasses
import string
import typing
from dataclasses import dataclass

from weft.plans import graph as g
from weft.plans import model as m

CATEGORIES = ("Algebra", "Aggregation", "ETL", "Index", "Joins", "SemiAntiJoins", "Sets", "Boolean")


@dataclass(frozen=True)
class Chip:
    """An entry of the palette: a key, a symbol, and the node it starts as."""

    key: str
    symbol: str
    category: str
    template: m.Node

    @property
    def type(self) -> str:
        return self.template.kind


def _join(kind: str, algorithm: str) -> m.JoinNode:
    blank = f"{m.PLACEHOLDER}.{m.PLACEHOLDER}"
    return m.JoinNode(kind, algorithm, (m.JoinTerm(blank, blank),))


_ANY = m.Comparison(m.PLACEHOLDER, "EQ", m.Literal("str", m.PLACEHOLDER))
# Keys, symbols and categories of the palette, in its order.
CHIPS: tuple[Chip, ...] = (
    Chip("filter", "σ", "Algebra", m.FilterNode(_ANY)),
    Chip("projection", "π", "Algebra", m.ProjectNode((m.PLACEHOLDER,))),
    Chip("selectColumns", "S", "Algebra", m.RemoveColumnsNode((m.PLACEHOLDER,))),
    Chip("rename", "ρ", "Algebra", m.AliasNode(m.PLACEHOLDER, m.PLACEHOLDER)),
    Chip("sort", "↕", "Algebra", m.SortNode((m.SortKey(m.PLACEHOLDER),))),
    Chip("limit", "L", "Algebra", m.LimitNode(10)),
    Chip("duplicateRemoval", "Δ", "Algebra", m.DistinctNode(False)),
    Chip("hashDuplicateRemoval", "#Δ", "Algebra", m.DistinctNode(True)),
    Chip("aggregation", "∑", "Aggregation", m.AggNode("agg", None, (m.Aggregate("COUNT", m.PLACEHOLDER),))),
    Chip("collapse", "{}", "Aggregation", m.CollapseNode("collapse")),
    Chip("explode", "E", "ETL", m.ExplodeNode(m.PLACEHOLDER)),
    Chip("autoInc", "A", "ETL", m.RowNumberNode("row", m.PLACEHOLDER)),
    Chip("hash", "#", "Index", m.HashIndexNode()),
    Chip("memoize", "ℳ", "Index", m.MemoizeNode()),
    Chip("materialization", "⧉", "Index", m.MaterializeNode()),
    Chip("scan", "→", "Index", m.ScanNode()),
    Chip("reference", "R", "Index", m.ReferenceNode((f"{m.PLACEHOLDER}.{m.PLACEHOLDER}",))),
    Chip("join", "|X|", "Joins", _join("INNER", "NESTED_LOOP")),
    Chip("mergeJoin", "↕|X|", "Joins", _join("INNER", "MERGE")),
    Chip("hashJoin", "#|X|", "Joins", _join("INNER", "HASH")),
    Chip("leftOuterJoin", "⟕", "Joins", _join("LEFT", "NESTED_LOOP")),
    Chip("rightOuterJoin", "⟖", "Joins", _join("RIGHT", "NESTED_LOOP")),
    Chip("mergeLeftOuterJoin", "↕⟕", "Joins", _join("LEFT", "MERGE")),
    Chip("mergeRightOuterJoin", "↕⟖", "Joins", _join("RIGHT", "MERGE")),
    Chip("mergeFullOuterJoin", "↕⟗", "Joins", _join("FULL", "MERGE")),
    Chip("hashLeftOuterJoin", "#⟕", "Joins", _join("LEFT", "HASH")),
    Chip("hashRightOuterJoin", "#⟖", "Joins", _join("RIGHT", "HASH")),
    Chip("hashFullOuterJoin", "#⟗", "Joins", _join("FULL", "HASH")),
    Chip("cartesianProduct", "✕", "Joins", m.CrossNode()),
    Chip("semiJoin", "⋉", "SemiAntiJoins", _join("LEFT_SEMI", "NESTED_LOOP")),
    Chip("mergeLeftSemiJoin", "↕⋉", "SemiAntiJoins", _join("LEFT_SEMI", "MERGE")),
    Chip("mergeRightSemiJoin", "↕⋊", "SemiAntiJoins", _join("RIGHT_SEMI", "MERGE")),
    Chip("hashLeftSemiJoin", "#⋉", "SemiAntiJoins", _join("LEFT_SEMI", "HASH")),
    Chip("hashRightSemiJoin", "#⋊", "SemiAntiJoins", _join("RIGHT_SEMI", "HASH")),
    Chip("antiJoin", "▷", "SemiAntiJoins", _join("LEFT_ANTI", "NESTED_LOOP")),
    Chip("mergeLeftAntiJoin", "↕▷", "SemiAntiJoins", _join("LEFT_ANTI", "MERGE")),
    Chip("mergeRightAntiJoin", "↕◁", "SemiAntiJoins", _join("RIGHT_ANTI", "MERGE")),
    Chip("hashLeftAntiJoin", "#▷", "SemiAntiJoins", _join("LEFT_ANTI", "HASH")),
    Chip("hashRightAntiJoin", "#◁", "SemiAntiJoins", _join("RIGHT_ANTI", "HASH")),
    Chip("append", "+", "Sets", m.SetOpNode("APPEND", False)),
    Chip("union", "∪", "Sets", m.SetOpNode("UNION", False)),
    Chip("hashUnion", "#∪", "Sets", m.SetOpNode("UNION", True)),
    Chip("intersection", "∩", "Sets", m.SetOpNode("INTERSECT", False)),
    Chip("hashIntersection", "#∩", "Sets", m.SetOpNode("INTERSECT", True)),
    Chip("difference", "-", "Sets", m.SetOpNode("EXCEPT", False)),
    Chip("hashDifference", "#-", "Sets", m.SetOpNode("EXCEPT", True)),
    Chip("unilateralExistence", "∃⟗", "Sets", m.ExistsNode(False)),
    Chip("bilateralExistence", "∃⨝", "Sets", m.ExistsNode(True)),
    Chip("logicalAnd", "∧", "Boolean", m.LogicalOpNode("AND")),
    Chip("logicalOr", "∨", "Boolean", m.LogicalOpNode("OR")),
    Chip("logicalXor", "⊻", "Boolean", m.LogicalOpNode("XOR")),
    Chip("condition", "?", "Boolean", m.ConditionNode(_ANY)),
)

#: Fields that hold references to columns.
_COLUMN_FIELDS = {"columns", "column", "from_", "by", "left", "right"}


def _field(f: dataclasses.Field, hint) -> dict:
    """How a field is edited: a widget, with the choices or the inner fields it has."""
    name = f.metadata.get("name", f.name.rstrip("_"))
    inner = typing.get_args(hint)[0] if typing.get_origin(hint) is tuple else None
    if inner is str:
        return {"at": name, "widget": "list", "item": "column" if f.name in _COLUMN_FIELDS else "text"}
    if inner is not None:
        hints = typing.get_type_hints(inner, vars(m))
        return {"at": name, "widget": "rows", "of": [_field(x, hints[x.name]) for x in dataclasses.fields(inner)]}
    choices = {"type": m.JOIN_TYPES, "algorithm": m.ALGORITHMS, "function": m.AGGREGATES}.get(f.name)
    if choices:
        return {"at": name, "widget": "pick", "options": list(choices)}
    if f.name == "condition":
        return {"at": name, "widget": "condition", "options": list(m.COMPARISONS)}
    nullable = type(None) in typing.get_args(hint)
    widget = "column" if f.name in _COLUMN_FIELDS else {int: "int", bool: "flag"}.get(hint, "text")
    return {"at": name, "widget": widget, "nullable": nullable}


def catalog() -> dict:
    """Plain data for an editor: categories, node kinds with their fields, and the palette."""
    from weft.plans.codec import encode

    kinds = {}
    for chip in CHIPS:
        if chip.type not in kinds:
            cls = type(chip.template)
            hints = typing.get_type_hints(cls, vars(m))
            fields = [_field(f, hints[f.name]) for f in dataclasses.fields(cls) if f.name != "alias"]
            for f in fields:
                if f["at"] == "kind":
                    f |= {"widget": "pick", "options": list(m.SET_KINDS if chip.type == "setOp" else m.LOGICAL_KINDS)}
            templates = [encode(c.template) for c in CHIPS if c.type == chip.type]
            varied = [f["at"] for f in fields if len({str(t.get(f["at"])) for t in templates}) > 1]
            arity = ("source", "unary", "binary")[len(cls.ports)]
            kinds[chip.type] = {"arity": arity, "editable": bool(fields), "fields": fields, "variants": varied}
    chips = [{"key": c.key, "type": c.type, "symbol": c.symbol, "category": c.category, "template": encode(c.template)} for c in CHIPS]
    return {"categories": list(CATEGORIES), "types": kinds, "operators": chips, "placeholder": m.PLACEHOLDER}


# Captions: for each kind of node the forms it may take. A form is for nodes that have all its fields other than by default;
# the last is for all.

CAPTIONS: dict[type[m.Node], tuple[str, ...]] = {
    m.FilterNode: ("{condition}",),
    m.ConditionNode: ("{condition}",),
    m.ReferenceNode: ("{columns}",),
    m.ProjectNode: ("{columns}",),
    m.RemoveColumnsNode: ("{columns}",),
    m.SortNode: ("{keys}",),
    m.LimitNode: ("{count}, {offset}", "{count}"),
    m.AliasNode: ("{from_} → {to}",),
    m.ExplodeNode: ("{column}",),
    m.RowNumberNode: ("{column} from {start}",),
    m.AggNode: ("{by}: {aggregates}", "{aggregates}"),
    m.JoinNode: ("{on}",),
    m.SetOpNode: ("{kind_}",),
    m.LogicalOpNode: ("{kind_}",),
}
# Signs of the comparisons.
_SIGNS = {"EQ": "=", "NEQ": "≠", "GT": ">", "GTE": "≥", "LT": "<", "LTE": "≤"}
#: How the values in fields are written.
_WRITTEN = {
    m.SortKey: lambda k: f"{k.column} {'ASC' if k.ascending else 'DESC'}",
    m.Aggregate: lambda a: f"{a.function.lower()}({a.column})",
    m.JoinTerm: lambda t: f"{t.left} = {t.right}",
    m.Ref: lambda r: r.column,
    m.Literal: lambda x: f"'{x.value}'" if x.tag == "str" else _written(x.value),
    m.Comparison: lambda c: f"{c.left} {_SIGNS[c.op]} {_written(c.right)}",
    m.IsNull: lambda c: f"{c.column} IS NULL",
    m.IsNotNull: lambda c: f"{c.column} IS NOT NULL",
    m.And: lambda c: _joined(c, " AND "),
    m.Or: lambda c: _joined(c, " OR "),
    tuple: lambda values: ", ".join(map(_written, values)),
    bool: lambda x: "true" if x else "false",
}


def _written(value) -> str:
    return _WRITTEN.get(type(value), str)(value)


def _joined(condition: m.And | m.Or, word: str) -> str:
    return word.join(f"({x})" if isinstance(c, m.And | m.Or) else x for c in condition.conditions for x in [_written(c)])


condition_text = _written


def caption(session: g.Session, node: m.Node) -> str:
    """What a node does, in one line; for a table that it reads, its name."""
    if isinstance(node, m.TableNode):
        return getattr(session.tables.get(node.table), "name", "")
    usual = {f.name: f.default for f in dataclasses.fields(node)}
    for form in (forms := CAPTIONS.get(type(node), ("",))):
        fields = {name: getattr(node, name) for _, name, _, _ in string.Formatter().parse(form) if name}
        if form is forms[-1] or all(v not in (None, usual[name]) for name, v in fields.items()):
            return form.format(**{name: _written(v) for name, v in fields.items()})


# Renaming


def _changed(reference: str, old: str, new: str) -> str:
    source, column = m.split_reference(reference)
    return f"{new}.{column}" if source == old else reference


def _reading(value, old: str, new: str, copies: set[str]):
    """A node, or a part of one, that reads ``new`` wherever it read ``old``; in references to ``copies`` also old_column."""
    if isinstance(value, m.Ref):
        return m.Ref(_renamed_reference(value.column, old, new, copies))
    if isinstance(value, tuple):
        return tuple(_reading(v, old, new, copies) for v in value)
    if not dataclasses.is_dataclass(value) or isinstance(value, m.Literal):
        return value
    changes = {}
    for f in dataclasses.fields(value):
        v = getattr(value, f.name)
        if isinstance(v, str):
            if f.name in _COLUMN_FIELDS:
                changes[f.name] = new if isinstance(value, m.AliasNode) and v == old else _renamed_reference(v, old, new, copies)
        elif isinstance(v, tuple) and f.name in _COLUMN_FIELDS:
            changes[f.name] = tuple(_renamed_reference(x, old, new, copies) for x in v)
        elif v is not None:
            changes[f.name] = _reading(v, old, new, copies)
    return dataclasses.replace(value, **changes)


def _renamed_reference(reference: str, old: str, new: str, copies: set[str]) -> str:
    source, column = m.split_reference(reference)
    if source in copies and column.startswith(f"{old}_"):
        return f"{source}.{new}_{column[len(old) + 1 :]}"
    return _changed(reference, old, new)


def rename(session: g.Session, id_: int, new: str) -> g.Batch:
    """The commands that rename the source a node names, and every node connected with it that reads this source.

    Columns that a reference node copies are called source_column, so that readers of these change too.
    """
    node = session.nodes[id_]
    old = g.source_name(node)
    field = "to" if isinstance(node, m.AliasNode) else "alias"
    commands: list[g.Command] = [g.SetNode(id_, dataclasses.replace(node, **{field: new}))]
    tree = g.walk(session, id_, both=True)
    copies = {n.alias for k in tree if isinstance(n := session.nodes[k], m.ReferenceNode) and any(m.split_reference(c)[0] == old for c in n.columns)}
    for k in sorted(tree):
        if k != id_:
            after = _reading(session.nodes[k], old, new, copies)
            if after != session.nodes[k]:
                commands.append(g.SetNode(k, after))
    return g.Batch(tuple(commands))
