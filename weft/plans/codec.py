"""Sessions as JSON documents: version 3, and versions 1 and 2 brought up to it on reading.

Literals are tagged objects with one key: int, long, float, double, bool, str, or ref for a column.
"""

from __future__ import annotations

import dataclasses
import itertools
import json
import types
import typing

from weft.plans import graph as g
from weft.plans import model as m

VERSION = 3
_TABLES = {"memory": m.MemoryTable, "csv": m.CsvTable, "xml": m.XmlTable, "btree": m.BTreeTable, "parquet": m.ParquetTable}
_CONDITIONS = {"cmp": m.Comparison, "isNull": m.IsNull, "isNotNull": m.IsNotNull, "and": m.And, "or": m.Or}
_COMMANDS = {
    "addTable": g.AddTable, "removeTable": g.RemoveTable, "addNode": g.AddNode, "setNode": g.SetNode, "removeNode": g.RemoveNode,
    "connect": g.Connect, "disconnect": g.Disconnect, "move": g.Move, "batch": g.Batch,
}
_NAMES = {cls: name for group in (_TABLES, _CONDITIONS, _COMMANDS, m.NODES) for name, cls in group.items()}


def _camel(name: str) -> str:
    head, *rest = name.rstrip("_").split("_")
    return head + "".join(x.title() for x in rest)


def encode(value):
    """Plain JSON data for any value of the model."""
    if isinstance(value, m.Literal):
        return {value.tag: value.value}
    if isinstance(value, m.Ref):
        return {"ref": value.column}
    if isinstance(value, m.MemoryTable):
        rows = [{k: encode(v) for k, v in row} for row in value.rows]
        return {"@type": "memory", "name": value.name, "columns": encode(value.columns), "rows": rows}
    if isinstance(value, g.Session):
        return {
            "tables": {str(k): encode(t) for k, t in value.tables.items()},
            "nodes": {str(k): encode(n) for k, n in value.nodes.items()},
            "edges": encode(value.edges),
            "layout": {str(k): _position(p) for k, p in value.layout.items()},
        }
    if dataclasses.is_dataclass(value):
        tag = {"@type": _NAMES[type(value)]} if type(value) in _NAMES else {}
        return tag | {_camel(f.name): _position(v) if f.name in ("at",) or (f.name == "to" and isinstance(value, g.Move)) else encode(v) for f in dataclasses.fields(value) for v in [getattr(value, f.name)]}
    if isinstance(value, tuple | list):
        return [encode(v) for v in value]
    return value


def _position(at) -> dict:
    return {"x": at[0], "y": at[1]}


def decode(kind, data):
    """A value of the model from JSON data; ``kind`` is a class, or an annotation of one's field."""
    if isinstance(kind, str):
        kind = typing.get_type_hints(m).get(kind) or getattr(m, kind, None) or getattr(g, kind)
    origin = typing.get_origin(kind)
    if data is None:
        return None
    if origin is tuple:
        args = typing.get_args(kind)
        if args[-1] is Ellipsis:
            return tuple(decode(args[0], x) for x in data)
        return (float(data["x"]), float(data["y"]))
    if kind is typing.Any:
        return data
    if origin in (types.UnionType, typing.Union):
        options = [a for a in typing.get_args(kind) if a is not type(None)]
        if m.Literal in options:
            return literal(data)
        if len(options) == 1:
            return decode(options[0], data)
        return _tagged(data)
    if kind in (m.Node, g.Command):
        return _tagged(data)
    if kind is m.MemoryTable:
        rows = tuple(tuple((k, None if v is None else literal(v)) for k, v in row.items()) for row in data.get("rows", []))
        return m.MemoryTable(data["name"], decode(tuple[m.Column, ...], data["columns"]), rows)
    if kind is g.Session:
        return session(data)
    if dataclasses.is_dataclass(kind):
        hints = typing.get_type_hints(kind, vars(g) | vars(m))
        return kind(**{f.name: decode(hints[f.name], data[_camel(f.name)]) for f in dataclasses.fields(kind) if _camel(f.name) in data})
    return data


def _tagged(data: dict):
    name = data.get("@type")
    for group in (_CONDITIONS, _TABLES, _COMMANDS, m.NODES):
        if name in group:
            return decode(group[name], data)
    raise ValueError(f"unknown type '{name}'")


def literal(data) -> m.Literal | m.Ref:
    if not isinstance(data, dict) or len(data) != 1:
        raise ValueError(f"malformed literal: {data!r}")
    ((tag, value),) = data.items()
    if tag == "ref":
        return m.Ref(str(value))
    whole = isinstance(value, int) and not isinstance(value, bool)
    fits = {"int": whole and -(2**31) <= value < 2**31 if whole else False, "long": whole, "float": whole or isinstance(value, float), "double": whole or isinstance(value, float), "bool": isinstance(value, bool), "str": True}
    if tag not in fits:
        raise ValueError(f"unknown literal tag '{tag}'")
    if not fits[tag]:
        raise ValueError(f"malformed literal: {data!r}")
    return m.Literal(tag, str(value) if tag == "str" else float(value) if tag in ("float", "double") else value)


def session(data: dict) -> g.Session:
    return g.Session(
        {int(k): _tagged(t) for k, t in data.get("tables", {}).items()},
        {int(k): _tagged(n) for k, n in data.get("nodes", {}).items()},
        tuple(g.Edge(int(e["from"]), int(e["to"]), e.get("port", "ONLY")) for e in data.get("edges", [])),
        {int(k): (float(p["x"]), float(p["y"])) for k, p in data.get("layout", {}).items()},
    )


def command(data: dict) -> g.Command:
    return _tagged(data)


# Older versions. Each step says for an object of some kind what it is in the next version.


def _reads_a_table(node: dict) -> dict:
    """The first version called a node that reads a table a scan; a scan without a table has always been one."""
    return node | {"@type": "table"} if "table" in node else node


def _as_text(column):
    """A column was {source, name} or {source, column}; now it is 'source.name'."""
    if isinstance(column, dict):
        return ".".join(x for x in (column.get("source"), column.get("name", column.get("column"))) if x is not None)
    return column


def _text_at(*keys: str):
    return lambda data: data | {k: _as_text(data[k]) for k in keys if k in data}


def _with_terms(node: dict) -> dict:
    """Columns of a join's terms became texts, and hash and merge joins came to need a term."""
    blank = f"{m.PLACEHOLDER}.{m.PLACEHOLDER}"
    needed = [] if node.get("algorithm", m.ALGORITHMS[0]) == m.ALGORITHMS[0] else [{"left": blank, "right": blank}]
    return node | {"on": [_text_at("left", "right")(t) for t in node.get("on") or needed]}


STEPS = {
    1: {"scan": _reads_a_table},
    2: {"cmp": _text_at("left"), "isNull": _text_at("column"), "isNotNull": _text_at("column"), "agg": _text_at("by"), "join": _with_terms},
}


def upgrade(step: dict, data):
    """JSON data with a step taken for every object in it, the inner ones first."""
    if isinstance(data, dict):
        inner = {k: upgrade(step, v) for k, v in data.items()}
        return step.get(inner.get("@type"), dict)(inner)
    return [upgrade(step, x) for x in data] if isinstance(data, list) else data


def dumps(editor: g.Editor) -> str:
    """The document of an editor: its session with the steps to undo and to redo, each as the two commands between its sessions."""
    step = lambda before, after: {"redo": encode(g.difference(before, after)), "undo": encode(g.difference(after, before))}
    undo = [step(a, b) for a, b in itertools.pairwise((*editor.past, editor.session))]
    redo = [step(b, a) for a, b in itertools.pairwise((*editor.future, editor.session))]
    return json.dumps({"version": VERSION, "history": {"session": encode(editor.session), "undoStack": undo, "redoStack": redo}}, ensure_ascii=False, indent=4)


def loads(text: str) -> g.Editor:
    """The editor of a document; the sessions of its steps are worked out from the commands."""
    data = json.loads(text)
    version, history = int(data.get("version", 1)), data["history"]
    if not 1 <= version <= VERSION:
        raise ValueError(f"unknown document version {version}")
    for older in range(version, VERSION):
        history = upgrade(STEPS[older], history)
    now = session(history["session"])

    def back(name: str, way: str) -> tuple[g.Session, ...]:
        states = itertools.accumulate((command(x[way]) for x in reversed(history.get(name, []))), lambda s, c: c.on(s), initial=now)
        return tuple(reversed(list(states)[1:]))

    return g.Editor(now, back("undoStack", "undo"), back("redoStack", "redo"))
