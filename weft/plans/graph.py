"""A session: tables, operators and the edges between them; commands that change it, and its undo steps.

A command makes a candidate; the candidate is then checked as a whole.  Undo steps are sessions, which share what did not
change; documents store the commands between them.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field, replace

from weft.errors import EditError, PlanError
from weft.plans.model import AliasNode, Node, Table, TableNode, own_alias

UNDO_LIMIT = 200


@dataclass(frozen=True, order=True)
class Edge:
    from_: int
    to: int
    port: str = "ONLY"


@dataclass(frozen=True)
class Session:
    """``edges`` are kept in order, so that sessions with the same edges are equal."""

    tables: dict[int, Table] = field(default_factory=dict)
    nodes: dict[int, Node] = field(default_factory=dict)
    edges: tuple[Edge, ...] = ()
    layout: dict[int, tuple[float, float]] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "edges", tuple(sorted(self.edges)))

    def input_of(self, node: int, port: str) -> int | None:
        return next((e.from_ for e in self.edges if (e.to, e.port) == (node, port)), None)


@dataclass(frozen=True)
class Problem:
    node: int
    message: str


# Reading a session


def source_name(node: Node) -> str | None:
    name = node.to if isinstance(node, AliasNode) else own_alias(node)
    return name if name and name.strip() else None


def neighbours(session: Session, up: bool, down: bool) -> dict[int, list[int]]:
    """For each node those that feed it (up), those that it feeds (down), or both."""
    out: dict[int, list[int]] = {}
    for e in session.edges:
        if up:
            out.setdefault(e.to, []).append(e.from_)
        if down:
            out.setdefault(e.from_, []).append(e.to)
    return out


def walk(session: Session, start: int, up: bool = True, both: bool = False) -> list[int]:
    """Nodes reached from ``start``, itself first: those that feed it, those that it feeds, or all connected ones."""
    beside = neighbours(session, up or both, both or not up)
    found = [start]
    for here in found:  # grows while it is read
        found += dict.fromkeys(n for n in beside.get(here, ()) if n not in found)
    return found


def trees(session: Session) -> list[list[int]]:
    """The connected parts of the graph, each in ascending order."""
    left, out = sorted(session.nodes), []
    while left:
        tree = set(walk(session, left[0], both=True))
        out.append(sorted(tree & set(left)))
        left = [n for n in left if n not in tree]
    return out


def roots(session: Session) -> list[int]:
    return sorted(set(session.nodes) - {e.from_ for e in session.edges})


def missing_inputs(session: Session) -> list[Problem]:
    fed = {(e.to, e.port) for e in session.edges}
    return [Problem(id_, f"input {p} is missing") for id_, n in sorted(session.nodes.items()) for p in n.ports if (id_, p) not in fed]


def source_clashes(session: Session) -> list[Problem]:
    """Nodes that name a source which an earlier node of the same tree names."""
    out = []
    for tree in trees(session):
        first: dict[str, int] = {}
        for id_ in tree:
            name = source_name(session.nodes[id_])
            if name and first.setdefault(name, id_) != id_:
                out.append(Problem(id_, f"source '{name}' is named by node #{first[name]} of this tree already; rename one of the two first"))
    return out


# What holds for every session. Each invariant lists where it is broken.


def _named_tables(session: Session) -> list[Problem]:
    return [Problem(id_, f"table {id_} needs a name, by which it enters the canvas") for id_, t in session.tables.items() if not t.name.strip()]


def _known_tables(session: Session) -> list[Problem]:
    return [Problem(id_, f"node #{id_} reads table {n.table}, which does not exist") for id_, n in session.nodes.items() if isinstance(n, TableNode) and n.table not in session.tables]


def _plain_names(session: Session) -> list[Problem]:
    names = ((id_, source_name(n)) for id_, n in session.nodes.items())
    return [Problem(id_, f"source name '{name}' must not have a dot: columns are read as source.column") for id_, name in names if name and "." in name]


def _edge_ends(session: Session) -> list[Problem]:
    ends = ((e, end) for e in session.edges for end in (e.from_, e.to))
    out = [Problem(end, f"node #{end} of the edge {e.from_} to {e.to} does not exist") for e, end in ends if end not in session.nodes]
    return out + [Problem(e.to, f"node #{e.to} has no input {e.port}") for e in session.edges if e.to in session.nodes and e.port not in session.nodes[e.to].ports]


def _one_edge_an_input(session: Session) -> list[Problem]:
    times = Counter((e.to, e.port) for e in session.edges)
    return [Problem(to, f"input {port} of node #{to} is connected already") for (to, port), n in times.items() if n > 1]


def _no_cycle(session: Session) -> list[Problem]:
    edges = session.edges
    while edges:
        fed = {e.to for e in edges}
        if len(left := [e for e in edges if e.from_ in fed]) == len(edges):
            return [Problem(min(fed), "a node would feed itself: that makes a cycle")]
        edges = left
    return []


INVARIANTS = (_named_tables, _known_tables, _plain_names, _edge_ends, _one_edge_an_input, _no_cycle, source_clashes)


def faults(session: Session) -> list[Problem]:
    return [p for invariant in INVARIANTS for p in invariant(session)]


# Commands: each says what it changes; what the result may be is left to the invariants.


def _has(mapping: dict, key: int, what: str) -> None:
    if key not in mapping:
        raise EditError(f"{what}{key} does not exist")


def _with(mapping: dict, key: int, value, what: str) -> dict:
    if key in mapping:
        raise EditError(f"{what}{key} exists already")
    return mapping | {key: value}


def _without(mapping: dict, key: int) -> dict:
    return {k: v for k, v in mapping.items() if k != key}


class Command:
    def on(self, session: Session) -> Session:
        raise NotImplementedError


@dataclass(frozen=True)
class AddTable(Command):
    id: int
    spec: Table

    def on(self, session: Session) -> Session:
        return replace(session, tables=_with(session.tables, self.id, self.spec, "table "))


@dataclass(frozen=True)
class RemoveTable(Command):
    id: int

    def on(self, session: Session) -> Session:
        _has(session.tables, self.id, "table ")
        return replace(session, tables=_without(session.tables, self.id))


@dataclass(frozen=True)
class AddNode(Command):
    id: int
    node: Node
    at: tuple[float, float] = (0.0, 0.0)

    def on(self, session: Session) -> Session:
        return replace(session, nodes=_with(session.nodes, self.id, self.node, "node #"), layout=session.layout | {self.id: self.at})


@dataclass(frozen=True)
class SetNode(Command):
    id: int
    node: Node

    def on(self, session: Session) -> Session:
        _has(session.nodes, self.id, "node #")
        if self.node.kind != (kind := session.nodes[self.id].kind):
            raise EditError(f"node #{self.id} is a {kind} and can't become a {self.node.kind}")
        return replace(session, nodes=session.nodes | {self.id: self.node})


@dataclass(frozen=True)
class RemoveNode(Command):
    id: int

    def on(self, session: Session) -> Session:
        _has(session.nodes, self.id, "node #")
        edges = tuple(e for e in session.edges if self.id not in (e.from_, e.to))
        return Session(session.tables, _without(session.nodes, self.id), edges, _without(session.layout, self.id))


@dataclass(frozen=True)
class Connect(Command):
    edge: Edge

    def on(self, session: Session) -> Session:
        return replace(session, edges=(*session.edges, self.edge))


@dataclass(frozen=True)
class Disconnect(Command):
    edge: Edge

    def on(self, session: Session) -> Session:
        if self.edge not in session.edges:
            raise EditError("there is no such connection")
        return replace(session, edges=tuple(e for e in session.edges if e != self.edge))


@dataclass(frozen=True)
class Move(Command):
    id: int
    to: tuple[float, float]

    def on(self, session: Session) -> Session:
        _has(session.nodes, self.id, "node #")
        return replace(session, layout=session.layout | {self.id: self.to})


@dataclass(frozen=True)
class Batch(Command):
    """Commands in their order, of which only the end must hold."""

    commands: tuple[Command, ...]

    def on(self, session: Session) -> Session:
        for command in self.commands:
            session = command.on(session)
        return session


def apply(session: Session, command: Command) -> Session:
    """The session after the command, refused if it breaks an invariant that held where it breaks it now."""
    after = command.on(session)
    old = set(faults(session))
    if new := [p for p in faults(after) if p not in old]:
        raise EditError(new[0].message)
    return after


def difference(before: Session, after: Session) -> Command:
    """A command that leads from one session to the other."""
    gone = lambda a, b: [k for k in a if k not in b or b[k] != a[k]]
    tables = gone(before.tables, after.tables)
    nodes = [k for k, n in before.nodes.items() if k not in after.nodes or after.nodes[k].kind != n.kind]
    kept = [k for k in before.nodes if k in after.nodes and k not in nodes]
    edges = [e for e in before.edges if not {e.from_, e.to} & set(nodes)]
    steps: list[Command] = [Disconnect(e) for e in edges if e not in after.edges]
    steps += [RemoveNode(k) for k in nodes] + [RemoveTable(k) for k in tables]
    steps += [AddTable(k, t) for k, t in after.tables.items() if k in tables or k not in before.tables]
    steps += [AddNode(k, n, after.layout.get(k, (0.0, 0.0))) for k, n in after.nodes.items() if k not in kept]
    steps += [SetNode(k, after.nodes[k]) for k in kept if after.nodes[k] != before.nodes[k]]
    steps += [Move(k, after.layout[k]) for k in kept if k in after.layout and after.layout[k] != before.layout.get(k)]
    steps += [Connect(e) for e in after.edges if e not in edges]
    return steps[0] if len(steps) == 1 else Batch(tuple(steps))


@dataclass(frozen=True)
class Editor:
    """A session with those before it, latest last, and those that undoing has left, latest last."""

    session: Session = field(default_factory=Session)
    past: tuple[Session, ...] = ()
    future: tuple[Session, ...] = ()

    def edit(self, command: Command) -> "Editor":
        return Editor(apply(self.session, command), (*self.past, self.session)[-UNDO_LIMIT:])

    def undo(self) -> "Editor":
        return Editor(self.past[-1], self.past[:-1], (*self.future, self.session)) if self.past else self

    def redo(self) -> "Editor":
        return Editor(self.future[-1], (*self.past, self.session), self.future[:-1]) if self.future else self


# Plans


@dataclass(frozen=True)
class Query:
    """An operator with its inputs: a tree, in which a node that feeds two others stands twice."""

    node: Node
    inputs: tuple["Query", ...] = ()
    table: Table | None = None


def plan(session: Session, id_: int) -> Query:
    """What a node computes, from what feeds it; the rest of the session plays no part."""
    if id_ not in session.nodes:
        raise PlanError(f"node #{id_} does not exist")
    node = session.nodes[id_]
    inputs = []
    for port in node.ports:
        source = session.input_of(id_, port)
        if source is None:
            raise PlanError(f"node #{id_}: input {port} is missing")
        inputs.append(plan(session, source))
    table = None
    if isinstance(node, TableNode):
        if node.table not in session.tables:
            raise PlanError(f"node #{id_}: table {node.table} does not exist")
        table = session.tables[node.table]
    return Query(node, tuple(inputs), table)
