"""Sessions: commands and their inverses, documents and their older versions, the palette, captions, renaming."""

import json
import random

import pytest

from tests.graphs import *  # noqa: F403
from weft.errors import EditError, PlanError
from weft.plans import catalog, codec


def build(commands, start=None):
    s = start or g.Session()
    for c in commands:
        s = g.apply(s, c)
    return s


def session():
    """Trips of boats: a join (node 30) under a filter (node 40)."""
    boats = memory("boats", [m.Column("no", "INT", True, False), m.Column("kind", "STRING"), m.Column("berths", "INT")], [(7, "ketch", 6), (8, "yawl", 4), (9, "sloop", 2)])
    trips = memory("trips", [m.Column("no", "INT", True, False), m.Column("boat", "INT"), m.Column("miles", "INT")], [(71, 7, 310), (72, 7, 12), (91, 9, 455)])
    nodes = {10: m.TableNode(1, "b"), 20: m.TableNode(2, "t"), 30: m.JoinNode(on=(m.JoinTerm("b.no", "t.boat"),)), 40: m.FilterNode(cmp("t.miles", ">", 100))}
    wires = [g.Edge(10, 30, "LEFT"), g.Edge(20, 30, "RIGHT"), g.Edge(30, 40)]
    return build([g.AddTable(1, boats), g.AddTable(2, trips), *(g.AddNode(k, n, (float(k), 0.0)) for k, n in nodes.items()), *map(g.Connect, wires)])


REFUSED = {
    "table 1 exists": g.AddTable(1, EMP), "node #10 reads table 1": g.RemoveTable(1), "table 6 does not": g.RemoveTable(6), "needs a name": g.AddTable(5, m.ParquetTable(" ", "p")),
    "node #40 exists": g.AddNode(40, m.ScanNode()), "reads table 6": g.AddNode(50, m.TableNode(6, "x")), "must not have a dot": g.AddNode(50, m.TableNode(1, "p.q")),
    "is a filter and can't become a scan": g.SetNode(40, m.ScanNode()), "node #60 does not": g.SetNode(60, m.ScanNode()), "source 'b' is named by node #10": g.SetNode(20, m.TableNode(2, "b")),
    "that makes a cycle": g.Batch((g.AddNode(50, m.ScanNode()), g.Connect(g.Edge(50, 50)))), "input ONLY of node #40": g.Connect(g.Edge(10, 40)), "no input LEFT": g.Connect(g.Edge(10, 40, "LEFT")),
    "input LEFT of node #30": g.Connect(g.Edge(10, 30, "LEFT")), "node #60 of the edge": g.Connect(g.Edge(60, 40)), "no such connection": g.Disconnect(g.Edge(20, 40)), "#60 does not exist": g.Move(60, (0.0, 0.0)), "#60 does not": g.RemoveNode(60),
}


@pytest.mark.parametrize("what", REFUSED)
def test_what_breaks_an_invariant_is_refused(what):
    with pytest.raises(EditError, match=what):
        g.apply(session(), REFUSED[what])


def test_longer_cycles_and_old_faults():
    two = [g.Disconnect(g.Edge(30, 40)), g.AddNode(50, m.ScanNode()), g.Connect(g.Edge(40, 50))]
    with pytest.raises(EditError, match="cycle"):
        build([*two, g.Connect(g.Edge(50, 40))], session())
    # A document may come with a clash; what doesn't add to it is let through.
    clash = g.Session({1: EMP}, {1: m.TableNode(1, "x"), 2: m.TableNode(1, "x"), 3: m.CrossNode()}, (g.Edge(1, 3, "LEFT"), g.Edge(2, 3, "RIGHT")))
    assert [p.node for p in g.source_clashes(clash)] == [2]
    assert g.apply(clash, g.Move(3, (1.0, 1.0))).layout[3] == (1.0, 1.0) and not g.faults(g.apply(clash, g.SetNode(2, m.TableNode(1, "y"))))
    # Within a batch only the end counts.
    assert g.apply(session(), g.Batch((g.RemoveTable(2), g.RemoveNode(20)))).edges == (g.Edge(10, 30, "LEFT"), g.Edge(30, 40))


def wild(rng, s):
    """A random command; many are refused."""
    k, n = rng.choice([10, 20, 30, 40, 50, 60]), rng.choice([10, 20, 30, 40, 50, 60])
    node = rng.choice([m.ScanNode(), m.CrossNode(), m.TableNode(rng.choice([1, 2, 3]), rng.choice("btxy")), m.FilterNode(cmp("t.no", "=", rng.randrange(9)))])
    edge = g.Edge(k, n, rng.choice(["ONLY", "LEFT", "RIGHT"]))
    plain = [g.AddNode(k, node, (rng.random(), 0.0)), g.SetNode(k, node), g.RemoveNode(k), g.Connect(edge), g.Disconnect(rng.choice(s.edges) if s.edges else edge), g.Move(k, (rng.random(), 1.0)), g.AddTable(3, EMP), g.RemoveTable(3)]
    return rng.choice([*plain, g.Batch(tuple(rng.sample(plain, 3)))])


def test_undo_and_redo_return_to_every_state_also_from_a_document():
    rng, editor = random.Random(4), g.Editor(session())
    for _ in range(400):
        try:
            editor = editor.edit(wild(rng, editor.session))
        except EditError:
            continue
        assert not g.faults(editor.session) and not editor.future
    states, at = [*editor.past, editor.session], len(editor.past)
    assert at > 50
    for k in range(300):
        editor = editor.undo() if (step := rng.choice([-1, -1, 1])) < 0 else editor.redo()
        at = min(max(at + step, 0), len(states) - 1)
        assert editor.session == states[at]
        if k % 50 == 0:
            editor = codec.loads(codec.dumps(editor))
    for k in range(g.UNDO_LIMIT + 50):
        editor = editor.edit(g.AddTable(100 + k, EMP))
    assert len(editor.past) == g.UNDO_LIMIT and editor.redo() is editor and g.Editor().undo() == g.Editor()


def test_differences_lead_from_one_session_to_the_other():
    rng, s = random.Random(9), session()
    seen = [s]
    for _ in range(200):
        try:
            s = g.apply(s, wild(rng, s))
            seen.append(s)
        except EditError:
            pass
    for _ in range(60):
        a, b = rng.choice(seen), rng.choice(seen)
        assert g.apply(a, g.difference(a, b)) == b
    assert g.difference(session(), g.apply(session(), g.RemoveNode(40))) == g.RemoveNode(40)


def test_documents_round_trip():
    editor = g.Editor(session()).edit(g.RemoveNode(40)).edit(g.Move(10, (1.0, 2.0))).undo()
    assert codec.loads(codec.dumps(editor)) == editor
    every = g.Session(
        {1: EMP, 2: m.CsvTable("c", "p", (m.Column("a", "INT"),), ";", "'", 2), 3: m.XmlTable("x", "p", (m.Column("a", "INT"),), None, "r"), 4: m.BTreeTable("b", "p"), 5: m.ParquetTable("q", "p", ("k",))},
        {i: c.template for i, c in enumerate(catalog.CHIPS)} | {99: m.FilterNode(m.Or((m.IsNull("a"), m.And((m.IsNotNull("b"), cmp("c", "<", ref("d.e")))))))},
    )
    data = json.loads(codec.dumps(g.Editor(every)))
    assert data["version"] == 3 and codec.session(data["history"]["session"]) == every
    node = data["history"]["session"]["nodes"]["0"]
    assert node == {"@type": "filter", "condition": {"@type": "cmp", "left": "?", "op": "EQ", "right": {"str": "?"}}}
    commands = (g.AddTable(1, EMP), g.RemoveTable(1), g.AddNode(1, m.ScanNode(), (1.0, 2.0)), g.SetNode(1, m.ScanNode()), g.RemoveNode(1), g.Connect(g.Edge(1, 2)), g.Disconnect(g.Edge(1, 2)), g.Move(1, (3.0, 4.0)))
    assert codec.command(json.loads(json.dumps(codec.encode(g.Batch(commands))))) == g.Batch(commands)


OLD_NODES = {
    "10": ({"@type": "scan", "table": 3, "alias": "b"}, m.TableNode(3, "b")),
    "11": ({"@type": "scan"}, m.ScanNode()),
    "20": ({"@type": "filter", "condition": {"@type": "or", "conditions": [{"@type": "isNotNull", "column": {"source": "b", "name": "kind"}}, {"@type": "cmp", "left": {"column": "no"}, "op": "LT", "right": {"int": 4}}]}}, m.FilterNode(m.Or((m.IsNotNull("b.kind"), cmp("no", "<", 4))))),
    "30": ({"@type": "join", "type": "LEFT", "algorithm": "MERGE", "on": []}, m.JoinNode("LEFT", "MERGE", (m.JoinTerm("?.?", "?.?"),))),
    "31": ({"@type": "join"}, m.JoinNode()),
    "32": ({"@type": "join", "on": [{"left": "b.no", "right": {"source": "t", "column": "boat"}}]}, m.JoinNode(on=(m.JoinTerm("b.no", "t.boat"),))),
    "40": ({"@type": "agg", "alias": "z", "by": {"source": "t", "name": "boat"}, "aggregates": [{"function": "MAX", "column": "t.miles"}]}, m.AggNode("z", "t.boat", (m.Aggregate("MAX", "t.miles"),))),
}


@pytest.mark.parametrize("version", [1, 2, None])
def test_older_documents_are_brought_up(version):
    given = {k: old | ({"@type": "table"} if version == 2 and "table" in old else {}) for k, (old, _) in OLD_NODES.items()}
    data = {"history": {"session": {"nodes": given}}} | ({"version": version} if version else {})
    assert codec.loads(json.dumps(data)).session.nodes == {int(k): new for k, (_, new) in OLD_NODES.items()}
    with pytest.raises(ValueError, match="version"):
        codec.loads('{"version": 4, "history": {}}')


@pytest.mark.parametrize("bad", [{"int": "x"}, {"int": 2**40}, {"int": True}, {}, {"int": 1, "str": "a"}, {"what": 1}, 5, {"bool": 1}])
def test_malformed_literals_are_refused(bad):
    with pytest.raises(ValueError):
        codec.literal(bad)


@pytest.mark.parametrize(
    "make",
    [
        lambda: m.SortNode(()), lambda: m.SortNode((m.SortKey("a"), m.SortKey("b", False))), lambda: m.LimitNode(0), lambda: m.LimitNode(1, -1), lambda: m.JoinNode(algorithm="HASH"),
        lambda: m.JoinTerm("a", "b.c"), lambda: m.AggNode("a", "b", (m.Aggregate("SUM", "c"),)), lambda: m.AggNode("a", None, ()), lambda: m.ProjectNode(()), lambda: m.And((m.IsNull("a"),)),
        lambda: m.ReferenceNode(("a",)), lambda: m.TableNode(1, " "), lambda: m.ExplodeNode("a", ""), lambda: m.Aggregate("MEDIAN", "a"), lambda: m.Column("a" * 241, "INT"),
        lambda: m.validate_columns(()), lambda: m.validate_columns((m.Column("a", "INT", True, True),)), lambda: m.validate_columns((m.Column("a", "STRING", True, False),)), lambda: m.validate_columns((m.Column("a", "INT"), m.Column("A", "INT"))),
    ],
)
def test_malformed_values_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_palette():
    data = catalog.catalog()
    assert len(data["operators"]) == 52 and len(data["types"]) == 22 and data["categories"] == list(catalog.CATEGORIES)
    fields = {f["at"]: f for f in data["types"]["join"]["fields"]}
    assert fields["type"]["options"] == list(m.JOIN_TYPES) and fields["on"]["of"][0] == {"at": "left", "widget": "column", "nullable": False}
    assert data["types"]["join"]["variants"] == ["type", "algorithm"] and data["types"]["setOp"]["variants"] == ["kind", "hashed"]
    assert data["types"]["cross"] == {"arity": "binary", "editable": False, "fields": [], "variants": []}


def test_captions():
    s = session()
    shown = {k: catalog.caption(s, n) for k, n in s.nodes.items()}
    assert shown == {10: "boats", 20: "trips", 30: "b.no = t.boat", 40: "t.miles > 100"}
    either = m.Or((m.IsNotNull("p"), m.And((cmp("q", "<=", 2.5), m.Comparison("r", "EQ", L("bool", True))))))
    for node, want in [
        (m.FilterNode(either), "p IS NOT NULL OR (q ≤ 2.5 AND r = true)"), (m.ConditionNode(m.And((m.IsNull("p"), cmp("q", "!=", ref("t.no"))))), "p IS NULL AND q ≠ t.no"), (m.FilterNode(cmp("p", "<", "x")), "p < 'x'"),
        (m.LimitNode(9, 4), "9, 4"), (m.LimitNode(9), "9"), (m.AliasNode("t", "z"), "t → z"), (m.RowNumberNode("z", "place"), "place from 1"), (m.RowNumberNode("z", "place", 0), "place from 0"),
        (m.AggNode("z", None, (m.Aggregate("MAX", "t.miles"), m.Aggregate("COUNT_ALL", "t.no"))), "max(t.miles), count_all(t.no)"), (m.AggNode("z", "t.boat", (m.Aggregate("MIN", "t.no"),)), "t.boat: min(t.no)"),
        (m.SortNode((m.SortKey("t.no", False), m.SortKey("t.miles", False))), "t.no DESC, t.miles DESC"), (m.SortNode((m.SortKey("t.no"),)), "t.no ASC"), (m.ProjectNode(("t.no", "b.no")), "t.no, b.no"), (m.SetOpNode("EXCEPT", True), "EXCEPT"), (m.LogicalOpNode("XOR"), "XOR"), (m.ExplodeNode("t.no"), "t.no"),
        (m.CrossNode(), ""), (m.TableNode(8, "gone"), ""),
    ]:
        assert catalog.caption(s, node) == want


def test_renaming_reaches_every_reader():
    more = [g.AddNode(50, m.ReferenceNode(("b.berths",), "r")), g.AddNode(60, m.CrossNode()), g.Connect(g.Edge(40, 60, "LEFT")), g.Connect(g.Edge(50, 60, "RIGHT")), g.AddNode(70, m.FilterNode(cmp("r.b_berths", ">", ref("b.no")))), g.Connect(g.Edge(60, 70))]
    s = build(more, session())
    after = g.apply(s, catalog.rename(s, 10, "boat"))
    assert after.nodes[10].alias == "boat" and after.nodes[30].on == (m.JoinTerm("boat.no", "t.boat"),) and after.nodes[50].columns == ("boat.berths",)
    assert after.nodes[70].condition == cmp("r.boat_berths", ">", ref("boat.no")) and after.nodes[40] == s.nodes[40]
    with pytest.raises(EditError, match="named by"):
        g.apply(s, catalog.rename(s, 10, "t"))


def test_plans_follow_edges_upstream():
    s = session()
    assert g.roots(s) == [40] and g.walk(s, 30) == [30, 10, 20] and g.walk(s, 10, up=False) == [10, 30, 40] and g.missing_inputs(s) == [] and g.trees(s) == [[10, 20, 30, 40]]
    assert g.plan(s, 30) == g.plan(g.apply(s, g.RemoveNode(40)), 30) and hash(g.plan(s, 30))
    with pytest.raises(PlanError, match="missing"):
        g.plan(g.apply(s, g.RemoveNode(10)), 40)
