"""Receivers that read their providers' rows, at any depth and through any operator."""

import itertools
import random

import pytest

from tests.graphs import *  # noqa: F403
from weft.errors import PlanError

INNER = [("ana", "sp"), ("cid", "sp"), ("bob", "rj")]


def of_emp(e="e"):
    return where(dep(), cmp("d.id", "=", ref(f"{e}.dept")))


def got(spark, q, *columns):
    return sorted(rows(spark, q, *columns), key=str)


@pytest.mark.parametrize("wrap", [None, m.MaterializeNode(), m.MemoizeNode(), m.HashIndexNode(), m.ScanNode(), m.DistinctNode(), m.SortNode((m.SortKey("d.city"),)), m.LimitNode(5), m.RowNumberNode("r", "n")])
def test_term_less_joins(spark, wrap):
    inner = lambda: of_emp() if wrap is None else op(wrap, of_emp())
    both = ("e.name", "d.city")
    assert got(spark, join("INNER", "NESTED_LOOP", emp(), inner()), *both) == sorted(INNER)
    assert got(spark, op(m.CrossNode(), emp(), inner()), *both) == sorted(INNER)
    assert got(spark, join("LEFT", "NESTED_LOOP", emp(), inner()), *both) == sorted([*INNER, ("dan", None)], key=str)
    assert got(spark, join("LEFT_SEMI", "NESTED_LOOP", emp(), inner()), "e.name") == [("ana",), ("bob",), ("cid",)]
    assert got(spark, join("LEFT_ANTI", "NESTED_LOOP", emp(), inner()), "e.name") == [("dan",)]


def test_right_join_reads_on_the_left(spark):
    q = join("RIGHT", "NESTED_LOOP", where(emp(), cmp("e.dept", "=", ref("d.id"))), dep())
    assert got(spark, q, "e.name", "d.city") == sorted([*INNER, (None, "bh")], key=str)
    assert names(spark, q)[:2] == ["d.id", "d.city"]


def test_fixture_graphs(spark):
    two = join("LEFT_SEMI", "NESTED_LOOP", dep(), join("LEFT_SEMI", "NESTED_LOOP", emp(), where(emp("x"), cmp("x.id", "=", ref("e.id")), cmp("x.dept", "=", ref("d.id")))))
    assert got(spark, two, "d.id") == [(10,), (20,)]
    truth = op(m.LogicalOpNode("AND", "both"), op(m.ConditionNode(cmp("f.id", ">", 1), "high")), where(dep(), cmp("d.id", "=", ref("f.dept"))))
    assert got(spark, join("LEFT_SEMI", "NESTED_LOOP", emp("f"), truth), "f.name") == [("bob",), ("cid",)]
    assert got(spark, join("LEFT_ANTI", "NESTED_LOOP", emp("f"), truth), "f.name") == [("ana",), ("dan",)]
    echo = where(op(m.CrossNode(), emp("f"), op(m.ReferenceNode(("f.dept",), "now"))), cmp("now.f_dept", "=", 10))
    assert got(spark, echo, "f.name") == [("ana",), ("cid",)]
    either = op(m.LogicalOpNode("OR"), op(m.ConditionNode(cmp("e.dept", ">", 25))), of_emp())
    assert len(got(spark, join("LEFT_SEMI", "NESTED_LOOP", emp(), either))) == 4


def test_aggregates_see_every_outer_row(spark):
    q = op(m.CrossNode(), emp(), group(of_emp(), None, ("COUNT_ALL", "d.id"), ("MAX", "d.city")))
    assert got(spark, q, "e.name", "a.COUNT_ALL_id", "a.MAX_city") == [("ana", 1, "sp"), ("bob", 1, "rj"), ("cid", 1, "sp"), ("dan", 0, None)]
    q = op(m.CrossNode(), dep(), op(m.LimitNode(1), sort(where(emp(), cmp("e.dept", "=", ref("d.id"))), "e.name", up=False)))
    assert got(spark, q, "d.city", "e.name") == [("rj", "bob"), ("sp", "cid")]
    q = op(m.CrossNode(), dep(), op(m.RowNumberNode("r", "n"), where(emp(), cmp("e.dept", "=", ref("d.id")))))
    assert got(spark, q, "d.city", "r.n", "e.name") == [("rj", 1, "bob"), ("sp", 1, "ana"), ("sp", 2, "cid")]


def test_exists_and_sets_within_an_outer_row(spark):
    left, right = where(emp("x"), cmp("x.dept", "=", ref("d.id"))), where(emp("y"), cmp("y.dept", ">", ref("d.id")))
    q = op(m.CrossNode(), dep(), op(m.ExistsNode(True), left, right))
    assert got(spark, q, "d.id", "x.name", "y.name") == [(10, "ana", "bob"), (20, "bob", "dan")]
    q = op(m.CrossNode(), dep(), op(m.ExistsNode(False), left, right))
    assert got(spark, q, "d.id", "x.name", "y.name") == [(10, "ana", None), (20, "bob", None), (30, None, "dan")]
    for kind, want in (("EXCEPT", [(10, "ana"), (10, "cid"), (20, "bob")]), ("UNION", [(10, "ana"), (10, "bob"), (10, "cid"), (10, "dan"), (20, "bob"), (20, "dan"), (30, "dan")])):
        q = op(m.CrossNode(), dep(), op(m.SetOpNode(kind, True, "u"), project(left, "x.name"), project(right, "y.name")))
        assert got(spark, q, "d.id", "u.name" if kind == "UNION" else "x.name") == want


def test_a_receiver_alone_is_refused(spark):
    with pytest.raises(PlanError, match="not found"):
        rows(spark, of_emp())
    with pytest.raises(PlanError, match="no join"):
        rows(spark, op(m.ReferenceNode(("e.id",))))
    for algorithm in ("HASH", "MERGE"):
        with pytest.raises(PlanError, match="not found"):
            rows(spark, join("INNER", algorithm, emp(), of_emp(), ("e.dept", "d.id")))


@pytest.mark.parametrize("seed", range(6))
def test_nested_loops_against_running_once_for_each_row(spark, seed):
    """Three tables, joins of every correlating kind on two levels, against plain loops."""
    rng = random.Random(seed)
    make = lambda n: [(rng.choice([None, 1, 2, 3]), rng.randint(0, 4)) for _ in range(n)]
    data = {x: make(rng.randint(0, 6)) for x in "abc"}
    spec = {x: memory(x, [m.Column("k", "INT"), m.Column("v", "INT")], data[x]) for x in "abc"}
    for outer, inner in itertools.product(["INNER", "LEFT", "LEFT_SEMI", "LEFT_ANTI"], repeat=2):
        low = where(table(spec["c"], "c"), cmp("c.k", "=", ref("b.k")), cmp("c.v", "<=", ref("a.v")))
        middle = where(table(spec["b"], "b"), cmp("b.v", "<", ref("a.v"))) if rng.random() < 0.5 else table(spec["b"], "b")
        filtered = isinstance(middle.node, m.FilterNode)
        got_ = rows(spark, join(outer, "NESTED_LOOP", table(spec["a"], "a"), join(inner, "NESTED_LOOP", middle, low)))

        def run(kind, left, right_of, width):
            out = []
            for x in left:
                mine = right_of(x)
                if kind == "INNER" or (kind == "LEFT" and mine):
                    out += [x + y for y in mine]
                elif kind == "LEFT":
                    out.append(x + (None,) * width)
                elif bool(mine) == (kind == "LEFT_SEMI"):
                    out.append(x)
            return out

        def below(a):
            bs = [b for b in data["b"] if not filtered or b[1] < a[1]]
            return run(inner, bs, lambda b: [c for c in data["c"] if c[0] is not None and c[0] == b[0] and c[1] <= a[1]], 2)

        want = run(outer, data["a"], below, 4 if inner in ("INNER", "LEFT") else 2)
        assert sorted(got_, key=str) == sorted(want, key=str), (outer, inner)


def test_compiling_grows_little_with_depth(spark, monkeypatch):
    """A receiver in a receiver in a receiver: each node is compiled a few times, not twice as often for each level."""
    calls = []
    own = Compiler.compile
    monkeypatch.setattr(Compiler, "compile", lambda self, query, scope=None: calls.append(1) or own(self, query, scope))
    seen = []
    for depth in (1, 3, 5):
        q = where(emp("x"), cmp("x.id", "=", ref("e0.id")))
        for k in range(depth)[::-1]:
            q = join("LEFT_SEMI", "NESTED_LOOP", emp(f"e{k}"), q if k == depth - 1 else where(q, cmp(f"e{k + 1}.id", "=", ref(f"e{k}.id"))))
        calls.clear()
        assert got(spark, q, "e0.name") == [("ana",), ("bob",), ("cid",), ("dan",)]
        seen.append(len(calls))
    assert seen[2] <= 12 * seen[0]
