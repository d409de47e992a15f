"""Every operator of the palette on two small tables."""

import pytest

from tests.graphs import *  # noqa: F403
from weft.errors import PlanError
from weft.plans.catalog import CHIPS

INNER = {("ana", "sp"), ("cid", "sp"), ("bob", "rj")}
ON = ("e.dept", "d.id")


def filtered_dep():
    return where(dep(), cmp("d.id", "=", ref("e.dept")))


def none():
    return where(dep(), cmp("d.id", "<", 0))


# chip: (query, columns, rows in any order) or with True at the end, in order
CASES = {
    "filter": (where(emp(), cmp("e.dept", "=", 10)), ["e.name"], [("ana",), ("cid",)]),
    "projection": (project(emp(), "e.name"), [], [("ana",), ("bob",), ("cid",), ("dan",)]),
    "selectColumns": (op(m.RemoveColumnsNode(("e.tags",), "P"), emp()), ["P.id", "P.name", "P.dept"], [(1, "ana", 10), (2, "bob", 20), (3, "cid", 10), (4, "dan", 40)]),
    "rename": (op(m.AliasNode("e", "x"), emp()), ["x.id"], [(1,), (2,), (3,), (4,)]),
    "sort": (sort(emp(), "e.dept"), ["e.name"], [("ana",), ("cid",), ("bob",), ("dan",)], True),
    "limit": (op(m.LimitNode(2, 1), emp()), ["e.name"], [("bob",), ("cid",)], True),
    "duplicateRemoval": (op(m.DistinctNode(False), sort(project(emp(), "e.dept"), "e.dept")), [], [(10,), (20,), (40,)]),
    "hashDuplicateRemoval": (op(m.DistinctNode(True), project(emp(), "e.dept")), [], [(10,), (20,), (40,)]),
    "aggregation": (group(emp(), "e.dept", ("COUNT", "e.id")), ["a.dept", "a.COUNT_id"], [(10, 2), (20, 1), (40, 1)]),
    "collapse": (op(m.CollapseNode("c"), op(m.CrossNode(), emp(), dep())), ["c.name", "c.city"], [(e, d) for e in ("ana", "bob", "cid", "dan") for d in ("sp", "rj", "bh")]),
    "explode": (op(m.ExplodeNode("e.tags", ";"), emp()), ["e.name", "e.tags"], [("ana", "x"), ("ana", "y"), ("bob", "z"), ("cid", "w"), ("dan", "q")], True),
    "autoInc": (op(m.RowNumberNode("r", "n"), emp()), ["r.n", "e.name"], [(1, "ana"), (2, "bob"), (3, "cid"), (4, "dan")], True),
    "hash": (join("INNER", "NESTED_LOOP", emp(), op(m.HashIndexNode(), dep()), ON), ["e.name", "d.city"], INNER),
    "memoize": (join("INNER", "NESTED_LOOP", emp(), op(m.MemoizeNode(), dep()), ON), ["e.name", "d.city"], INNER),
    "materialization": (join("INNER", "NESTED_LOOP", emp(), op(m.MaterializeNode(), dep()), ON), ["e.name", "d.city"], INNER),
    "scan": (where(op(m.ScanNode(), emp()), cmp("e.id", ">", 3)), ["e.name"], [("dan",)]),
    "reference": (op(m.CrossNode(), emp(), op(m.ReferenceNode(("e.dept", "e.name")))), ["ref.e_name", "ref.e_dept"], [("ana", 10), ("bob", 20), ("cid", 10), ("dan", 40)]),
    "cartesianProduct": (op(m.CrossNode(), emp(), filtered_dep()), ["e.name", "d.city"], INNER),
    "append": (op(m.SetOpNode("APPEND", False, "u"), where(emp("a"), cmp("a.dept", "=", 10)), where(emp("b"), cmp("b.id", ">", 2))), ["u.name"], [("ana",), ("cid",), ("cid",), ("dan",)], True),
    "unilateralExistence": (op(m.ExistsNode(False), emp(), dep()), ["e.name", "d.city"], [("ana", None)]),
    "bilateralExistence": (op(m.ExistsNode(True), emp(), dep()), ["e.name", "d.city"], [("ana", "sp")]),
    "logicalAnd": (op(m.LogicalOpNode("AND"), emp(), none()), [], [(False,)]),
    "logicalOr": (op(m.LogicalOpNode("OR"), emp(), none()), [], [(True,)]),
    "logicalXor": (op(m.LogicalOpNode("XOR"), emp(), none()), [], [(True,)]),
    "condition": (join("LEFT_SEMI", "NESTED_LOOP", emp(), op(m.ConditionNode(cmp("e.dept", ">", 15)))), ["e.name"], [("bob",), ("dan",)]),
}
OUTER = {
    "INNER": (["e.name", "d.city"], INNER), "LEFT": (["e.name", "d.city"], INNER | {("dan", None)}), "RIGHT": (["e.name", "d.city"], INNER | {(None, "bh")}),
    "FULL": (["e.name", "d.city"], INNER | {("dan", None), (None, "bh")}), "LEFT_SEMI": (["e.name"], {("ana",), ("cid",), ("bob",)}), "LEFT_ANTI": (["e.name"], {("dan",)}),
    "RIGHT_SEMI": (["d.city"], {("sp",), ("rj",)}), "RIGHT_ANTI": (["d.city"], {("bh",)}),
}
SETS = {"UNION": [("ana",), ("cid",), ("dan",)], "INTERSECT": [("cid",)], "EXCEPT": [("ana",)]}


def check(spark, query, columns, want, ordered=False):
    got = rows(spark, query, *columns)
    assert got == list(want) if ordered else sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("key", sorted(CASES))
def test_operator(spark, key):
    check(spark, *CASES[key])


@pytest.mark.parametrize("algorithm", m.ALGORITHMS)
@pytest.mark.parametrize("kind", m.JOIN_TYPES)
def test_join(spark, kind, algorithm):
    columns, want = OUTER[kind]
    check(spark, join(kind, algorithm, emp(), dep(), ON), columns, want)


@pytest.mark.parametrize("hashed", [True, False])
@pytest.mark.parametrize("kind", sorted(SETS))
def test_set_operation(spark, kind, hashed):
    sides = [project(where(emp("a"), cmp("a.dept", "=", 10)), "a.name"), project(where(emp("b"), cmp("b.id", ">", 2)), "b.name")]
    check(spark, op(m.SetOpNode(kind, hashed), *sides), [], SETS[kind])


def test_every_chip_has_a_case():
    covered = set(CASES)
    for chip in CHIPS:
        node = chip.template
        assert chip.key in covered or (isinstance(node, m.JoinNode) and node.type in OUTER) or (isinstance(node, m.SetOpNode) and node.kind_ in SETS), chip.key
    assert len(CHIPS) == 52


# Naming and scope


def test_projection_is_regrouped_by_source(spark):
    q = project(op(m.CrossNode(), emp(), dep()), "d.city", "e.name", "d.id")
    assert names(spark, q) == ["e.name", "d.city", "d.id"]


def test_right_nested_loop_puts_the_right_side_first(spark):
    assert names(spark, join("RIGHT", "NESTED_LOOP", emp(), dep(), ON))[:2] == ["d.id", "d.city"]
    assert names(spark, join("RIGHT", "HASH", emp(), dep(), ON))[0] == "e.id"


def test_unqualified_names_are_those_of_the_first_source(spark):
    q = op(m.CrossNode(), emp(), dep())
    assert len(rows(spark, where(q, cmp("id", "=", 1)))) == 3
    with pytest.raises(PlanError, match="not found"):
        rows(spark, where(q, cmp("city", "=", "sp")))


def test_equal_names_after_a_collapse(spark):
    q = op(m.CollapseNode("c"), op(m.CrossNode(), emp(), dep()))
    assert rows(spark, op(m.LimitNode(1), q)) == [(1, "ana", 10, "x;y", 10, "sp")]
    assert set(rows(spark, q, "c.id")) == {(10,), (20,), (30,)}


def test_set_operations_keep_or_take_names(spark):
    a, b = project(emp("a"), "a.name"), project(emp("b"), "b.name")
    assert names(spark, op(m.SetOpNode("UNION", True, "u"), a, b)) == ["u.name"]
    assert names(spark, op(m.SetOpNode("UNION", True), a, b)) == ["a.name"]
    assert names(spark, op(m.SetOpNode("INTERSECT", True, "u"), a, b)) == ["a.name"]
    wide = op(m.CrossNode(), emp("a"), dep("b"))
    again = op(m.CrossNode(), emp("c"), dep("d"))
    assert names(spark, op(m.SetOpNode("UNION", False), wide, again))[0] == "Union.id"
    assert len(rows(spark, op(m.SetOpNode("UNION", False), wide, again))) == 12
    with pytest.raises(PlanError, match="columns"):
        rows(spark, op(m.SetOpNode("UNION", False), wide, emp("c")))


def test_rename_of_a_column_or_of_nothing(spark):
    q = op(m.AliasNode("e.name", "e.nome"), emp())
    assert names(spark, q)[1] == "e.nome"
    with pytest.raises(PlanError, match="not found"):
        names(spark, op(m.AliasNode("z", "y"), emp()))


# Values


NULLS = memory("t", [m.Column("k", "INT"), m.Column("v", "INT"), m.Column("s", "STRING")], [(1, None, "a;;b;;"), (None, 5, None), (1, 7, ";;"), (None, None, "")])


def test_nulls_in_keys_groups_and_sets(spark):
    t = lambda a: table(NULLS, a)
    for algorithm in m.ALGORITHMS:
        assert len(rows(spark, join("INNER", algorithm, t("a"), t("b"), ("a.k", "b.k")))) == 4
        assert len(rows(spark, join("LEFT_ANTI", algorithm, t("a"), t("b"), ("a.k", "b.k")))) == 2
    assert rows(spark, group(t("a"), "a.k", ("COUNT_ALL", "a.v"), ("COUNT_NULL", "a.v"), ("SUM", "a.v"), ("FIRST", "a.v"), ("LAST", "a.v"), alias="g")) == [(None, 2, 1, 5, 5, 5), (1, 2, 1, 7, 7, 7)]
    same = op(m.SetOpNode("INTERSECT"), project(t("a"), "a.k"), project(t("b"), "b.k"))
    assert sorted(rows(spark, same), key=str) == [(1,), (1,), (None,), (None,)]
    assert rows(spark, sort(project(t("a"), "a.v"), "a.v")) == [(None,), (None,), (5,), (7,)]
    assert rows(spark, sort(project(t("a"), "a.v"), "a.v", up=False)) == [(7,), (5,), (None,), (None,)]
    assert rows(spark, where(t("a"), cmp("a.v", "!=", 5)), "a.v") == [(7,)]


def test_explode_splits_like_text(spark):
    assert rows(spark, op(m.ExplodeNode("t.s", ";"), table(NULLS, "t")), "t.s") == [("a",), ("",), ("b",), (None,), ("",), ("",)]
    dots = memory("t", [m.Column("s", "STRING")], [(" a . b ",)])
    assert rows(spark, op(m.ExplodeNode("t.s", "."), table(dots, "t"))) == [("a",), ("b",)]
    assert rows(spark, op(m.ExplodeNode("t.s", "\\s*\\.\\s*"), table(dots, "t")), options=Options(explode_regex=True)) == [("a",), ("b",)]
    with pytest.raises(PlanError):
        rows(spark, op(m.ExplodeNode("e.dept", ";"), emp()))


def test_types_must_be_comparable(spark):
    assert len(rows(spark, where(emp(), m.Comparison("e.dept", "EQ", L("long", 10))))) == 2
    with pytest.raises(PlanError, match="compared"):
        rows(spark, where(emp(), cmp("e.dept", "=", "10")))
    with pytest.raises(PlanError, match="joined"):
        rows(spark, join("INNER", "HASH", emp(), dep(), ("e.dept", "d.city")))
    with pytest.raises(PlanError, match="number"):
        rows(spark, group(emp(), None, ("SUM", "e.name")))


def test_aggregates(spark):
    whole = group(emp(), None, ("MAX", "e.id"), ("AVG", "e.id"), ("SUM", "e.dept"), ("FIRST", "e.name"), ("LAST", "e.name"), ("COUNT_ALL", "e.id"), ("COUNT_NULL", "e.id"))
    assert rows(spark, whole) == [(4, 2.5, 80, "ana", "dan", 4, 0)]
    assert rows(spark, group(emp(), None, ("AVG", "e.id")), options=Options(truncate_avg=True)) == [(2.0,)]
    backwards = group(sort(emp(), "e.name", up=False), None, ("FIRST", "e.id"))
    assert rows(spark, group(sort(emp(), "e.id", up=False), None, ("FIRST", "e.name"))) == [("dan",)]
    assert rows(spark, backwards) in ([(4,)], [(1,)])
    big = memory("t", [m.Column("v", "INT")], [(2**31 - 1,)] * 3)
    assert rows(spark, group(table(big, "t"), None, ("SUM", "t.v"))) == [(3 * (2**31 - 1),)]
    with pytest.raises(PlanError, match="one name"):
        rows(spark, group(op(m.CrossNode(), emp(), dep()), None, ("MAX", "e.id"), ("MAX", "d.id")))


def test_runs_of_equal_keys(spark):
    t = memory("o", [m.Column("u", "INT"), m.Column("n", "INT")], [(1, 250), (3, 900), (1, 50)])
    q = group(table(t, "o"), "o.u", ("SUM", "o.n"), hashed=False)
    assert sorted(rows(spark, q)) == [(1, 300), (3, 900)]
    assert sorted(rows(spark, q, options=Options(fragment_sorted_groups=True))) == [(1, 50), (1, 250), (3, 900)]


def test_bag_union_and_xor_options(spark):
    a, b = project(emp("a"), "a.dept"), project(where(emp("b"), cmp("b.dept", "<", 30)), "b.dept")
    assert rows(spark, op(m.SetOpNode("UNION"), a, b), options=Options(bag_union=True)) == [(10,), (20,), (10,), (40,)]
    xor = op(m.LogicalOpNode("XOR"), emp(), none())
    assert rows(spark, xor, options=Options(xor_empty_is_true=True)) == [(False,)]


def test_primary_key_filters_and_joins(spark):
    k = table(EMP_KEY, "k")
    assert rows(spark, where(k, cmp("k.id", "=", 1)), "k.name") == [("ana",)]
    assert len(rows(spark, join("INNER", "NESTED_LOOP", dep(), k, ("d.id", "k.dept")))) == 3


def test_pruning_and_pushdown_reach_the_files(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as v", "cast(id as string) as s").write.parquet(f"{tmp_path}/t")
    q = project(where(table(m.ParquetTable("t", f"{tmp_path}/t"), "t"), cmp("t.v", ">", 5)), "t.id")
    plan = Compiler(spark).compile(q).output()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,5)]" in plan and "ReadSchema: struct<id:bigint,v:bigint>" in plan


def test_numbers_over_many_partitions(spark):
    q = op(m.RowNumberNode("r", "n"), sort(emp(), "e.name", up=False))
    assert rows(spark, q, "r.n", "e.name", options=Options(partitioned_row_numbers=True)) == [(1, "dan"), (2, "cid"), (3, "bob"), (4, "ana")]
