"""Queries over whole tables: nothing is cut by an id, so that results grow with the tables."""

import os

import pytest

from tests import oracle
from weft import registry

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGE), reason="test tables are not here")


def counts(spark, name):
    return [registry.queries()[name](spark, d).count() for d in (SMALL, LARGE)]


def sizes(condition):
    return [oracle.connect(d).execute(f"SELECT count(*) FROM {condition}").fetchone()[0] for d in (SMALL, LARGE)]


@pytest.mark.parametrize("algorithm", ["nested_loop", "hash", "merge"])
def test_joins_read_whole_tables(spark, algorithm):
    orders, customers = sizes("orders"), sizes("customer")
    assert counts(spark, f"join_inner_{algorithm}") == orders
    assert counts(spark, f"join_right_semi_{algorithm}") == orders
    assert counts(spark, f"join_left_semi_{algorithm}") == customers
    for kind, late in (("left_anti", "customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"), ("right_anti", "orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")):
        assert counts(spark, f"join_unmatched_{kind}_{algorithm}") == (want := sizes(late)) and min(want) > 0


def test_set_operations_read_whole_columns(spark):
    orders, events, customers = sizes("orders"), sizes("events"), sizes("(SELECT DISTINCT o_custkey FROM orders)")
    inside = sizes("orders WHERE o_custkey IN (SELECT user_id FROM events)")
    assert counts(spark, "set_append") == [a + b for a, b in zip(orders, events, strict=True)]
    assert counts(spark, "set_union_bag") == [e + o - i for e, o, i in zip(events, orders, inside, strict=True)]
    for name in ("hash", "sorted"):
        assert counts(spark, f"set_union_{name}") == customers
        assert counts(spark, f"set_intersect_{name}") == inside and min(inside) > 0
        assert counts(spark, f"set_except_{name}") == [a - b for a, b in zip(orders, inside, strict=True)] and inside[0] < orders[0]


def test_filter_and_rename_read_whole_tables(spark):
    assert counts(spark, "filter_is_not_null") == sizes("events WHERE props IS NOT NULL")
    assert counts(spark, "rename_source") == sizes("customer")
