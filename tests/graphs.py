"""Small tables and a notation for sessions in tests."""

from weft.operators.compiler import Compiler, Options
from weft.plans import graph as g
from weft.plans import model as m
from weft.registry import cmp, group, join, op, project, ref, sort, table, where

L = m.Literal


def memory(name, columns, rows):
    tags = {"INT": "int", "LONG": "long", "DOUBLE": "double", "STRING": "str", "BOOLEAN": "bool"}
    cells = lambda row: tuple((c.name, None if v is None else L(tags[c.type], v)) for c, v in zip(columns, row, strict=True))
    return m.MemoryTable(name, tuple(columns), tuple(map(cells, rows)))


INT, TEXT = "INT", "STRING"
EMP_ROWS = [(1, "ana", 10, "x;y"), (2, "bob", 20, "z"), (3, "cid", 10, "w"), (4, "dan", 40, "q")]
DEP_ROWS = [(10, "sp"), (20, "rj"), (30, "bh")]
EMP = memory("emp", [m.Column("id", INT), m.Column("name", TEXT), m.Column("dept", INT), m.Column("tags", TEXT)], EMP_ROWS)
EMP_KEY = memory("empkey", [m.Column("id", INT, True, False), m.Column("name", TEXT), m.Column("dept", INT), m.Column("tags", TEXT)], EMP_ROWS)
DEP = memory("dep", [m.Column("id", INT), m.Column("city", TEXT)], DEP_ROWS)


def emp(alias="e"):
    return table(EMP, alias)


def dep(alias="d"):
    return table(DEP, alias)


def rows(spark, query, *columns, options=Options()):
    """The rows in order; with columns ('source.name'), only these."""
    relation = Compiler(spark, options).compile(query)
    relation = relation.with_(df=relation.df.orderBy(*relation.ordering()))
    if columns:
        return [tuple(r) for r in relation.df.select(*[relation.need(c).physical for c in columns]).collect()]
    return [tuple(r) for r in relation.output().collect()]


def names(spark, query, options=Options()):
    return [f"{s.alias}.{f.name}" for s in Compiler(spark, options).compile(query).sources for f in s.fields]


__all__ = ["g", "m", "cmp", "group", "join", "op", "project", "ref", "sort", "table", "where", "memory", "emp", "dep", "rows", "names", "EMP", "EMP_KEY", "DEP", "L", "Options", "Compiler"]
