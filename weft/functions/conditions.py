"""Conditions as Spark expressions. A comparison with NULL holds for no operator, as in a WHERE clause."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.errors import PlanError
from weft.operators.relation import NUMERIC, SPARK_TYPES
from weft.plans.model import And, Comparison, Condition, IsNotNull, IsNull, Literal, Or

_OPERATORS = {"EQ": operator.eq, "NEQ": operator.ne, "GT": operator.gt, "GTE": operator.ge, "LT": operator.lt, "LTE": operator.le}
LITERAL_TYPES = {"int": "INT", "long": "LONG", "float": "FLOAT", "double": "DOUBLE", "bool": "BOOLEAN", "str": "STRING"}

#: Gives the expression and the type of a reference.
Resolve = Callable[[str], tuple[Column, str]]


def literal(value: Literal) -> tuple[Column, str]:
    kind = LITERAL_TYPES[value.tag]
    return F.lit(value.value).cast(SPARK_TYPES[kind]), kind


def comparable(a: str, b: str) -> bool:
    return a == b or (a in NUMERIC and b in NUMERIC) or not {a, b} <= {*NUMERIC, "STRING", "BOOLEAN"} and "BOOLEAN" not in (a, b)


def to_column(condition: Condition, resolve: Resolve) -> Column:
    match condition:
        case Comparison(left=left, op=op, right=right):
            a, left_type = resolve(left)
            b, right_type = literal(right) if isinstance(right, Literal) else resolve(right.column)
            if not comparable(left_type, right_type):
                raise PlanError(f"'{left}' is {left_type} and can't be compared with {right_type}")
            return _OPERATORS[op](a, b)
        case IsNull(column=column):
            return resolve(column)[0].isNull()
        case IsNotNull(column=column):
            return resolve(column)[0].isNotNull()
        case And(conditions=parts):
            return reduce(operator.and_, [to_column(c, resolve) for c in parts])
        case Or(conditions=parts):
            return reduce(operator.or_, [to_column(c, resolve) for c in parts])
    raise PlanError(f"unknown condition {condition!r}")


def references(condition: Condition) -> list[str]:
    """Every column that a condition names, in order."""
    match condition:
        case Comparison(left=left, right=right):
            return [left] if isinstance(right, Literal) else [left, right.column]
        case IsNull(column=column) | IsNotNull(column=column):
            return [column]
        case And(conditions=parts) | Or(conditions=parts):
            return [r for c in parts for r in references(c)]
    return []
