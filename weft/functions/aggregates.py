"""The nine aggregates. Counts are LONG; an aggregate over no values is NULL, a count 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.errors import PlanError
from weft.operators.relation import NUMERIC, Field
from weft.plans.model import Aggregate


def order_struct(order: list[tuple[str, bool]], kinds: dict[str, str]) -> Column:
    """One value that sorts as the input order does. A descending number is negated; other descending keys can't be."""
    return F.struct(*[(F.col(c) if up else -F.col(c)).alias(f"k{i}") for i, (c, up) in enumerate(order) if up or kinds[c] in ("int", "bigint", "float", "double", "smallint", "tinyint")])


def aggregate(spec: Aggregate, field: Field, order: list[tuple[str, bool]], kinds: dict[str, str], truncate_avg: bool = False) -> Column:
    column = F.col(field.physical)
    numeric = field.type in NUMERIC or kinds[field.physical].startswith("decimal")
    match spec.function:
        case "COUNT_ALL":
            return F.count(F.lit(1))
        case "COUNT_NULL":
            return F.count(F.when(column.isNull(), F.lit(1)))
        case "COUNT":
            return F.count(column)
        case "MIN":
            return F.min(column)
        case "MAX":
            return F.max(column)
        case "FIRST" | "LAST":
            pick = F.min_by if spec.function == "FIRST" else F.max_by
            return pick(column, F.when(column.isNotNull(), order_struct(order, kinds)))
    if not numeric:
        raise PlanError(f"{spec.function} needs a number, and '{field.name}' is {field.type}")
    if spec.function == "SUM":
        return F.sum(column)
    if truncate_avg and field.type in ("INT", "LONG"):
        return F.expr(f"cast(sum(`{field.physical}`) div count(`{field.physical}`) as double)")
    return F.avg(column)


def default(function: str) -> int | None:
    """The value over no rows at all."""
    return 0 if function.startswith("COUNT") else None
