"""A compiled operator: a DataFrame with unique physical columns, and what they mean.

A row of the graph language is a list of named sources with named columns, in which names may repeat.  Here every
column has a physical name of its own, so that self-joins, equal names and dots need no care; renaming is only metadata.

``order`` lists the sort expressions that give the input order its meaning; Catalyst drops them where nothing asks.
``domain`` maps an outer column (by its physical name in the providing relation) to the column that carries its value
here: rows then stand for all outer rows at once (see :mod:`weft.operators.compiler`).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.errors import PlanError
from weft.plans.model import split_reference

_numbers = itertools.count()


def fresh(prefix: str = "c") -> str:
    return f"{prefix}{next(_numbers)}"


#: Document type for a Spark type; other Spark types pass through under their own name.
TYPE_NAMES = {T.ByteType: "INT", T.ShortType: "INT", T.IntegerType: "INT", T.LongType: "LONG", T.FloatType: "FLOAT", T.DoubleType: "DOUBLE", T.StringType: "STRING", T.BooleanType: "BOOLEAN"}
SPARK_TYPES = {"INT": T.IntegerType(), "LONG": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType()}
NUMERIC = ("INT", "LONG", "FLOAT", "DOUBLE")


def type_name(kind: T.DataType) -> str:
    return "DOUBLE" if isinstance(kind, T.DecimalType) else TYPE_NAMES.get(type(kind), kind.simpleString().upper())


@dataclass(frozen=True)
class Field:
    name: str
    physical: str
    type: str
    primary_key: bool = False


@dataclass(frozen=True)
class SourceFields:
    alias: str
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    sources: tuple[SourceFields, ...]
    order: tuple[tuple[str, bool], ...] = ()
    domain: dict[str, str] = field(default_factory=dict)
    #: A truth value (condition, logical operation): as a receiver it is a predicate.
    truth: bool = False

    @property
    def fields(self) -> list[Field]:
        return [f for s in self.sources for f in s.fields]

    @property
    def columns(self) -> list[str]:
        return [f.physical for f in self.fields]

    def find(self, reference: str) -> Field | None:
        """The column a reference names: with a source, in the first source of that name, else in the first source.

        Of equal names in a source the last one counts.
        """
        source, name = split_reference(reference)
        for s in self.sources if source is not None else self.sources[:1]:
            if source is None or s.alias == source:
                return next((f for f in reversed(s.fields) if f.name == name), None)
        return None

    def need(self, reference: str) -> Field:
        found = self.find(reference)
        if found is None:
            known = ", ".join(f"{s.alias}.{f.name}" for s in self.sources for f in s.fields)
            raise PlanError(f"column '{reference}' not found among {known}")
        return found

    def with_(self, **changes) -> "Relation":
        return replace(self, **changes)

    def ordering(self) -> list[Column]:
        """The input order, made total by all columns. Nulls come first ascending, last descending."""
        keys = [(F.col(c).asc() if up else F.col(c).desc()) for c, up in self.order]
        known = {c for c, _ in self.order}
        kinds = dict(self.df.dtypes)
        return keys + [F.col(c) for c in self.columns if c not in known and not kinds[c].startswith(("map", "variant"))]

    def renamed(self) -> "Relation":
        """The same rows under new physical names, so that one relation can be used twice in a plan."""
        new = {c: fresh() for c in self.df.columns}
        sources = tuple(SourceFields(s.alias, tuple(replace(f, physical=new[f.physical]) for f in s.fields)) for s in self.sources)
        df = self.df.select(*[F.col(c).alias(n) for c, n in new.items()])
        return self.with_(df=df, sources=sources, order=tuple((new[c], up) for c, up in self.order), domain={k: new[c] for k, c in self.domain.items()})

    def output(self) -> DataFrame:
        """The rows for a caller: bare column names, or all with their sources if two would be the same."""
        names = self.output_names()
        return self.df.select(*[F.col(f.physical).alias(n) for f, n in zip(self.fields, names, strict=True)])

    def output_names(self) -> list[str]:
        bare = [f.name for f in self.fields]
        if len({n.lower() for n in bare}) == len(bare):
            return bare
        return [f"{s.alias}.{f.name}" for s in self.sources for f in s.fields]
