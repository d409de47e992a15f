"""From a query to DataFrames: one function for each kind of operator.

Correlation.  A nested-loop join or a cross product gives its provider's rows to its receiver, where anything below may
read their columns, at any depth.  Nothing is run once for each row.  The receiver is compiled once for all provider
rows together: it carries, as further columns, the distinct outer values it reads (its *domain*), and is then joined to
the provider on these, null-safe.  Operators treat a domain as part of a row's identity: aggregates group by it, limits
and row numbers are taken within it, distinct and set operations compare it.  (Neumann and Kemper, "Unnesting Arbitrary
Queries", BTW 2015.)  A receiver that only filters needs no domain: its predicate becomes the join's condition.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.errors import PlanError
from weft.functions import conditions
from weft.functions.aggregates import aggregate, default
from weft.operators.relation import SPARK_TYPES, Field, Relation, SourceFields, fresh, type_name
from weft.plans import model as m
from weft.plans.graph import Query
from weft.sources import tables


#: Bytes of a partition of a join's build side up to which it is hashed; bytes of rows that one task may number.
HASH_BYTES, ONE_TASK = 64 << 20, 64 << 20


@dataclass(frozen=True)
class Options:
    """Where behaviours differ between engines; the defaults are those of SQL."""

    csv_nulls: str = "null"  #: or "sentinel": an empty CSV value is the type's sentinel
    explode_regex: bool = False  #: the delimiter of explode is a regular expression
    fragment_sorted_groups: bool = False  #: sorted aggregation groups runs of equal keys
    truncate_avg: bool = False  #: the average of whole numbers is cut to a whole number
    bag_union: bool = False  #: hash union keeps duplicates of either side
    xor_empty_is_true: bool = False  #: an empty side of XOR counts as true
    partitioned_row_numbers: bool | None = None  #: number rows over many partitions, through the shared folder; None: above ONE_TASK bytes


@dataclass
class Domain:
    """Outer values in independent factors, each a frame of distinct rows and the outer columns its columns stand for.

    Their product is what a receiver may meet; it is only formed where an operator needs all of it.
    """

    factors: list[tuple[DataFrame, dict[str, str]]]

    def column(self, k: str) -> str:
        return next(ids[k] for _, ids in self.factors if k in ids)


@dataclass
class Scope:
    """The providers a receiver may read, outermost first, and the domain that carries their values.

    Without a domain (a trial) outer columns are only noted.
    """

    providers: tuple[Relation, ...] = ()
    domain: Domain | None = None
    noted: dict[str, Field] = field(default_factory=dict)

    @property
    def trial(self) -> bool:
        """Whether a receiver is compiled only for its columns and for what it reads."""
        return bool(self.providers) and self.domain is None

    def find(self, reference: str) -> Field | None:
        return next((f for p in self.providers if (f := p.find(reference))), None)


NARROW = (m.FilterNode, m.ScanNode, m.MaterializeNode, m.MemoizeNode, m.HashIndexNode, m.AliasNode, m.CollapseNode)


class Compiler:
    def __init__(self, spark: SparkSession, options: Options = Options()):
        self.spark, self.options = spark, options
        self._opened: dict[tuple, Relation] = {}

    def compile(self, query: Query, scope: Scope | None = None) -> Relation:
        scope = scope or Scope()
        node = query.node
        if isinstance(node, m.TableNode):
            return self._table(query.table, node.alias)
        if isinstance(node, m.JoinNode | m.CrossNode):
            return self._join(query, scope)
        inputs = [self.compile(q, scope) for q in query.inputs]
        return getattr(self, "_" + node.kind)(node, *inputs, scope=scope)

    def _table(self, table: m.Table, alias: str) -> Relation:
        """A table is opened once; each use has columns of its own."""
        if (table, alias) not in self._opened:
            self._opened[table, alias] = tables.open_table(self.spark, table, alias, self.options)
        return self._opened[table, alias].renamed()

    # Outer columns and domains

    def _resolver(self, relation: Relation | None, scope: Scope):
        """A function from references to (expression, type), local columns first; and the outer columns it met."""
        met: dict[str, Field] = {}

        def resolve(reference: str) -> tuple[Column, str]:
            found = relation.find(reference) if relation else None
            if found:
                return F.col(found.physical), found.type
            outer = scope.find(reference)
            if outer is None:
                if relation is None:
                    raise PlanError(f"column '{reference}' not found: no join gives its rows here")
                relation.need(reference)
            met[outer.physical] = outer
            scope.noted[outer.physical] = outer
            if scope.domain is None:
                return F.lit(None).cast(SPARK_TYPES.get(outer.type, "string")), outer.type
            held = relation.domain.get(outer.physical) if relation else None
            return F.col(held or scope.domain.column(outer.physical)), outer.type

        return resolve, met

    @staticmethod
    def _factors(scope: Scope, ids) -> tuple[list[DataFrame], dict[str, str]]:
        """The distinct outer values for some outer columns, by factor, under new names."""
        names, frames = {k: fresh("d") for k in ids}, []
        for df, of in scope.domain.factors:
            mine = [k for k in of if k in names]
            if mine:
                wanted = df.select(*[F.col(of[k]).alias(names[k]) for k in mine])
                frames.append(wanted if len(mine) == len(of) else wanted.distinct())
        return frames, names

    def _values(self, scope: Scope, ids) -> tuple[DataFrame, dict[str, str]]:
        """The product of these factors."""
        frames, names = self._factors(scope, ids)
        return reduce(DataFrame.crossJoin, frames), names

    def _carry(self, relation: Relation, ids, scope: Scope) -> Relation:
        """The relation with these outer columns in its domain, each row once for every value it doesn't carry yet."""
        missing = [k for k in ids if k not in relation.domain]
        if not missing or scope.domain is None:
            return relation
        values, names = self._values(scope, missing)
        return relation.with_(df=relation.df.crossJoin(values), domain=relation.domain | names)

    @staticmethod
    def _pairs(a: Relation, b: Relation) -> list[Column]:
        return [F.col(a.domain[k]).eqNullSafe(F.col(b.domain[k])) for k in a.domain if k in b.domain]

    # Sources without inputs

    def _one_row(self, met, scope: Scope) -> Relation:
        if met and scope.domain is not None:
            values, names = self._values(scope, met)
            return Relation(values, (), domain=names)
        return Relation(self.spark.range(1).select(F.lit(0).alias(fresh("o"))), ())

    def _condition(self, node: m.ConditionNode, scope: Scope) -> Relation:
        resolve, met = self._resolver(None, scope)
        conditions.to_column(node.condition, resolve)
        base = self._one_row(met, scope)
        resolve, _ = self._resolver(base, scope)
        name = fresh()
        truth = F.coalesce(conditions.to_column(node.condition, resolve), F.lit(False))
        source = SourceFields(node.alias, (Field("EVAL", name, "BOOLEAN"),))
        return base.with_(df=base.df.withColumn(name, truth), sources=(source,), truth=True)

    def _reference(self, node: m.ReferenceNode, scope: Scope) -> Relation:
        resolve, met = self._resolver(None, scope)
        for c in node.columns:
            resolve(c)
        base = self._one_row(met, scope)
        resolve, _ = self._resolver(base, scope)
        fields, df = [], base.df
        for c in node.columns:
            value, kind = resolve(c)
            fields.append(Field(c.replace(".", "_", 1), fresh(), kind))
            df = df.withColumn(fields[-1].physical, value)
        return base.with_(df=df, sources=(SourceFields(node.alias, tuple(fields)),))

    # One input

    def _filter(self, node: m.FilterNode, rel: Relation, scope: Scope) -> Relation:
        resolve, met = self._resolver(rel, scope)
        predicate = conditions.to_column(node.condition, resolve)
        missing = [k for k in met if k not in rel.domain]
        if not missing or scope.domain is None:
            return rel.with_(df=rel.df.filter(predicate), truth=False)
        # Values that the rows don't carry yet come by a join on the predicate itself.
        # Written as one product under a filter, which Spark takes apart into a join for each factor.
        frames, names = self._factors(scope, missing)
        wide = rel.with_(domain=rel.domain | names)
        predicate = conditions.to_column(node.condition, self._resolver(wide, scope)[0])
        return wide.with_(df=reduce(DataFrame.crossJoin, frames, rel.df).filter(predicate), truth=False)

    def _project(self, node: m.ProjectNode, rel: Relation, scope: Scope) -> Relation:
        wanted = [rel.need(c) for c in node.columns]
        sources = []
        for s in rel.sources:
            mine = tuple(f for f in wanted if f in s.fields)
            if mine:
                sources.append(SourceFields(s.alias, mine))
        return rel.with_(sources=tuple(sources), truth=False)

    def _removeColumns(self, node: m.RemoveColumnsNode, rel: Relation, scope: Scope) -> Relation:
        gone = [rel.need(c) for c in node.columns]
        left = tuple(f for f in rel.fields if f not in gone)
        if not left:
            raise PlanError("no column is left")
        return rel.with_(sources=(SourceFields(node.alias, left),), truth=False)

    def _alias(self, node: m.AliasNode, rel: Relation, scope: Scope) -> Relation:
        if any(s.alias == node.from_ for s in rel.sources):
            return rel.with_(sources=tuple(SourceFields(node.to if s.alias == node.from_ else s.alias, s.fields) for s in rel.sources))
        if "." not in node.from_ or rel.find(node.from_) is None:
            raise PlanError(f"source '{node.from_}' not found")
        old, name = rel.need(node.from_), m.split_reference(node.to)[1]
        change = lambda f: Field(name, f.physical, f.type, f.primary_key) if f == old else f
        return rel.with_(sources=tuple(SourceFields(s.alias, tuple(map(change, s.fields))) for s in rel.sources))

    def _collapse(self, node: m.CollapseNode, rel: Relation, scope: Scope) -> Relation:
        return rel.with_(sources=(SourceFields(node.alias, tuple(rel.fields)),))

    def _sort(self, node: m.SortNode, rel: Relation, scope: Scope) -> Relation:
        keys = tuple((rel.need(k.column).physical, k.ascending) for k in node.keys)
        later = tuple(o for o in rel.order if o[0] not in {c for c, _ in keys})
        # Only what reads the order (a limit, a row number, the result itself) makes Spark sort.
        return rel.with_(order=keys + later)

    def _distinct(self, node: m.DistinctNode, rel: Relation, scope: Scope) -> Relation:
        kept = rel.columns + list(rel.domain.values())
        return rel.with_(df=rel.df.select(*kept).distinct(), order=tuple(o for o in rel.order if o[0] in rel.columns))

    def _limit(self, node: m.LimitNode, rel: Relation, scope: Scope) -> Relation:
        if not rel.domain:
            df = rel.df.orderBy(*rel.ordering())
            return rel.with_(df=(df.offset(node.offset) if node.offset else df).limit(node.count))
        rank = fresh("r")
        window = Window.partitionBy(*rel.domain.values()).orderBy(*rel.ordering())
        df = rel.df.withColumn(rank, F.row_number().over(window)).filter((F.col(rank) > node.offset) & (F.col(rank) <= node.offset + node.count))
        return rel.with_(df=df.drop(rank))

    def _explode(self, node: m.ExplodeNode, rel: Relation, scope: Scope) -> Relation:
        old = rel.need(node.column)
        if old.type != "STRING":
            raise PlanError(f"explode needs text, and '{node.column}' is {old.type}")
        name, place = fresh(), fresh("o")
        pattern = node.delimiter if self.options.explode_regex else "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in node.delimiter)
        parts = F.split(F.col(old.physical), pattern, -1)
        last = F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
        kept = F.when(F.col(old.physical).isNull(), F.array(F.lit(None).cast("string"))).when(last == 0, F.array(F.lit(""))).otherwise(F.transform(F.slice(parts, 1, last), lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")))
        df = rel.df.select("*", F.posexplode(kept).alias(place, name)).drop(old.physical)
        change = lambda f: Field(f.name, name, f.type) if f == old else f
        order = tuple((name if c == old.physical else c, up) for c, up in rel.order)
        return rel.with_(df=df, sources=tuple(SourceFields(s.alias, tuple(map(change, s.fields))) for s in rel.sources), order=(*order, (place, True)), truth=False)

    def _rowNumber(self, node: m.RowNumberNode, rel: Relation, scope: Scope) -> Relation:
        name = fresh()
        partitioned = self.options.partitioned_row_numbers
        if not rel.domain and (self._bytes(rel.df) > ONE_TASK if partitioned is None else partitioned):
            df = self._numbered(rel, name, node.start)
        else:
            window = Window.partitionBy(*rel.domain.values()).orderBy(*rel.ordering())
            df = rel.df.withColumn(name, (F.row_number().over(window) + F.lit(node.start - 1)).cast("int"))
        source = SourceFields(node.alias, (Field(node.column, name, "INT"),))
        return rel.with_(df=df, sources=(source, *rel.sources), order=((name, True),), truth=False)

    def _numbered(self, rel: Relation, name: str, start: int) -> DataFrame:
        """Row numbers without a single-partition window: sort by range, write, count by partition, add what is before."""
        from weft.sources.shared import written

        part, place = fresh("p"), fresh("i")
        ordered = rel.df.orderBy(*rel.ordering()).withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        ordered = written(ordered)  # ranges are sampled anew each time a sort is planned, so that the rows must stand still
        counts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n"))  # one row a partition
        before = counts.select(F.col(part), (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias("before"))
        return ordered.join(F.broadcast(before), part).withColumn(name, (F.col("before") + F.col(place) + F.lit(start)).cast("int")).drop(part, place, "before")

    def _agg(self, node: m.AggNode, rel: Relation, scope: Scope) -> Relation:
        by = rel.need(node.by) if node.by is not None else None
        names = [f"{a.function}_{m.split_reference(a.column)[1]}" for a in node.aggregates]
        if len({n.lower() for n in ([by.name] if by else []) + names}) < len(names) + bool(by):
            raise PlanError("two columns of the aggregation have one name")
        kinds = dict(rel.df.dtypes)
        order = list(rel.order) or [(c, True) for c in rel.columns]
        out, expressions = [], []
        for a, n in zip(node.aggregates, names, strict=True):
            of = rel.need(a.column) if a.function != "COUNT_ALL" or rel.find(a.column) else rel.fields[0]
            out.append((n, fresh()))
            expressions.append(aggregate(a, of, order, kinds, self.options.truncate_avg).alias(out[-1][1]))
        df, keys = rel.df, ([by.physical] if by else []) + list(rel.domain.values())
        if by and not node.hashed and self.options.fragment_sorted_groups:
            island = fresh("g")
            window = Window.partitionBy(*rel.domain.values()).orderBy(*rel.ordering())
            changed = ~F.col(by.physical).eqNullSafe(F.lag(by.physical).over(window))
            df = df.withColumn(island, F.coalesce(changed.cast("int"), F.lit(1))).withColumn(island, F.sum(island).over(window))
            keys.append(island)
        df = df.groupBy(*keys).agg(*expressions) if keys else df.agg(*expressions)
        domain = rel.domain
        if not by and domain:
            # A global aggregate has a row for every outer value, also for those without any row below.
            values, domain = self._values(scope, domain)
            same = [F.col(domain[k]).eqNullSafe(F.col(rel.domain[k])) for k in domain]
            filled = [F.coalesce(p, F.lit(default(a.function))).alias(p) if default(a.function) is not None else F.col(p) for a, (_, p) in zip(node.aggregates, out, strict=True)]
            df = values.join(df, same, "left").select(*domain.values(), *filled)
        types = {f.name: type_name(f.dataType) for f in df.schema}
        fields = ([Field(by.name, by.physical, by.type)] if by else []) + [Field(n, p, types[p]) for n, p in out]
        order = ((keys[-1], True),) if by and not node.hashed and self.options.fragment_sorted_groups else ((by.physical, True),) if by else ()
        return Relation(df, (SourceFields(node.alias, tuple(fields)),), order, domain)

    def _same(self, node, rel: Relation, scope: Scope) -> Relation:
        return rel

    _materialize = _memoize = _scan = _same

    def _hashIndex(self, node, rel: Relation, scope: Scope) -> Relation:
        """An index for look-ups: a join builds its hash table on this side where Spark can, and a task can hold it."""
        return rel.with_(df=rel.df.hint("shuffle_hash")) if self._hashable(rel.df) else rel

    @staticmethod
    def _bytes(df: DataFrame) -> int:
        """Spark's estimate of a frame's size, very large where it has none; no job runs."""
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())

    def _hashable(self, df: DataFrame) -> bool:
        """Whether each partition of a shuffle is small enough for a hash table in memory; a sort-merge join spills."""
        return self._bytes(df) <= HASH_BYTES * int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    # Two inputs

    def _both(self, left: Relation, right: Relation, scope: Scope) -> tuple[Relation, Relation, DataFrame | None]:
        """Both sides carrying the same domain."""
        ids = list(dict.fromkeys([*left.domain, *right.domain]))
        return self._carry(left, ids, scope), self._carry(right, ids, scope), ids

    def _join(self, query: Query, scope: Scope) -> Relation:
        node = query.node
        cross = isinstance(node, m.CrossNode)
        kind, on = ("INNER", ()) if cross else (node.type, node.on)
        loops = cross or node.algorithm == "NESTED_LOOP"
        provider_is_right = loops and kind == "RIGHT"
        correlates = loops and kind in ("INNER", "LEFT", "LEFT_SEMI", "LEFT_ANTI", "RIGHT")
        first, second = query.inputs[::-1] if provider_is_right else query.inputs
        provider = self.compile(first, scope)
        if correlates:
            provider, receiver, predicate, pairs = self._receive(provider, second, scope, kind)
        else:
            receiver, predicate, pairs = self.compile(second, scope).renamed(), None, []
        matched = [c for _, c in pairs]
        pairs = [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]
        terms = [(provider, receiver, *((t.right, t.left) if provider_is_right else (t.left, t.right))) for t in on]
        if not correlates and (provider.domain or receiver.domain):
            if kind == "INNER":
                pairs = self._pairs(provider, receiver)
            else:
                provider, receiver, _ = self._both(provider, receiver, scope)
                pairs = self._pairs(provider, receiver)
        equal = []
        for p, r, a, b in terms:
            x, y = p.need(a), r.need(b)
            if not conditions.comparable(x.type, y.type):
                raise PlanError(f"'{a}' is {x.type} and can't be joined with '{b}', which is {y.type}")
            equal.append(F.col(x.physical) == F.col(y.physical))
        if receiver.truth and not on and kind in ("LEFT_SEMI", "LEFT_ANTI"):
            receiver = receiver.with_(df=receiver.df.filter(F.col(receiver.columns[0])))
        if kind == "LEFT_SEMI" and receiver.domain:
            return self._semi_join(provider, receiver, equal + pairs, [r.need(b).physical for _, r, _, b in terms] + matched)
        tests = equal + pairs + ([predicate] if predicate is not None else [])
        hint = None if loops else "merge" if node.algorithm == "MERGE" else "shuffle_hash"
        return self._joined(provider, receiver, tests, kind if not provider_is_right else "LEFT", hint)

    @staticmethod
    def _semi_join(provider: Relation, receiver: Relation, tests: list[Column], used: list[str]) -> Relation:
        """A semi join whose receiver reads outer rows the provider doesn't carry: provider rows with the outer values
        for which there is a match."""
        found = receiver.df.select(*dict.fromkeys([*used, *receiver.domain.values()])).distinct()
        df = provider.df.join(found, tests) if tests else provider.df.crossJoin(found)
        return provider.with_(df=df.select(*provider.df.columns, *receiver.domain.values()), domain=provider.domain | receiver.domain, truth=False)

    def _receive(self, provider: Relation, query: Query, scope: Scope, kind: str):
        """The receiver for this provider: (provider, receiver, further predicate, tests on outer values).

        A trial tells which outer columns the receiver reads; receivers within a trial are only tried, too, so that a node
        is compiled as often as it has receivers around it, and not twice as often for each.
        """
        inner = Scope((*scope.providers, provider))
        trial = self.compile(query, inner)
        own = [k for k in inner.noted if k in provider.df.columns]
        up = [k for k in inner.noted if k not in own]
        scope.noted.update({k: inner.noted[k] for k in up})
        if scope.trial:
            return provider, trial.renamed().with_(domain={}), None, []
        if not inner.noted:
            return provider, self.compile(query).renamed(), None, []
        if not up and not provider.domain and (chain := self._filters_only(query, provider)) is not None:
            return provider, *chain, []
        if kind not in ("INNER", "LEFT_SEMI"):
            # Rows without a match count, and do so for each outer value.
            provider = self._carry(provider, up, scope)
        held = {k: k for k in own} | {k: provider.domain[k] for k in up if k in provider.domain}
        names = {k: fresh("d") for k in held}
        values = provider.df.select(*[F.col(c).alias(names[k]) for k, c in held.items()]).distinct()
        inner.domain = Domain([(values, names)] if names else [])
        rest = [k for k in up if k not in held]
        if rest:
            for df, ids in scope.domain.factors:
                mine = {k: ids[k] for k in rest if k in ids}
                if mine:
                    inner.domain.factors.append((df.select(*mine.values()).distinct(), mine))
        receiver = self.compile(query, inner).renamed()
        pairs = [(held[k], c) for k, c in receiver.domain.items() if k in held]
        return provider, receiver.with_(domain={k: c for k, c in receiver.domain.items() if k not in held}), None, pairs

    def _filters_only(self, query: Query, provider: Relation):
        """(receiver without its filters, their conjunction), if the receiver only filters and renames what reads no
        outer column."""
        chain, at = [], query
        while isinstance(at.node, NARROW):
            chain.append(at.node)
            at = at.inputs[0]
        probe = Scope((provider,))
        if self.compile(at, probe).truth or probe.noted:
            return None
        base = self.compile(at).renamed()
        predicate = None
        for node in reversed(chain):
            if isinstance(node, m.FilterNode):

                def resolve(reference: str, base=base):
                    found = base.find(reference) or provider.find(reference) or base.need(reference)
                    return F.col(found.physical), found.type

                one = conditions.to_column(node.condition, resolve)
                predicate = one if predicate is None else predicate & one
            else:
                base = getattr(self, "_" + node.kind)(node, base, scope=probe)
        return base, predicate

    def _joined(self, left: Relation, right: Relation, tests: list[Column], kind: str, hint: str | None) -> Relation:
        a, b = left.df, right.df
        if tests and (hint == "merge" or hint and self._hashable(b)):
            b = b.hint(hint)
        how = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "LEFT_SEMI": "left_semi", "LEFT_ANTI": "left_anti", "RIGHT_SEMI": "left_semi", "RIGHT_ANTI": "left_anti"}[kind]
        kept = {"LEFT_SEMI": left, "LEFT_ANTI": left, "RIGHT_SEMI": right, "RIGHT_ANTI": right}.get(kind)
        if kept is right:
            a, b = b, a
        # Without an equality among the tests, Spark compares each row with each of the other side: what a theta join asks.
        if tests:
            df = a.join(b, tests, how)
        elif kept is not None or kind != "INNER":
            df = a.join(b.limit(1) if kept is not None else b, F.lit(True), how)
        else:
            df = a.crossJoin(b)
        if kept is not None:
            return kept.with_(df=df, truth=False)
        domain = right.domain | left.domain
        if kind in ("RIGHT", "FULL") and left.domain:
            # Outer values stand on the side that has the row.
            whole = {k: fresh("d") for k in left.domain}
            df = df.withColumns({n: F.coalesce(F.col(left.domain[k]), F.col(right.domain[k])) for k, n in whole.items()})
            domain = right.domain | whole
        order = (*right.order, *left.order) if kind == "RIGHT" else (*left.order, *right.order)
        return Relation(df, (*left.sources, *right.sources), order, domain)

    def _setOp(self, node: m.SetOpNode, left: Relation, right: Relation, scope: Scope) -> Relation:
        if len(left.fields) != len(right.fields):
            raise PlanError(f"the inputs of {node.kind_} have {len(left.fields)} and {len(right.fields)} columns")
        left, right, ids = self._both(left, right.renamed(), scope)
        aligned = {r.physical: l.physical for l, r in zip(left.fields, right.fields, strict=True)}
        for l, r in zip(left.fields, right.fields, strict=True):
            if not conditions.comparable(l.type, r.type):
                raise PlanError(f"'{l.name}' is {l.type} and can't be aligned with '{r.name}', which is {r.type}")
        same = [F.col(l).eqNullSafe(F.col(r)) for r, l in aligned.items()] + self._pairs(left, right)
        if node.kind_ in ("INTERSECT", "EXCEPT"):
            df = left.df.join(right.df, same, "left_semi" if node.kind_ == "INTERSECT" else "left_anti")
            return left.with_(df=df, truth=False)
        name = node.alias or (left.sources[0].alias if len(left.sources) == 1 else "Append" if node.kind_ == "APPEND" else "HashUnion" if node.hashed else "Union")
        more = right.df
        if node.kind_ == "UNION" and node.hashed and self.options.bag_union:
            more = right.df.join(left.df.select(*left.columns, *left.domain.values()), same, "left_anti")
        keep_order = node.kind_ == "APPEND" or (node.kind_ == "UNION" and node.hashed and self.options.bag_union)
        new, domain = [fresh() for _ in left.fields], {k: fresh("d") for k in ids}
        side, padding = fresh("o"), [(fresh("o"), rel, c) for rel in (left, right) for c, _ in rel.order] if keep_order else []

        def half(rel: Relation, df: DataFrame, number: int) -> DataFrame:
            columns = [F.col(f.physical).alias(n) for f, n in zip(rel.fields, new, strict=True)] + [F.col(rel.domain[k]).alias(n) for k, n in domain.items()]
            if not keep_order:
                return df.select(*columns)
            kinds = {(id(r), c): t for r in (left, right) for c, t in r.df.dtypes}
            pads = [(F.col(c) if r is rel else F.lit(None).cast(kinds[id(r), c])).alias(n) for n, r, c in padding]
            return df.select(*columns, F.lit(number).alias(side), *pads)

        df = half(left, left.df, 0).union(half(right, more, 1))
        directions = dict(left.order) | dict(right.order)
        order = ((side, True), *((n, directions[c]) for n, _, c in padding)) if keep_order else ()
        df = df if keep_order else df.distinct()
        types = {f.name: type_name(f.dataType) for f in df.schema}
        fields = tuple(Field(f.name, n, types[n], f.primary_key and node.kind_ != "APPEND") for f, n in zip(left.fields, new, strict=True))
        return Relation(df, (SourceFields(name, fields),), order, domain)

    def _exists(self, node: m.ExistsNode, left: Relation, right: Relation, scope: Scope) -> Relation:
        one = m.LimitNode(1)
        left, right, _ = self._both(left, right.renamed(), scope)
        left, right = self._limit(one, left, scope), self._limit(one, right, scope)
        pairs = self._pairs(left, right)
        if node.bilateral:
            df = left.df.join(right.df, pairs) if pairs else left.df.crossJoin(right.df)
            return Relation(df, (*left.sources, *right.sources), (), left.domain)
        lone = right.df.join(left.df, pairs if pairs else F.lit(True), "left_anti")
        if left.domain:
            lone = lone.withColumnsRenamed({right.domain[k]: left.domain[k] for k in left.domain})
        df = left.df.select(*left.columns, *left.domain.values()).unionByName(lone.select(*right.columns, *left.domain.values()), allowMissingColumns=True)
        return Relation(df, (*left.sources, *right.sources), (), left.domain)

    def _logicalOp(self, node: m.LogicalOpNode, left: Relation, right: Relation, scope: Scope) -> Relation:
        right = right.renamed()
        ids = list(dict.fromkeys([*left.domain, *right.domain]))
        base = self._one_row(ids, scope)
        sides = []
        for rel in (left, right):
            value, there = fresh(), fresh()
            single = len(rel.fields) == 1 and rel.fields[0].type == "BOOLEAN"
            holds = F.coalesce(F.first(F.col(rel.columns[0])), F.lit(False)) if single else F.lit(True)
            keys = [F.col(c) for c in rel.domain.values()]
            cols = [(F.count(F.lit(1)) > 0).alias(there), holds.alias(value)]
            found = rel.df.groupBy(*keys).agg(*cols) if keys else rel.df.agg(*cols)
            pairs = [F.col(base.domain[k]).eqNullSafe(F.col(c)) for k, c in rel.domain.items()]
            base = base.with_(df=base.df.join(found, pairs, "left") if pairs else base.df.crossJoin(found))
            empty = F.lit(node.kind_ == "XOR" and self.options.xor_empty_is_true)
            sides.append(F.when(F.coalesce(F.col(there), F.lit(False)), F.coalesce(F.col(value), F.lit(False))).otherwise(empty))
        a, b = sides
        truth = {"AND": a & b, "OR": a | b, "XOR": a != b}[node.kind_]
        name = fresh()
        source = SourceFields(node.alias, (Field("EVAL", name, "BOOLEAN"),))
        return Relation(base.df.select(truth.alias(name), *base.domain.values()), (source,), (), base.domain, truth=True)
