"""What callers ask of a node: pages, streams, schemas, problems, comparisons."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from weft.errors import PlanError
from weft.operators.compiler import Compiler, Options
from weft.operators.relation import Relation
from weft.plans import graph as g
from weft.plans import model as m


@dataclass(frozen=True)
class SchemaColumn:
    source: str
    name: str
    type: str
    primary_key: bool


class Runner:
    """Runs the nodes of a session. Plans are kept by value, so that pages of one node share a plan."""

    KEPT, CURSORS = 256, 4

    def __init__(self, spark: SparkSession, options: Options = Options()):
        self.spark, self.options = spark, options
        self._plans: dict[g.Query, Relation] = {}
        self._cursors: dict[g.Query, tuple[int, Iterator[Row]]] = {}

    def relation(self, session: g.Session, node: int) -> Relation:
        query = g.plan(session, node)
        provider = self.outer_join(session, node)
        if query not in self._plans:
            try:
                compiled = Compiler(self.spark, self.options).compile(query)
            except PlanError as error:
                if provider is not None and "not found" in str(error):
                    raise PlanError(f"node #{node} reads rows that join #{provider} gives it; run #{provider} instead ({error})") from error
                raise
            while len(self._plans) >= self.KEPT:
                self._plans.pop(next(iter(self._plans)))
            self._plans[query] = compiled
        return self._plans[query]

    def frame(self, session: g.Session, node: int) -> DataFrame:
        """The rows, in no particular order, for further use in Spark."""
        return self.relation(session, node).output()

    def _ordered(self, session: g.Session, node: int) -> DataFrame:
        relation = self.relation(session, node)
        return relation.with_(df=relation.df.orderBy(*relation.ordering())).output()

    def page(self, session: g.Session, node: int, offset: int, limit: int) -> list[Row]:
        if offset < 0 or limit <= 0:
            raise ValueError("a page needs an offset of 0 or more and a positive limit")
        query = g.plan(session, node)
        frame = self._ordered(session, node)
        if not offset:
            return frame.limit(limit).collect()  # the first rows need no sort of all
        # A page that begins where the last one ended goes on from there; any other sorts anew.
        at, rows = self._cursors.pop(query, (None, None))
        if at != offset:
            rows = frame.offset(offset).toLocalIterator()
        page = list(itertools.islice(rows, limit))
        while len(self._cursors) >= self.CURSORS:
            self._cursors.pop(next(iter(self._cursors)))
        self._cursors[query] = (offset + len(page), rows)
        return page

    def stream(self, session: g.Session, node: int) -> Iterator[Row]:
        """All rows in order, a partition at a time on the driver."""
        yield from self._ordered(session, node).toLocalIterator(prefetchPartitions=True)

    def schema(self, session: g.Session, node: int) -> list[SchemaColumn]:
        relation = self.relation(session, node)
        return [SchemaColumn(s.alias, f.name, f.type, f.primary_key) for s in relation.sources for f in s.fields]

    def columns_for(self, session: g.Session, node: int) -> dict[str, list[str]]:
        """For each input of a node, the columns it may name: those of the input and those of outer joins."""
        outer = [f"{s.alias}.{f.name}" for join, side in outer_joins(session, node) for s in self._safe(session, session.input_of(join, side)) for f in s.fields]
        ports = session.nodes[node].ports or ("ONLY",)
        return {p: [f"{s.alias}.{f.name}" for s in self._safe(session, session.input_of(node, p)) for f in s.fields] + outer for p in ports}

    def _safe(self, session: g.Session, node: int | None):
        try:
            return self.relation(session, node).sources if node is not None else ()
        except (PlanError, ValueError):
            return ()

    def outer_join(self, session: g.Session, node: int) -> int | None:
        return next((join for join, _ in outer_joins(session, node)), None)

    def problems(self, session: g.Session) -> list[g.Problem]:
        """Missing inputs, sources named twice, and for each complete root what keeps it from being planned. No job runs."""
        missing = g.missing_inputs(session)
        out = missing + g.source_clashes(session)
        broken = {p.node for p in missing}
        for root in g.roots(session):
            if not broken & set(g.walk(session, root)):
                try:
                    self.relation(session, root)
                except Exception as error:
                    out.append(g.Problem(root, str(error).splitlines()[0]))
        return out

    def compare(self, session: g.Session, a: int, b: int, limit: int | None = None) -> list[dict]:
        """Two nodes, one run after the other: rows, whether that is all of them, time, and what Spark read and moved."""
        return [self._measure(session, node, limit) for node in (a, b)]

    def _measure(self, session: g.Session, node: int, limit: int | None) -> dict:
        frame = self.frame(session, node)
        seen = Observation()
        frame = (frame.limit(limit + 1) if limit is not None else frame).observe(seen, F.count(F.lit(1)).alias("rows"))
        began = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        elapsed = time.perf_counter() - began
        rows = seen.get["rows"]
        counted = {"rows": rows if limit is None else min(rows, limit), "exhausted": limit is None or rows <= limit, "elapsed_ms": round(1000 * elapsed, 1)}
        return {"node": node} | counted | plan_shape(frame)


def plan_shape(frame: DataFrame) -> dict:
    """What the plan is made of: joins by how they are done, exchanges, sorts and files read."""
    text = frame._jdf.queryExecution().executedPlan().toString()
    names = {"broadcast_joins": "BroadcastHashJoin", "hash_joins": "ShuffledHashJoin", "merge_joins": "SortMergeJoin", "loop_joins": "BroadcastNestedLoopJoin", "products": "CartesianProduct", "exchanges": "Exchange ", "sorts": "Sort [", "file_scans": "FileScan"}
    final = text.split("== Initial Plan ==")[0]
    return {k: final.count(v) for k, v in names.items()}


def outer_joins(session: g.Session, node: int) -> list[tuple[int, str]]:
    """(join, side that gives rows) for every join above whose receiving side the node is on, nearest first."""
    out, seen, pending = [], set(), [node]
    while pending:
        here = pending.pop(0)
        for e in session.edges:
            if e.from_ == here and e.to not in seen:
                seen.add(e.to)
                above = session.nodes[e.to]
                loops = isinstance(above, m.CrossNode) or (isinstance(above, m.JoinNode) and above.algorithm == "NESTED_LOOP")
                kind = getattr(above, "type", "INNER")
                if loops and kind in ("INNER", "LEFT", "LEFT_SEMI", "LEFT_ANTI", "RIGHT"):
                    gives = "RIGHT" if kind == "RIGHT" else "LEFT"
                    if e.port != gives:
                        out.append((e.to, gives))
                pending.append(e.to)
    return out


__all__ = ["Runner", "SchemaColumn", "outer_joins", "plan_shape"]
