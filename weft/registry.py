"""Queries over the star-schema tables, one or more for each operator, with the SQL that says the same.

Each query is a graph: tables wired into operators, compiled by :mod:`weft.operators.compiler`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.operators.compiler import Compiler, Options
from weft.plans import model as m
from weft.plans.graph import Query

# A small notation for queries.

KEYS = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",),
    "orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
}


class Tables:
    """The tables of a directory as sources: ``t.nation("n")``."""

    def __init__(self, directory: str):
        self.directory = directory

    def __getattr__(self, name: str) -> Callable[[str], Query]:
        return lambda alias: table(m.ParquetTable(name, f"{self.directory}/{name}.parquet", KEYS[name]), alias)


def table(spec: m.Table, alias: str) -> Query:
    return Query(m.TableNode(0, alias), (), spec)


def op(node: m.Node, *inputs: Query) -> Query:
    return Query(node, inputs)


def value(x) -> m.Literal:
    return m.Literal({bool: "bool", int: "int", float: "double", str: "str"}[type(x)], x)


def cmp(left: str, sign: str, right) -> m.Comparison:
    names = {"=": "EQ", "!=": "NEQ", ">": "GT", ">=": "GTE", "<": "LT", "<=": "LTE"}
    return m.Comparison(left, names[sign], right if isinstance(right, m.Ref) else value(right))


def ref(column: str) -> m.Ref:
    return m.Ref(column)


def where(q: Query, *conditions: m.Condition) -> Query:
    return op(m.FilterNode(conditions[0] if len(conditions) == 1 else m.And(conditions)), q)


def project(q: Query, *columns: str) -> Query:
    return op(m.ProjectNode(columns), q)


def join(kind: str, algorithm: str, left: Query, right: Query, *terms: tuple[str, str]) -> Query:
    return op(m.JoinNode(kind, algorithm, tuple(m.JoinTerm(*t) for t in terms)), left, right)


def sort(q: Query, *columns: str, up: bool = True) -> Query:
    return op(m.SortNode(tuple(m.SortKey(c, up) for c in columns)), q)


def group(q: Query, by: str | None, *aggregates: tuple[str, str], alias: str = "a", hashed: bool = True) -> Query:
    return op(m.AggNode(alias, by, tuple(m.Aggregate(*a) for a in aggregates), hashed), q)


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def add(name: str, build: Callable[[Tables], Query], sql: str | None = None, rounded: int | None = None, options: Options = Options()) -> None:
    """Register a query given as a graph; doubles are rounded where sums may differ in their last bits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Compiler(spark, options).compile(build(Tables(sf_dir))).output()
        if rounded is not None:
            df = df.select(*[F.round(F.col(f"`{c}`"), rounded).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])
        return df

    QUERIES[name] = run, sql


add(
    "flagship_revenue",
    lambda t: op(
        m.LimitNode(3),
        sort(group(where(join("INNER", "HASH", t.lineitem("l"), t.orders("o"), ("l.l_orderkey", "o.o_orderkey")), cmp("o.o_totalprice", ">", 1000.0)), "o.o_orderpriority", ("SUM", "l.l_quantity"), ("COUNT_ALL", "l.l_orderkey")), "a.o_orderpriority"),
    ),
    """SELECT o_orderpriority, sum(l_quantity) AS SUM_l_quantity, count(*) AS COUNT_ALL_l_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY 1 LIMIT 3""",
)
add("table_scan", lambda t: t.nation("n"), "SELECT * FROM nation")
add("filter_cmp", lambda t: where(t.lineitem("l"), cmp("l.l_quantity", ">=", 45.0), cmp("l.l_linenumber", "<", 3), cmp("l.l_returnflag", "!=", "A")), "SELECT * FROM lineitem WHERE l_quantity >= 45 AND l_linenumber < 3 AND l_returnflag <> 'A'")
add(
    "filter_and_or",
    lambda t: op(m.FilterNode(m.Or((cmp("o.o_orderstatus", "=", "F"), m.And((cmp("o.o_totalprice", "<=", 2000.0), cmp("o_orderpriority", "=", "1-URGENT")))))), t.orders("o")),
    "SELECT * FROM orders WHERE o_orderstatus = 'F' OR (o_totalprice <= 2000 AND o_orderpriority = '1-URGENT')",
)
add("filter_is_null", lambda t: op(m.FilterNode(m.IsNull("e.props")), t.events("e")), "SELECT * FROM events WHERE props IS NULL")
add("filter_is_not_null", lambda t: op(m.FilterNode(m.IsNotNull("e.props")), t.events("e")), "SELECT * FROM events WHERE props IS NOT NULL")
add("filter_column_column", lambda t: where(t.lineitem("l"), cmp("l.l_discount", ">", ref("l.l_tax"))), "SELECT * FROM lineitem WHERE l_discount > l_tax")
add("project", lambda t: project(t.customer("c"), "c.c_mktsegment", "c.c_name"), "SELECT c_mktsegment, c_name FROM customer")
add("drop_columns", lambda t: op(m.RemoveColumnsNode(("c.c_name", "c.c_acctbal"), "P"), t.customer("c")), "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
add("rename_source", lambda t: sort(op(m.AliasNode("c", "x"), t.customer("c")), "x.c_acctbal"), "SELECT * FROM customer")
add("rename_column", lambda t: op(m.AliasNode("r.r_name", "r.name"), t.region("r")), "SELECT r_regionkey, r_name AS name FROM region")
add(
    "collapse",
    lambda t: project(op(m.CollapseNode("all"), op(m.CrossNode(), t.region("r"), t.nation("n"))), "all.r_name", "all.n_name"),
    "SELECT r_name, n_name FROM region CROSS JOIN nation",
)
add("sort_limit_offset", lambda t: op(m.LimitNode(20, 5), sort(t.orders("o"), "o.o_totalprice", "o.o_orderkey", up=False)), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20 OFFSET 5")
for hashed in (True, False):
    add(f"distinct_{'hash' if hashed else 'sorted'}", lambda t, h=hashed: op(m.DistinctNode(h), sort(project(t.orders("o"), "o.o_orderpriority"), "o.o_orderpriority")), "SELECT DISTINCT o_orderpriority FROM orders")
    add(
        f"agg_{'hash' if hashed else 'sorted'}",
        lambda t, h=hashed: group(sort(t.lineitem("l"), "l.l_returnflag"), "l.l_returnflag", ("MAX", "l.l_quantity"), ("MIN", "l.l_linenumber"), ("COUNT", "l.l_tax"), ("AVG", "l.l_quantity"), ("SUM", "l.l_extendedprice"), hashed=h),
        """SELECT l_returnflag, max(l_quantity) AS MAX_l_quantity, min(l_linenumber) AS MIN_l_linenumber, count(l_tax) AS COUNT_l_tax, round(avg(l_quantity), 2) AS AVG_l_quantity,
        round(sum(l_extendedprice), 2) AS SUM_l_extendedprice FROM lineitem GROUP BY 1""",
        rounded=2,
    )
add(
    "agg_counts",
    lambda t: group(t.events("e"), "e.event_type", ("COUNT_ALL", "e.event_id"), ("COUNT_NULL", "e.props"), ("COUNT", "e.props")),
    "SELECT event_type, count(*) AS COUNT_ALL_event_id, count(*) - count(props) AS COUNT_NULL_props, count(props) AS COUNT_props FROM events GROUP BY 1",
)
add(
    "agg_first_last",
    lambda t: group(t.events("e"), "e.event_type", ("FIRST", "e.value"), ("LAST", "e.user_id")),
    "SELECT event_type, arg_min(value, event_id) AS FIRST_value, arg_max(user_id, event_id) AS LAST_user_id FROM events GROUP BY 1",
)
add("agg_global", lambda t: group(t.orders("o"), None, ("COUNT_ALL", "o.o_orderkey"), ("MAX", "o.o_totalprice"), ("MIN", "o.o_custkey")), "SELECT count(*) AS COUNT_ALL_o_orderkey, max(o_totalprice) AS MAX_o_totalprice, min(o_custkey) AS MIN_o_custkey FROM orders")
add("agg_over_nothing", lambda t: group(where(t.orders("o"), cmp("o.o_orderkey", "<", -5)), None, ("COUNT", "o.o_orderkey"), ("SUM", "o.o_totalprice")), "SELECT 0::BIGINT AS COUNT_o_orderkey, NULL::DOUBLE AS SUM_o_totalprice")
add(
    "agg_runs",
    lambda t: project(group(t.events("e"), "e.event_type", ("COUNT_ALL", "e.event_id"), hashed=False), "a.event_type", "a.COUNT_ALL_event_id"),
    """SELECT event_type, count(*) AS COUNT_ALL_event_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM events)
    GROUP BY event_type, run""",
    options=Options(fragment_sorted_groups=True),
)
add(
    "agg_truncated_average",
    lambda t: group(t.lineitem("l"), "l.l_linestatus", ("AVG", "l.l_linenumber")),
    "SELECT l_linestatus, (sum(l_linenumber) // count(*))::DOUBLE AS AVG_l_linenumber FROM lineitem GROUP BY 1",
    options=Options(truncate_avg=True),
)

# Joins of the whole tables, and of parts by columns that are no ids, which leave unmatched rows on both sides.
for label, left, right, conditions in (
    ("", "customer c", "orders o", ((), ())),
    ("unmatched_", "(SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c", "(SELECT * FROM orders WHERE o_orderstatus = 'F') o", ((cmp("c.c_mktsegment", "!=", "BUILDING"),), (cmp("o.o_orderstatus", "=", "F"),))),
):
    meets = "c_custkey = o_custkey"
    joins = {k: f"SELECT c.*, o.* FROM {left} {k} JOIN {right} ON {meets}" for k in ("INNER", "LEFT", "RIGHT", "FULL")}
    for word, how in (("", "SEMI"), ("NOT ", "ANTI")):
        joins[f"LEFT_{how}"] = f"SELECT * FROM {left} WHERE {word}EXISTS (SELECT 1 FROM {right} WHERE {meets})"
        joins[f"RIGHT_{how}"] = f"SELECT * FROM {right} WHERE {word}EXISTS (SELECT 1 FROM {left} WHERE {meets})"
    for kind, sql in joins.items():
        for algorithm in m.ALGORITHMS:
            add(
                f"join_{label}{kind.lower()}_{algorithm.lower()}",
                lambda t, k=kind, a=algorithm, c=conditions: join(k, a, *[where(q, *only) if only else q for q, only in zip((t.customer("c"), t.orders("o")), c, strict=True)], ("c.c_custkey", "o.o_custkey")),
                sql,
            )
add(
    "join_two_terms",
    lambda t: join("INNER", "HASH", project(t.customer("c"), "c.c_custkey", "c.c_nationkey"), t.supplier("s"), ("c.c_nationkey", "s.s_nationkey"), ("c.c_custkey", "s.s_suppkey")),
    "SELECT c_custkey, c_nationkey, supplier.* FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey",
)
add(
    "join_itself",
    lambda t: join("INNER", "HASH", t.nation("a"), t.nation("b"), ("a.n_regionkey", "b.n_regionkey")),
    """SELECT a.n_nationkey AS "a.n_nationkey", a.n_name AS "a.n_name", a.n_regionkey AS "a.n_regionkey", b.n_nationkey AS "b.n_nationkey", b.n_name AS "b.n_name", b.n_regionkey AS "b.n_regionkey"
    FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""",
)
add("cross", lambda t: op(m.CrossNode(), t.region("r"), t.nation("n")), "SELECT * FROM region CROSS JOIN nation")

# Set operations over whole columns with repeated values; every user_id is some o_custkey, not the other way round.
keys, users = "(SELECT o_custkey FROM orders)", "(SELECT user_id FROM events)"
own = lambda t: project(t.orders("o"), "o.o_custkey")
user = lambda t: project(t.events("e"), "e.user_id")
for hashed in (True, False):
    name = "hash" if hashed else "sorted"
    add(f"set_union_{name}", lambda t, h=hashed, l=user, r=own: op(m.SetOpNode("UNION", h, "u"), l(t), r(t)), f"{users} UNION {keys}")
    for kind, word in (("INTERSECT", "IN"), ("EXCEPT", "NOT IN")):
        add(f"set_{kind.lower()}_{name}", lambda t, h=hashed, k=kind, l=own, r=user: op(m.SetOpNode(k, h), l(t), r(t)), f"SELECT * FROM {keys} WHERE o_custkey {word} {users}")
add("set_append", lambda t, l=user, r=own: op(m.SetOpNode("APPEND", False, "u"), l(t), r(t)), f"{users} UNION ALL {keys}")
add(
    "set_union_bag",
    lambda t, l=user, r=own: op(m.SetOpNode("UNION", True, "u"), l(t), r(t)),
    f"{users} UNION ALL SELECT * FROM {keys} WHERE o_custkey NOT IN {users}",
    options=Options(bag_union=True),
)
add("exists_unilateral", lambda t: op(m.ExistsNode(False), sort(t.region("r"), "r.r_name"), t.nation("n")), "SELECT *, NULL::INTEGER AS n_nationkey, NULL::VARCHAR AS n_name, NULL::INTEGER AS n_regionkey FROM (SELECT * FROM region ORDER BY r_name LIMIT 1)")
add("exists_bilateral", lambda t: op(m.ExistsNode(True), sort(t.region("r"), "r.r_name"), sort(t.nation("n"), "n.n_nationkey", up=False)), "SELECT * FROM (SELECT * FROM region ORDER BY r_name LIMIT 1) CROSS JOIN (SELECT * FROM nation ORDER BY n_nationkey DESC LIMIT 1)")
for kind, sign in (("AND", "AND"), ("OR", "OR"), ("XOR", "<>")):
    add(
        f"logical_{kind.lower()}",
        lambda t, k=kind: op(m.LogicalOpNode(k), where(t.nation("n"), cmp("n.n_nationkey", "<", 0)), where(t.region("r"), cmp("r.r_regionkey", ">", 1))),
        f'SELECT (EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 0) {sign} EXISTS (SELECT 1 FROM region WHERE r_regionkey > 1)) AS "EVAL"',
    )

# Correlation: the left side's rows are read on the right.

add("semi_correlated", lambda t: join("LEFT_SEMI", "NESTED_LOOP", t.customer("c"), where(t.orders("o"), cmp("o.o_custkey", "=", ref("c.c_custkey")), cmp("o.o_totalprice", ">", 4000.0))), "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 4000)")
add("anti_correlated", lambda t: join("LEFT_ANTI", "NESTED_LOOP", t.customer("c"), where(t.orders("o"), cmp("o.o_custkey", "=", ref("c.c_custkey")))), "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
add("semi_theta", lambda t: join("LEFT_SEMI", "NESTED_LOOP", t.customer("c"), where(t.orders("o"), cmp("o.o_custkey", "=", ref("c.c_custkey")), cmp("o.o_totalprice", "<", ref("c.c_acctbal")))), "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice < c_acctbal)")
add("lateral_inner", lambda t: op(m.CrossNode(), t.region("r"), where(t.nation("n"), cmp("n.n_regionkey", "=", ref("r.r_regionkey")))), "SELECT * FROM region JOIN nation ON n_regionkey = r_regionkey")
add("lateral_left", lambda t: join("LEFT", "NESTED_LOOP", t.region("r"), where(t.nation("n"), cmp("n.n_regionkey", "=", ref("r.r_regionkey")), cmp("n.n_name", "<", "NATION_2"))), "SELECT * FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name < 'NATION_2'")
add("lateral_right", lambda t: join("RIGHT", "NESTED_LOOP", where(t.nation("n"), cmp("n.n_regionkey", "=", ref("r.r_regionkey")), cmp("n.n_name", "<", "NATION_2")), t.region("r")), "SELECT region.*, nation.* FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name < 'NATION_2'")
add(
    "lateral_count",
    lambda t: op(m.CrossNode(), t.customer("c"), group(where(t.orders("o"), cmp("o.o_custkey", "=", ref("c.c_custkey"))), None, ("COUNT", "o.o_orderkey"), ("MAX", "o.o_totalprice"))),
    "SELECT customer.*, coalesce(n, 0) AS COUNT_o_orderkey, x AS MAX_o_totalprice FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS x FROM orders GROUP BY 1) ON o_custkey = c_custkey",
)
add(
    "lateral_top",
    lambda t: op(m.CrossNode(), project(t.customer("c"), "c.c_custkey"), op(m.LimitNode(2), sort(where(t.orders("o"), cmp("o.o_custkey", "=", ref("c.c_custkey"))), "o.o_totalprice", "o.o_orderkey", up=False))),
    "SELECT c_custkey, o.* FROM customer JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) <= 2) o ON o_custkey = c_custkey",
)
add(
    "lateral_theta_count",
    lambda t: op(m.CrossNode(), t.nation("n"), group(where(t.nation("k"), cmp("k.n_nationkey", "<", ref("n.n_nationkey")), cmp("k.n_regionkey", "=", ref("n.n_regionkey"))), None, ("COUNT_ALL", "k.n_name"))),
    "SELECT n.*, (SELECT count(*) FROM nation k WHERE k.n_nationkey < n.n_nationkey AND k.n_regionkey = n.n_regionkey) AS COUNT_ALL_n_name FROM nation n",
)
add(
    "lateral_distinct_union",
    lambda t: op(
        m.CrossNode(),
        t.region("r"),
        op(m.SetOpNode("UNION", True, "u"), project(where(t.nation("n"), cmp("n.n_regionkey", "=", ref("r.r_regionkey"))), "n.n_name"), project(where(t.nation("k"), cmp("k.n_nationkey", "=", ref("r.r_regionkey"))), "k.n_name")),
    ),
    "SELECT r.*, n_name FROM region r, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey UNION SELECT n_name FROM nation WHERE n_nationkey = r_regionkey)",
)
add(
    "semi_or_condition",
    lambda t: join("LEFT_SEMI", "NESTED_LOOP", t.customer("c"), op(m.LogicalOpNode("OR"), op(m.ConditionNode(cmp("c.c_acctbal", ">", 9000.0))), where(t.orders("o"), cmp("o.o_custkey", "=", ref("c.c_custkey")), cmp("o.o_orderstatus", "=", "P")))),
    "SELECT * FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
)
add("condition", lambda t: join("LEFT_SEMI", "NESTED_LOOP", t.nation("n"), op(m.ConditionNode(m.Or((cmp("n.n_regionkey", "=", 1), cmp("n.n_nationkey", ">", 20)))))), "SELECT * FROM nation WHERE n_regionkey = 1 OR n_nationkey > 20")
add(
    "two_level_correlation",
    lambda t: join(
        "LEFT_SEMI", "NESTED_LOOP", t.customer("c"),
        join("LEFT_SEMI", "NESTED_LOOP", t.orders("o"), where(t.lineitem("l"), cmp("l.l_orderkey", "=", ref("o.o_orderkey")), cmp("l.l_suppkey", "=", ref("c.c_custkey")))),
    ),
    "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = c_custkey)",
)
add(
    "two_level_anti",
    lambda t: join(
        "LEFT_ANTI", "NESTED_LOOP", t.customer("c"),
        join("LEFT_SEMI", "NESTED_LOOP", t.orders("o"), where(t.lineitem("l"), cmp("l.l_orderkey", "=", ref("o.o_orderkey")), cmp("l.l_suppkey", "=", ref("c.c_custkey")))),
    ),
    "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = c_custkey)",
)
add(
    "two_level_left",
    lambda t: join(
        "LEFT", "NESTED_LOOP", t.region("r"),
        join("LEFT", "NESTED_LOOP", where(t.nation("n"), cmp("n.n_regionkey", "=", ref("r.r_regionkey"))), where(t.supplier("s"), cmp("s.s_nationkey", "=", ref("n.n_nationkey")), cmp("s.s_suppkey", ">", ref("r.r_regionkey")))),
    ),
    "SELECT r.*, n.*, s.* FROM region r LEFT JOIN nation n ON n_regionkey = r_regionkey LEFT JOIN supplier s ON s_nationkey = n_nationkey AND s_suppkey > r_regionkey",
)
add("reference", lambda t: op(m.CrossNode(), t.nation("n"), op(m.ReferenceNode(("n.n_regionkey", "n.n_name")))), "SELECT *, n_regionkey AS n_n_regionkey, n_name AS n_n_name FROM nation")

add(
    "explode",
    lambda t: project(op(m.ExplodeNode("o.o_orderpriority", "-"), t.orders("o")), "o.o_orderkey", "o.o_orderpriority"),
    "SELECT o_orderkey, trim(unnest(string_split(o_orderpriority, '-'))) AS o_orderpriority FROM orders",
)
add("row_number", lambda t: op(m.RowNumberNode("i", "place", 5), sort(t.nation("n"), "n.n_name", up=False)), "SELECT (row_number() OVER (ORDER BY n_name DESC) + 4)::INTEGER AS place, * FROM nation")
add(
    "row_number_partitioned",
    lambda t: op(m.RowNumberNode("i", "place"), sort(project(t.orders("o"), "o.o_orderkey", "o.o_totalprice"), "o.o_totalprice", "o.o_orderkey")),
    "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey)::INTEGER AS place, o_orderkey, o_totalprice FROM orders",
    options=Options(partitioned_row_numbers=True),
)
for name, node in (("materialize", m.MaterializeNode()), ("memoize", m.MemoizeNode()), ("hash_index", m.HashIndexNode()), ("scan_barrier", m.ScanNode())):
    add(
        name,
        lambda t, n=node: join("INNER", "NESTED_LOOP", t.nation("n"), op(n, where(t.supplier("s"), cmp("s.s_acctbal", ">", 0.0))), ("n.n_nationkey", "s.s_nationkey")),
        "SELECT * FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 0",
    )


# Files: written to the shared folder first, then read as the source under test.


def _folder(spark: SparkSession) -> str:
    from weft.sources.shared import shared_folder

    return f"{shared_folder(spark)}/weft-{uuid.uuid4().hex}"


def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lines = nation.select(F.concat_ws(";", F.concat(F.lit('"'), "n_name", F.lit('"')), "n_nationkey", "n_regionkey").alias("value"))
    head = spark.createDataFrame([("notes before the header",), ("N_NAME;key;region",)], "value string")
    head.coalesce(1).union(lines).coalesce(1).write.text(folder)
    spec = m.CsvTable("nation", folder, (m.Column("key", "INT", True, False), m.Column("n_name", "STRING"), m.Column("region", "INT")), ";", '"', 2)
    return Compiler(spark).compile(where(table(spec, "n"), cmp("n.region", ">", 0))).output()


def csv_folder_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one folder, each with notes and a header, in the other order of their names than of their rows; empty values."""
    folder = _folder(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.when(F.col("props").isNotNull(), F.col("value")).alias("value"))
    lines = events.select("event_type", F.concat_ws(",", "event_id", F.concat(F.lit('"'), "event_type", F.lit('"')), F.coalesce(F.col("value").cast("string"), F.lit(" "))).alias("value"))
    head = spark.createDataFrame([("notes",), ("Id,kind,amount",)], "value string").coalesce(1)
    for k, only in enumerate((F.col("event_type") == "view", F.col("event_type") != "view")):
        head.union(lines.filter(only).select("value")).coalesce(1).write.mode("append").text(f"{folder}/k={k}")
    spec = m.CsvTable("events", f"{folder}/k=*", (m.Column("id", "LONG"), m.Column("kind", "STRING"), m.Column("amount", "DOUBLE")), ",", '"', 2)
    return Compiler(spark).compile(table(spec, "e")).output()


def csv_sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat_ws(",", "n_nationkey", F.when(F.col("n_regionkey") > 1, F.col("n_regionkey").cast("string")).otherwise(F.lit("null")), F.when(F.col("n_regionkey") > 2, F.col("n_name")).otherwise(F.lit(""))).alias("value"))
    spark.createDataFrame([("key,region,name",)], "value string").coalesce(1).union(rows).coalesce(1).write.text(folder)
    spec = m.CsvTable("nation", folder, (m.Column("key", "INT", True, False), m.Column("region", "DOUBLE"), m.Column("name", "STRING")))
    return Compiler(spark, Options(csv_nulls="sentinel")).compile(table(spec, "n")).output()


def xml_separate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'P'")
    record = F.concat(F.lit('<order id="'), "o_orderkey", F.lit('"><word>'), F.array_join(F.split("o_orderpriority", "-"), "</word><word>"), F.lit("</word></order>"))
    body = spark.createDataFrame([(0, "<orders>"), (2, "</orders>")], "k int, value string").union(orders.select(F.lit(1), record))
    body.orderBy("k").coalesce(1).select("value").write.text(folder)
    spec = m.XmlTable("words", folder, (m.Column("parent_id", "STRING"), m.Column("value", "STRING")), None, "SEPARATE_TABLE:order:word")
    return Compiler(spark).compile(table(spec, "w")).output()


def xml_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()
    body = "".join(f'<nation key="{r.n_nationkey}"><name>{r.n_name}</name><in><region>{r.n_regionkey}</region></in></nation>\n' for r in rows)
    spark.createDataFrame([(f"<nations>\n{body}</nations>",)], "value string").coalesce(1).write.text(folder)
    spec = m.XmlTable("nation", folder, (m.Column("@key", "INT"), m.Column("name", "STRING"), m.Column("in.region", "INT")))
    return Compiler(spark).compile(where(table(spec, "n"), cmp("n.in.region", ">", 0))).output().toDF("key", "n_name", "region")


def btree_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weft.sources.tables import write_btree

    folder = _folder(spark)
    write_btree(spark.read.parquet(f"{sf_dir}/orders.parquet"), folder, ["o_orderkey"])
    return Compiler(spark).compile(where(table(m.BTreeTable("orders", folder), "o"), cmp("o.o_orderstatus", "=", "F"))).output()


def memory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tuple((("id", m.Literal("int", i)), ("name", None if i == 2 else m.Literal("str", f"n{i}"))) for i in range(5))
    spec = m.MemoryTable("t", (m.Column("id", "INT", True, False), m.Column("name", "STRING")), rows)
    return Compiler(spark).compile(op(m.LimitNode(3, 1), table(spec, "t"))).output()


QUERIES |= {
    "csv_folder_source": (csv_folder_source, "SELECT event_id AS id, event_type AS kind, CASE WHEN props IS NOT NULL THEN value END AS amount FROM events"),
    "csv_sentinels": (csv_sentinels, "SELECT n_nationkey AS key, CASE WHEN n_regionkey > 1 THEN n_regionkey::DOUBLE ELSE 5e-324 END AS region, CASE WHEN n_regionkey > 2 THEN n_name ELSE '' END AS name FROM nation"),
    "xml_separate_table": (xml_separate_table, "SELECT o_orderkey::VARCHAR AS parent_id, unnest(string_split(o_orderpriority, '-')) AS value FROM orders WHERE o_orderstatus = 'P'"),
    "csv_source": (csv_source, "SELECT n_nationkey AS key, n_name, n_regionkey AS region FROM nation WHERE n_regionkey > 0"),
    "xml_source": (xml_source, "SELECT n_nationkey AS key, n_name, n_regionkey AS region FROM nation WHERE n_regionkey > 0"),
    "btree_source": (btree_source, "SELECT * FROM orders WHERE o_orderstatus = 'F'"),
    "memory_source": (memory_source, "SELECT * FROM (VALUES (1, 'n1'), (2, NULL), (3, 'n3')) t(id, name)"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_revenue"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
