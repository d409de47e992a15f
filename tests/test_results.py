"""Pages, streams, schemas, problems, comparisons and exports of nodes; files as sources; guesses about files."""

import csv
import io

import pytest

from tests.graphs import *  # noqa: F403
from tests.test_documents import build, session
from weft.errors import PlanError
from weft.sources import sniff, tables, xml_table
from weft.streaming import export
from weft.streaming.results import Runner, SchemaColumn, outer_joins


def test_pages_streams_and_schemas(spark):
    run, s = Runner(spark), session()
    assert [r["kind"] for r in run.page(s, 10, 1, 9)] == ["yawl", "sloop"] and run.page(s, 10, 3, 1) == []
    assert [r["t.miles"] for r in run.stream(s, 40)] == [310, 455] and run.frame(s, 30).columns == ["b.no", "b.kind", "b.berths", "t.no", "t.boat", "t.miles"]
    first = run.schema(s, 40)[:2]
    assert first == [SchemaColumn("b", "no", "INT", True), SchemaColumn("b", "kind", "STRING", False)]
    with pytest.raises(ValueError):
        run.page(s, 10, -1, 5)


def test_pages_go_on_where_the_last_one_ended(spark):
    n = 23
    s = build([g.AddTable(1, memory("t", [m.Column("k", "INT", True, False)], [(k,) for k in range(n)])), g.AddNode(1, m.TableNode(1, "t")), g.AddNode(2, m.SortNode((m.SortKey("t.k", False),))), g.Connect(g.Edge(1, 2))])
    run, want = Runner(spark), list(range(n))[::-1]
    read = lambda at, size: [r["k"] for r in run.page(s, 2, at, size)]
    assert [read(at, 5) for at in range(0, 30, 5)] == [want[at : at + 5] for at in range(0, 30, 5)]
    assert read(7, 4) == want[7:11] and read(11, 2) == want[11:13] and read(7, 2) == want[7:9] and read(9, 90) == want[9:]


def test_csv_folders(spark, tmp_path):
    """Files of a folder have a header each; rows follow the files' names, whatever Spark reads first."""
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "b.csv").write_text("# b\nid,name\n" + "".join(f"{k},b{k}\n" for k in range(500)))
    (tmp_path / "t" / "a.csv").write_text("# a\nid,name\n1,a1\n2,a2\n")
    spec = lambda path: m.CsvTable("t", str(path), (m.Column("id", "INT"), m.Column("name", "STRING")), ",", '"', 2)
    assert rows(spark, table(spec(tmp_path / "t"), "t")) == [(1, "a1"), (2, "a2"), *((k, f"b{k}") for k in range(500))]
    (tmp_path / "t" / "c.csv").write_text("# c\nname,id\nx,1\n")
    with pytest.raises(PlanError, match="different headers"):
        rows(spark, table(spec(tmp_path / "t"), "t"))


def test_problems(spark):
    s, find = session(), lambda s: [(p.node, p.message) for p in Runner(spark).problems(s)]
    assert find(s) == []
    ((node, message),) = find(g.apply(s, g.SetNode(40, m.FilterNode(cmp("t.knots", ">", 1)))))
    assert node == 40 and "not found" in message
    assert find(g.apply(s, g.Disconnect(g.Edge(20, 30, "RIGHT")))) == [(30, "input RIGHT is missing")]
    assert any(n == 20 and "named by node #10" in text for n, text in find(g.Session(s.tables, s.nodes | {20: m.TableNode(2, "b")}, s.edges, s.layout)))


def test_outer_columns_and_refusals(spark):
    s = g.apply(session(), g.Batch((g.Disconnect(g.Edge(20, 30, "RIGHT")), g.AddNode(50, m.FilterNode(cmp("t.miles", ">", ref("b.berths")))), g.Connect(g.Edge(20, 50)), g.Connect(g.Edge(50, 30, "RIGHT")))))
    run = Runner(spark)
    assert outer_joins(s, 50) == [(30, "LEFT")] and outer_joins(s, 10) == []
    assert run.columns_for(s, 50)["ONLY"] == ["t.no", "t.boat", "t.miles", "b.no", "b.kind", "b.berths"]
    assert sorted(r["t.miles"] for r in run.stream(s, 30)) == [12, 310, 455]
    with pytest.raises(PlanError, match="run #30"):
        run.page(s, 50, 0, 1)


def test_comparison(spark):
    a, b = Runner(spark).compare(session(), 30, 10)
    assert (a["rows"], b["rows"], a["exhausted"]) == (3, 3, True) and a["elapsed_ms"] > 0
    assert [x["rows"] for x in Runner(spark).compare(session(), 30, 10, limit=2)] == [2, 2] and not Runner(spark).compare(session(), 30, 10, limit=2)[0]["exhausted"]


#: Values with every character that CSV or SQL has to mark, and none.
CELLS = [(1, "plain", True, 1.5), (2, 'a "quoted", word', False, None), (3, "two\nlines; it's \\ here", None, -2.0), (4, None, True, 0.25), (5, "", None, None)]
SHAPE = [SchemaColumn("w", "no", "LONG", True), SchemaColumn("w", "say `so`", "STRING", False), SchemaColumn("w", "ok", "BOOLEAN", False), SchemaColumn("w", "x", "DOUBLE", False)]


def test_csv_export_reads_back():
    lines = list(export.export("csv", "w", SHAPE, CELLS))
    assert lines[0] == "no,say `so`,ok,x\r\n" and all(x.endswith("\r\n") for x in lines)
    read = list(csv.reader(io.StringIO("".join(lines), newline="")))[1:]
    assert read == [["" if x is None else str(x).lower() if isinstance(x, bool) else str(x) for x in row] for row in CELLS]
    assert export.text("CSV", "w", SHAPE[:1], [(None,), (3,)]) == "no\r\n\r\n3\r\n"
    with pytest.raises(ValueError, match="format"):
        export.export("xlsx", "w", SHAPE, CELLS)


def test_sql_export():
    create, *inserts = export.export("SQL", "w", SHAPE, CELLS)
    assert create == "CREATE TABLE IF NOT EXISTS `w` (\n    `no` BIGINT,\n    `say ``so``` TEXT,\n    `ok` BOOLEAN,\n    `x` DOUBLE,\n    PRIMARY KEY (`no`)\n);\n\n"
    values = ["(1, 'plain', TRUE, 1.5)", "(2, 'a \"quoted\", word', FALSE, NULL)", "(3, 'two\nlines; it\\'s \\\\ here', NULL, -2.0)", "(4, NULL, TRUE, 0.25)", "(5, '', NULL, NULL)"]
    assert inserts == [f"INSERT INTO `w` (`no`, `say ``so```, `ok`, `x`) VALUES {v};\n" for v in values]
    both = [SchemaColumn("w", "no", "INT", True), SchemaColumn("v", "no", "INT", True)]
    assert "PRIMARY KEY (`w.no`, `v.no`)" in export.text("sql", "t", both, []) and export.text("csv", "t", both, []) == "w.no,v.no\r\n"


def test_executors_write_the_same(spark, tmp_path):
    frame = spark.createDataFrame([r for r in CELLS if r[0] != 3], "a long, b string, c boolean, d double")
    export.write("CSV", "w", SHAPE, frame, f"{tmp_path}/csv")
    back = spark.read.csv(f"{tmp_path}/csv", header=True, quote='"', escape='"')
    assert back.columns == [c.name for c in SHAPE] and sorted(tuple(r) for r in back.collect())[1] == ("2", 'a "quoted", word', "false", None)
    export.write("SQL", "w", SHAPE, frame, f"{tmp_path}/sql")
    create, *inserts = export.export("SQL", "w", SHAPE, [r for r in CELLS if r[0] != 3])
    assert "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/sql/create", wholetext=True).collect()).strip() == create.strip()
    assert sorted(r[0] + "\n" for r in spark.read.text(f"{tmp_path}/sql/rows").collect()) == sorted(inserts)


CSV = 'some notes\nID;name;age;ok\r\n1;"Ana; B";22;true\n\n2;Bruno;;FALSE;extra\n3\n4;null;x;\n'
COLUMNS = (m.Column("name", "STRING"), m.Column("id", "INT", True, False), m.Column("age", "DOUBLE"), m.Column("ok", "BOOLEAN"))


def test_csv_tables(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(CSV)
    spec = m.CsvTable("t", str(path), COLUMNS, ";", '"', 2)
    assert rows(spark, table(spec, "t")) == [(1, "Ana; B", 22.0, True), (2, "Bruno", None, False), (3, None, None, None), (4, None, None, None)]
    filled = rows(spark, table(spec, "t"), options=Options(csv_nulls="sentinel"))
    assert filled[1] == (2, "Bruno", 5e-324, False) and filled[3][1] == ""
    assert rows(spark, where(table(spec, "t"), cmp("t.id", ">=", 2), cmp("t.name", "=", "Bruno")), "t.id") == [(2,)]
    assert rows(spark, op(m.LimitNode(1, 1), table(spec, "t")), "t.id") == [(2,)]
    with pytest.raises(PlanError, match="not found"):
        rows(spark, table(m.CsvTable("t", str(path), (m.Column("zip", "INT"),), ";", '"', 2), "t"))
    with pytest.raises(PlanError, match="can't be read"):
        rows(spark, table(m.CsvTable("t", str(tmp_path / "none.csv"), COLUMNS), "t"))
    (tmp_path / "head.csv").write_text("id,name\n")
    with pytest.raises(PlanError, match="no line"):
        rows(spark, table(m.CsvTable("t", str(tmp_path / "head.csv"), COLUMNS), "t"))


XML = """<?xml version="1.0"?><!-- <x/> --><people><note>n</note>
<person id="1"><name>Ana</name><addr kind="home"><zip>01</zip></addr><tag>a</tag><tag>b</tag></person>
<person id="2"><name>Bruno</name><age>17</age></person></people>"""


def test_xml_tables(spark, tmp_path):
    path = tmp_path / "t.xml"
    path.write_text(XML)
    columns = (m.Column("@id", "INT"), m.Column("name", "STRING"), m.Column("age", "INT"), m.Column("addr.zip", "STRING"), m.Column("addr.@kind", "STRING"), m.Column("tag", "STRING"), m.Column("no", "INT"))
    spec = m.XmlTable("t", str(path), columns)
    assert xml_table.record_element(spark, str(path)) == "person"
    assert rows(spark, table(spec, "t")) == [(1, "Ana", None, "01", "home", "b", None), (2, "Bruno", 17, None, None, None, None)]
    assert rows(spark, where(table(spec, "t"), cmp("t.name", "=", "Ana")), "t.addr.zip") == [("01",)]
    split = m.XmlTable("t", str(path), (m.Column("parent_id", "STRING"), m.Column("value", "STRING")), None, "SEPARATE_TABLE:person:tag")
    assert rows(spark, table(split, "t")) == [("1", "a"), ("1", "b")]
    assert xml_table.json_columns(spark, str(path), "person").select("addr").first()[0] == '{"@kind":"home","zip":"01"}'
    (tmp_path / "d.xml").write_text('<!DOCTYPE x><a><b/></a>')
    with pytest.raises(PlanError, match="DOCTYPE"):
        rows(spark, table(m.XmlTable("t", str(tmp_path / "d.xml"), columns), "t"))


def test_btree_tables_are_clustered(spark, tmp_path):
    path = str(tmp_path / "nums")
    tables.write_btree(spark.range(3000).selectExpr("cast(3000 - id as int) as id", "cast(id % 7 as int) as v"), path, ["id"], 3)
    q = table(m.BTreeTable("nums", path), "n")
    assert rows(spark, op(m.LimitNode(2), q), "n.id") == [(1,), (2,)] and rows(spark, where(q, cmp("n.id", "=", 77)), "n.v") == [((3000 - 77) % 7,)]
    assert Runner(spark).spark and Compiler(spark).compile(q).fields[0].primary_key


def test_sniffing(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    guess = sniff.sniff_csv(spark, file("a.csv", 'id,name,,id\n1,"a, b",2.5,x\n2,c,3,y\n'))
    assert guess.columns == ("id", "name", "column", "id_1") and guess.separator == "," and guess.samples[0] == ("1", "a, b", "2.5", "x") and guess.types == ("INT", "STRING", "DOUBLE", "STRING")
    assert sniff.sniff_csv(spark, file("b.csv", "a;b\n1;true\n")).separator == ";" and sniff.sniff_csv(spark, file("c.csv", "n\nx\ta|b\ty\n1\t2\t3\n"), 2).separator == "\t"
    assert sniff.sniff_csv(spark, str(tmp_path / "none")) == sniff.Guess()
    xml = sniff.sniff_xml(spark, file("x.xml", XML))
    assert xml.record_element == "person" and dict(zip(xml.columns, xml.types))["age"] == "INT" and "addr.@kind" in xml.columns and dict(zip(xml.columns, xml.types))["name"] == "STRING"
    assert sniff.sniff_xml(spark, file("y.xml", "no xml")) == sniff.Guess() and [c.type for c in sniff.columns_of(guess)] == list(guess.types)
