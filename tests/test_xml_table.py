from tests.graphs import INT, m, rows, table
from weft.sources import xml_table


def test_the_record_element_is_counted_over_the_whole_file(spark, tmp_path):
    path = tmp_path / "t.xml"
    authors = "".join(f"<author><id>{i}</id><name>a name that is not very short</name></author>\n" for i in range(25_000))
    articles = "".join(f"<article>\n<id>{i}</id></article>\n" for i in range(30_000))
    path.write_text(f"<all>\n{authors}{articles}</all>\n")
    assert len(authors) > 1 << 20
    assert xml_table.record_element(spark, str(path)) == "article"
    assert len(rows(spark, table(m.XmlTable("t", str(path), (m.Column("id", INT),)), "t"))) == 30_000


def test_one_line_and_several_files(spark, tmp_path):
    (tmp_path / "one.xml").write_text("<all>" + "<author/>" * 130_000 + "<article/>" * 140_000 + "</all>")
    assert xml_table.record_element(spark, str(tmp_path / "one.xml")) == "article"
    (tmp_path / "many").mkdir()
    for k, body in enumerate(["<all><a/>\n<b>", "<a/><a/></b>\n<b/>", "<b/></all>"]):
        (tmp_path / "many" / f"part {k}").write_text(body)
    assert xml_table.record_element(spark, str(tmp_path / "many")) == "b"


def test_tags_over_pieces():
    text = """<?xml v="<a>"?><r><!-- <x> --><a k="1>2" l='"'/><![CDATA[<y>]] ><z>]]]><b\n m="3"\n>t</b></r>"""
    want = [("", "r"), ("", "a"), ("", "b"), ("/", "b"), ("/", "r")]
    for n in range(1, len(text) + 1):
        assert [t[:2] for t in xml_table.tags(text[i : i + n] for i in range(0, len(text), n))] == want, n
    assert [t[3] for t in xml_table.tags([text])] == ["", "/", "", "", ""]
