"""Workbooks and Word documents as streams: empty sheets, ranges, containers of text."""

import tracemalloc
from io import BytesIO
from zipfile import ZIP_DEFLATED, ZipFile

import pytest

from docloom.operators import fixes, grids
from docloom.operators import graph as g
from docloom.operators.domains import adr_rules, rfc_rules
from docloom.sources import connector, ooxml, tables

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(sheets, shared=""):
    out = BytesIO()
    with ZipFile(out, "w", ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {MAIN} {REL}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{shared}</sst>")
    return out.getvalue()


ROWS = '<row r="2"><c r="B2"><v>1.5</v></c><c r="C2" t="s"><v>1</v></c></row><row><c t="b"><v>1</v></c><c><v>7.0</v></c></row>'
SHARED = "<si><t>first</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>aside</t></rPh></si>"


@pytest.fixture()
def book(tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook({"Empty": "", "Full": ROWS, "Last": ""}, SHARED))
    return str(tmp_path / "b.xlsx")


def test_empty_sheets_and_the_default_sheet(spark, book):
    cells = tables.read_workbooks(spark, book)
    assert sorted(tuple(r)[1:] for r in tables.list_sheets(cells).collect()) == [(0, "Empty"), (1, "Full"), (2, "Last")]
    assert tables.sheet(cells).where("r is not null").count() == 0
    rows = tables.read_table(spark, book, sheet_name="Full").orderBy("r")
    assert [r.cells for r in rows.collect()] == [["", "", ""], ["", "1.5", "rich"], ["TRUE", "7", ""]]
    assert tables.read_table(spark, book).count() == 0


def test_the_source_reads_sheets_ranges_and_uris(spark, book, tmp_path):
    connector.register(spark)
    load = lambda path, **o: [(r.sheet, r.r, r.cells) for r in spark.read.format("docloom_table").options(path=path, **o).load().orderBy("r").collect()]
    assert load(book) == []
    assert load("file:" + book, sheet="Full") == [("Full", 0, ["", "", ""]), ("Full", 1, ["", "1.5", "rich"]), ("Full", 2, ["TRUE", "7", ""])]
    assert load(f"file://{tmp_path}/*.xlsx", sheet="Full", range="B2:C4") == [("Full", 1, ["1.5", "rich"]), ("Full", 2, ["7", ""]), ("Full", 3, ["", ""])]
    assert load(book, sheet="Full", range="3:3") == [("Full", 2, ["TRUE", "7", ""])]
    with pytest.raises(Exception, match="no sheet"):
        load(book, sheet="None")
    long = "x" * 200_000
    (tmp_path / "t.csv").write_text(f'a,"{long}"\nb,c\n')
    assert load(f"file:{tmp_path}/t.csv") == [("default", 0, ["a", long]), ("default", 1, ["b", "c"])]
    (tmp_path / "t.csv").write_text("a,b\nc\n")
    with pytest.raises(Exception, match="row 1 has 1 cells"):
        load(f"{tmp_path}/t.csv")
    assert load(f"{tmp_path}/t.csv", flexible="true") == [("default", 0, ["a", "b"]), ("default", 1, ["c"])]


def test_paths_that_only_spark_opens(spark, book, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.docs.link./in", f"file://{tmp_path}")
    got = tables.read_table(spark, "viewfs://docs/in/b.xlsx", "B2:B3", sheet_name="Full").orderBy("r").collect()
    assert [r.cells for r in got] == [["1.5"], ["7"]]
    (tmp_path / "t.csv").write_text('a,"b\nc"\nd,e\n')
    assert [r.cells for r in tables.read_table(spark, "viewfs://docs/in/t.csv").orderBy("r").collect()] == [["a", "b\nc"], ["d", "e"]]


def test_memory_does_not_grow_with_rows():
    def peak(n):
        data = workbook({"S": "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t>{"v" * 50}</t></is></c></row>' for i in range(1, n))})
        tracemalloc.start()
        try:
            assert sum(1 for _ in tables._cells(data)) == n
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    peak(10)
    assert peak(40_000) < 2 * peak(4_000)


def test_a_range_stops_the_parser():
    with ZipFile(BytesIO(workbook({"S": '<row r="1"><c><v>1</v></c></row><row r="2"><c><v>2</v></c></row><row r="3"><c><v>3</v></c></row></broken>'}))) as z:
        assert [c[2] for c in tables.sheet_cells(z, "xl/worksheets/s0.xml", [], last=1)] == ["1", "2"]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def word(spark, body):
    out = BytesIO()
    with ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document {W} xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:wps="urn:s" xmlns:v="urn:v"><w:body>{body}</w:body></w:document>')
    found = ooxml.word_blocks(spark.createDataFrame([("d", out.getvalue())], "uri string, content binary")).orderBy("idx").collect()
    return [(b.kind, "".join(r.text for r in b.runs) if b.rows is None else b.rows) for b in found], found


def test_text_in_containers(spark):
    run = lambda t, props="": f"<w:r>{props}<w:t>{t}</w:t></w:r>"
    body = (
        f"<w:p>{run('one')}</w:p><w:sdt><w:sdtContent><w:p>{run('boxed')}</w:p></w:sdtContent></w:sdt>"
        f"<w:p><w:ins>{run('inserted ')}</w:ins><w:del><w:r><w:t>gone</w:t></w:r></w:del>{run('kept', '<w:rPr><w:b/><w:rPrChange><w:rPr><w:i/></w:rPr></w:rPrChange></w:rPr>')}</w:p>"
        f"<w:bookmarkStart w:name='between'/><w:p><w:pPr><w:sectPr/></w:pPr><w:r><w:pict><v:shape><v:textbox><w:txbxContent><w:p>{run('in a box')}</w:p><w:tbl><w:tr><w:tc><w:p>{run('cell of a box')}</w:p></w:tc></w:tr></w:tbl></w:txbxContent></v:textbox></v:shape></w:pict></w:r>{run('host')}</w:p>"
        f"<w:p><w:r><mc:AlternateContent><mc:Fallback><w:t>only way</w:t></mc:Fallback></mc:AlternateContent><w:tab/><w:br/></w:r></w:p><w:tbl><w:tr/></w:tbl><w:p/>"
    )
    blocks, rows = word(spark, body)
    assert blocks == [("paragraph", "one"), ("paragraph", "boxed"), ("paragraph", "inserted kept"), ("paragraph", "host"), ("section_break", ""), ("paragraph", "in a box"), ("table", [["cell of a box"]]), ("paragraph", "only way\t\n"), ("table", [[]]), ("paragraph", "")]
    assert [(r.text, r.bold, r.italic) for r in rows[2].runs] == [("inserted ", False, False), ("kept", True, False)] and rows[3].bookmarks == ["between"]


def test_severities_and_odd_names(spark):
    docs = spark.createDataFrame([("a", 1, "[[old]]\n= ADR 1\n:status: Odd\n\n<<old,x>>"), ("r", 2, "= RFC 2\n:category: none\n")], "uri string, load_ord long, text string")
    ws = g.Workspace(docs)
    for rule in (adr_rules, rfc_rules):
        assert {r.severity for r in rule(ws, "error").collect()} == {"error"} and {r.severity for r in rule(ws).collect()} == {"warning"}
    lines = sorted(r.new_line for r in fixes.rename_edits(ws, "old", r"n$1\w").collect())
    assert lines == [r"<<n$1\w,x>>", r"[[n$1\w]]"] and grids
