"""Readers on files made here."""

from io import BytesIO
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from docloom.operators import blocks, grids, slides
from docloom.operators import lines as ln
from docloom.sources import ooxml, ranges, tables

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook(path, sheets):
    """Sheets of {name: [[value, ...], ...]}; texts are shared strings."""
    shared = []
    with ZipFile(path, "w") as z:
        rels, names = "", ""
        for i, (name, rows) in enumerate(sheets.items(), 1):
            cells = ""
            for r, row in enumerate(rows, 1):
                cells += f'<row r="{r}">'
                for c, v in enumerate(row):
                    ref = f"{ranges.column_letters(c)}{r}"
                    if isinstance(v, bool):
                        cells += f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
                    elif isinstance(v, (int, float)):
                        cells += f'<c r="{ref}"><v>{v}</v></c>'
                    elif v is not None:
                        shared.append(v)
                        cells += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                cells += "</row>"
            z.writestr(f"xl/worksheets/sheet{i}.xml", SHEET.format(cells))
            rels += f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>'
            names += f'<sheet name="{name}" r:id="rId{i}"/>'
        z.writestr("xl/workbook.xml", f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")


def grid(df):
    return [list(r.cells) for r in sorted(df.collect(), key=lambda r: r.r)]


DATA = {"Stock": [["Item", "Count", "Weight"], ["bolt", 7, 2.25], ["nut", 12, 4], [None, True]], "Summary": [["x"]]}


def test_workbook(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    workbook(path, DATA)
    cells = tables.formatted(tables.sheet(tables.read_workbooks(spark, path)))
    assert grid(grids.assembled(tables.read_range(cells, "A1:C4"))) == [["Item", "Count", "Weight"], ["bolt", "7", "2.25"], ["nut", "12", "4"], ["", "TRUE", ""]]
    assert grid(grids.assembled(tables.read_range(cells, "B:C", strict=False)))[1] == ["7", "2.25"]
    assert grid(tables.read_table(spark, path, "2:3")) == [["bolt", "7", "2.25"], ["nut", "12", "4"]]
    assert grid(tables.read_table(spark, path, sheet_name="Summary")) == [["x"]]
    assert tables.read_range(cells, "C1:A1").count() == 0
    with pytest.raises(ranges.InvalidRange):
        tables.read_range(cells, "A:C")


def test_serial_dates_of_a_workbook(spark, tmp_path):
    path = str(tmp_path / "d.xlsx")
    workbook(path, {"s": [[44927, 0.5, "x"]]})
    cells = tables.formatted(tables.read_workbooks(spark, path), dates=True)
    assert {r.c: r.v for r in cells.collect()} == {0: "2023-01-01", 1: "0.5", 2: "x"}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Item,Count\n"bolt, long", 3\nnut,\n')
    rows = tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert grid(rows) == [["Item", "Count"], ["bolt, long", " 3"], ["nut", ""]]
    assert grid(tables.read_csv(spark, str(tmp_path / "a.csv"), tables.CsvOptions(trim=True)))[1] == ["bolt, long", "3"]
    assert grid(tables.csv_range(rows, "2:99")) == [["bolt, long", " 3"], ["nut", ""]] and grid(tables.csv_range(rows, "1")) == [["Item", "Count"]] and grid(tables.csv_range(rows, "9:10")) == []
    assert grid(grids.projected(rows, [1, 5]))[0] == ["Count", ""]
    assert tuple(tables.counts(rows).first())[1:] == (3, 2)
    (tmp_path / "b.tsv").write_text("a\tb\n1\t2\n")
    assert grid(tables.read_table(spark, str(tmp_path / "b.tsv"))) == [["a", "b"], ["1", "2"]]
    (tmp_path / "c.csv").write_text("a,b\n1\n")
    with pytest.raises(tables.RaggedRows):
        tables.read_csv(spark, str(tmp_path / "c.csv"))
    ragged = tables.read_csv(spark, str(tmp_path / "c.csv"), tables.CsvOptions(flexible=True))
    assert grid(grids.padded(ragged)) == [["a", "b"], ["1", ""]]


def test_includes(spark, tmp_path):
    workbook(str(tmp_path / "data.xlsx"), DATA)
    (tmp_path / "report.csv").write_text("a;b\n1;2\n")
    text = "include::data.xlsx[sheet=Stock,range=A1:B2,header]\ninclude::report.csv[header,delimiter=;]\ninclude::chapter.adoc[]\ninclude::gone.csv[]\nno include::x[]"
    found = tables.includes(ln.lines(spark.createDataFrame([("u", 0, text)], "uri string, load_ord long, text string")))
    got = sorted(found.collect(), key=lambda r: r.ln)
    assert [(r.path, r.sheet, r.range, r.header, r.delimiter, r.is_data) for r in got] == [("data.xlsx", "Stock", "A1:B2", True, None, True), ("report.csv", None, None, True, ";", True), ("chapter.adoc", None, None, False, None, False), ("gone.csv", None, None, False, None, True)]
    rows = sorted(tables.resolve_includes(spark, found, str(tmp_path)).collect(), key=lambda r: (r.ln, r.r))
    assert [(r.ln, r.cells, r.is_header) for r in rows if not r.problem] == [(0, ["Item", "Count"], True), (0, ["bolt", "7"], False), (1, ["a", "b"], True), (1, ["1", "2"], False)]
    assert [r.ln for r in rows if r.problem] == [3]


def test_workspace(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.adoc").write_text("é")
    (tmp_path / "sub" / "a.adoc").write_text("x")
    (tmp_path / "0.asciidoc").write_text("y")
    (tmp_path / "no.txt").write_text("z")
    got = sorted(tables.read_workspace(spark, str(tmp_path)).collect(), key=lambda r: r.load_ord)
    assert [(r.uri.rsplit("/", 1)[1], r.text) for r in got] == [("b.adoc", "é"), ("a.adoc", "x"), ("0.asciidoc", "y")]
    assert got[0].uri.startswith("file:///")


WNS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def run(text, fmt=""):
    return f"<w:r><w:rPr>{fmt}</w:rPr><w:t>{text}</w:t></w:r>"


def word(spark):
    mono = '<w:rFonts w:ascii="Courier New"/>'
    body = (
        f'<w:p><w:pPr><w:pStyle w:val="Titolo1"/></w:pPr><w:bookmarkStart w:name="_Toc1"/>{run("1. Purpose")}</w:p>'
        f'<w:p><w:bookmarkStart w:name="mine"/><w:bookmarkStart w:name="_Hlk9"/>{run("a ")}{run("b", "<w:b/>")}{run("c", "<w:b/>")}{run("d", "<w:b/><w:i/>")}<w:hyperlink r:id="rId5">{run("site")}</w:hyperlink><w:hyperlink w:anchor="x">{run("here")}</w:hyperlink></w:p>'
        f'<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>{run("one")}</w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="2"/></w:numPr></w:pPr>{run("two")}</w:p>'
        f"<w:tbl><w:tr><w:tc><w:p>{run('h')}</w:p></w:tc><w:tc><w:p>{run('i')}</w:p></w:tc></w:tr></w:tbl>"
        f'<w:p><w:commentRangeStart w:id="7"/><w:r><w:rPr>{mono}</w:rPr><w:t>let x</w:t><w:br/><w:t>= 1</w:t></w:r></w:p><w:p/>'
    )
    out = BytesIO()
    with ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {WNS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {WNS}><w:style w:type="paragraph" w:styleId="Titolo1"><w:name w:val="heading 1"/><w:basedOn w:val="Normale"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:type="paragraph" w:default="1" w:styleId="Normale"><w:name w:val="Normal"/></w:style><w:style w:type="table" w:styleId="Grid"><w:name w:val="Table Grid"/></w:style></w:styles>')
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId5" Type="x/hyperlink" Target="http://a.b" TargetMode="External"/><Relationship Id="rId11" Type="x/styles" Target="styles.xml"/></Relationships>')
        z.writestr("word/comments.xml", f'<w:comments {WNS}><w:comment w:id="7"><w:p>{run("Language: rust")}</w:p></w:comment></w:comments>')
        z.writestr("docProps/core.xml", "<p><title>Doc</title><creator>Me</creator><modified>2024-05-06T01:02:03Z</modified></p>")
        z.writestr("kept/source.adoc", "= Source")
    return spark.createDataFrame([("d", out.getvalue()), ("bad", b"no archive")], "uri string, content binary")


def test_word_document(spark):
    files = word(spark)
    found, sheet, rels = ooxml.word_blocks(files), ooxml.styles(files), ooxml.relationships(files)
    text = ooxml.to_asciidoc(found, sheet, rels, ooxml.comments(files), ooxml.core_properties(files)).first()["text"]
    assert text == '= Doc\n:author: Me\n:revdate: 2024-05-06\n\n== 1. Purpose\n\na *bc**_d_*link:http://a.b[site]link:#x[here]\n\n* one\n.. two\n\n[options="header"]\n|===\n|h |i\n|===\n\n[source,rust]\n----\nlet x\n= 1\n----'
    assert sorted((r.bookmark, r.semantic_id, r.anchor_type, r.target_heading) for r in ooxml.anchors(found, sheet).collect()) == [("_Toc1", "purpose", "toc", "1. Purpose"), ("mine", "purpose", "user", "1. Purpose")]
    assert sorted((r.link_id, r.is_external, r.url, r.anchor_target) for r in ooxml.hyperlinks(found, rels).collect()) == [("link1", True, "http://a.b", None), ("link2", False, None, "x")]
    assert {r.element: r.style_id for r in ooxml.style_map(sheet).collect()} == {"heading1": "Titolo1", "paragraph": "Normale", "table": "Grid", "list_bullet": "ListBullet", "list_number": "ListNumber", "code_block": "Normal", "table_header": "TableGrid", "admonition": "Normal"}
    assert ooxml.next_relationship_id(rels).first()["rid"] == "rId12"
    kept = ooxml.embedded(ooxml.parts(files), "kept/")
    assert [(r.name, r.text) for r in kept.collect()] == [("source.adoc", "= Source")]
    assert ooxml.drifted(kept, kept.withColumn("hash", F.lit("other"))).count() == 1 and ooxml.drifted(kept, kept).count() == 0


def test_presentation_template(spark):
    out = BytesIO()
    ns = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    with ZipFile(out, "w") as z:
        z.writestr("ppt/slideLayouts/slideLayout1.xml", f'<p:sldLayout {ns}><p:cSld name="Any"><p:ph type="ctrTitle"/></p:cSld></p:sldLayout>')
        z.writestr("ppt/slideLayouts/slideLayout2.xml", f'<p:sldLayout {ns}><p:cSld name="Titolo e contenuto"/></p:sldLayout>')
        z.writestr("ppt/slideLayouts/slideLayout3.xml", f'<p:sldLayout {ns}><p:cSld name="Picture with Caption"/></p:sldLayout>')
    files = spark.createDataFrame([("t", out.getvalue())], "uri string, content binary")
    assert [(r.layout_index, r.layout) for r in sorted(ooxml.slide_layouts(files).collect(), key=lambda r: r.layout_index)] == [(1, "title"), (2, "title"), (3, "image")]
    assert tuple(ooxml.slide_size(files).first())[1:] == (9144000, 6858000)
    rows = spark.createDataFrame([("t", "image"), ("t", "quote")], "uri string, layout_hint string")
    assert {r.layout_hint: r.layout_index for r in ooxml.layout_for(rows, ooxml.slide_layouts(files)).collect()} == {"image": 3, "quote": 1}


def test_slides(spark):
    text = "= Deck\n:subtitle: Sub\n\nlost\n\n== Part\n\n=== One\n\ntext\n\n* a\n\n==== Its subtitle\n\n===== deep\n\n=== Two\n"
    docs = spark.createDataFrame([("u", text)], "uri string, text string")
    got = sorted(slides.slides(blocks.blocks(docs), blocks.document_headers(docs)).collect(), key=lambda r: r.number)
    assert [(r.number, r.layout_hint, r.title, r.subtitle, [tuple(c) for c in r.content]) for r in got] == [
        (1, "title", "Deck", "Sub", []), (2, "section", "Part", None, []), (3, "content", "One", "Its subtitle", [("paragraph", "text"), ("list_item", "a"), ("paragraph", "deep")]), (4, "content", "Two", None, []),
    ]
