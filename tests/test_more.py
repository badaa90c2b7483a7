"""Settings, editor sessions, packages, records and reports on small literals."""

import json
from io import BytesIO
from zipfile import ZipFile

import pytest
from pyspark.sql import functions as F

from docloom import settings
from docloom.functions import text as fx
from docloom.operators import domains, dual, editor, fixes, grids, outline, plugins, prose, reports, rules
from docloom.operators import graph as g
from docloom.sources import connector, ooxml, tables
from docloom.sources.ranges import RangeSpec


def ws(spark, **docs):
    return g.Workspace(spark.createDataFrame([(f"file:///{n}.adoc", i, t) for i, (n, t) in enumerate(docs.items())], "uri string, load_ord long, text string"))


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


# headings of any level, brackets of any depth, long chains


def test_deep_headings(spark):
    rows = spark.createDataFrame([("u", 1, 9), ("u", 2, 9), ("u", 3, 10), ("u", 4, 40), ("u", 5, 9), ("v", 1, 2)], "uri string, idx int, level int")
    assert sorted((r.uri, r.idx, r.parent_idx) for r in outline.heading_tree(rows).collect()) == [("u", 1, None), ("u", 2, None), ("u", 3, 2), ("u", 4, 3), ("u", 5, None), ("v", 1, None)]
    assert sorted((r.uri, r.idx, r.next_idx) for r in outline.section_ends(rows).collect()) == [("u", 1, 2), ("u", 2, 5), ("u", 3, 5), ("u", 4, 5), ("u", 5, None), ("v", 1, None)]


def test_closing_delimiters_of_equal_and_longer_size(spark):
    lns = ws(spark, a="----\n------\n----\n------\n....\n----").lines
    assert sorted((r.ln, r.end_ln) for r in outline.closing_delimiters(lns).collect()) == [(0, 1), (1, 3), (2, 3)]


@pytest.mark.parametrize("text, want", [("a ((((((((x)))))))) b and more", "a b and more"), ("a " + "(" * 40 + "x" + ")" * 39 + " lost", "a"), (")) a (b) c ) d", "a c d"), ("((a) (((((((b))))))) c) d", "d"), ("plain", "plain")])
def test_brackets_of_any_depth(spark, text, want):
    assert one(spark, fx.without_parentheses(F.col("t")), t=text) == want


def test_syllables_and_words_are_counted_as_they_are_split(spark):
    for text in ("", "  ", "tsk hmm, a eau! Über ÿ 7", "one\u2003two\nthree", "x"):
        words = text.replace("\u2003", " ").split()
        import re

        assert one(spark, fx.word_count(F.col("t")), t=text) == len(words)
        assert one(spark, fx.syllables(F.col("t")), t=text) == sum(max(1, len(re.findall("[aeiouy]+", w.lower()))) for w in words)


def test_prose_summary_counts_per_line(spark):
    docs = spark.createDataFrame([(1, "It was opened\nand is closed. Very clearly, VERY.\r\nwas done"), (2, None)], "i int, text string")
    got = {r.i: r for r in prose.summary(docs, "i").collect()}
    assert (got[1].passive, got[1].weasel, got[1].words) == (1, 3, 11) and got[2].readability == 100.0


# records


def grid(df):
    return [list(r.cells) for r in sorted(df.collect(), key=lambda r: r.r)]


@pytest.mark.parametrize(
    "text, want",
    [
        ('k,v\n"x, ""y"", z",2\n', [["k", "v"], ['x, "y", z', "2"]]),
        ('a\n"A ""quoted"" value"\n', [["a"], ['A "quoted" value']]),
        ('a,b\n"one\n\ntwo, ""q""",2\n\n3,4', [["a", "b"], ['one\n\ntwo, "q"', "2"], ["3", "4"]]),
        ('a,b\n5" pipe,x\n"y"z,\n"",""\n', [["a", "b"], ['5" pipe', "x"], ["yz", ""], ["", ""]]),
        ('a,b\r\n"1","2"\r\n', [["a", "b"], ["1", "2"]]),
    ],
)
def test_csv_records(spark, tmp_path, text, want):
    (tmp_path / "a.csv").write_bytes(text.encode())
    (tmp_path / "b.csv").write_text("p,q\n1,2\n")
    assert grid(tables.read_csv(spark, str(tmp_path / "a.csv"))) == want
    both = tables.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert grid(both.where(F.col("table_id").endswith("a.csv"))) == want and grid(both.where(F.col("table_id").endswith("b.csv"))) == [["p", "q"], ["1", "2"]]


def test_dense_rows_reach_over_strides(spark, monkeypatch):
    monkeypatch.setattr(grids, "STRIDE", 2)
    cells = spark.createDataFrame([("t", 0, 1, "a"), ("t", 4, 3, "b"), ("t", 6, 0, "c")], "table_id string, r int, c int, v string")
    got = sorted(map(tuple, grids.dense(cells, RangeSpec("cells", 0, 5, 1, 3)).collect()))
    assert got == [("t", r, c, {(0, 1): "a", (4, 3): "b"}.get((r, c), "")) for r in range(6) for c in (1, 2, 3)]
    assert grids.dense(cells, RangeSpec("cells", 5, 2, 1, 3)).count() == 0


def test_table_source(spark, tmp_path):
    connector.register(spark)
    (tmp_path / "t.csv").write_text('a,b\n"x\ny",2\n3,4\n')
    load = lambda **o: spark.read.format("docloom_table").options(path=str(tmp_path / "t.csv"), **o).load()
    assert grid(load()) == [["a", "b"], ["x\ny", "2"], ["3", "4"]] and grid(load(range="2:2")) == [["x\ny", "2"]]
    with ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1"><v>1</v></c><c r="C2" t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>')
    got = spark.read.format("docloom_table").options(path=str(tmp_path / "w.xlsx"), range="A1:C2").load()
    assert grid(got) == [["1", "", ""], ["", "", "z"]]
    assert [tuple(r)[1:] for r in tables.list_sheets(tables.read_workbooks(spark, str(tmp_path / "w.xlsx"))).collect()] == [(0, "S")]


# settings


def test_settings(spark, tmp_path):
    assert settings.load(spark, folder=str(tmp_path)) == settings.Settings()
    (tmp_path / "docloom.toml").write_text("[compliance.bridge]\norphans = 3\n")
    (tmp_path / ".docloom.toml").write_text('[compliance.bridge]\norphans = "ignore"\n[plugins]\ndiagrams = false\ncustom_weasel_words = ["somewhat"]\nfuture = 1\n[workspace]\nroot = "docs"\n')
    own = settings.load(spark, folder=str(tmp_path))  # the first is passed over, as it is wrong
    assert own.bridge.orphans == "ignore" and own.bridge.superseded_status == "error" and own.workspace.root == "docs" and not own.plugins.diagrams
    with pytest.raises(settings.InvalidSettings):
        settings.load(spark, str(tmp_path / "docloom.toml"))
    with pytest.raises(FileNotFoundError):
        settings.load(spark, str(tmp_path / "gone.toml"))
    for bad in ("x = ", "compliance = 1", "[plugins]\ndiagrams = 'yes'", "[workspace]\nentry_points = 'a'"):
        with pytest.raises(settings.InvalidSettings):
            settings.from_toml(bad)


def test_settings_decide_what_is_checked(spark):
    w = ws(spark, index="x", a="= T\n\n=== Deep\nIt was opened. Somewhat.\n\n[mermaid]\n----\n----\n")
    assert sorted(r.code for r in editor.diagnostics(w).collect()) == ["DIAGRAM001", "DOC101", "QUALITY001"]
    own = settings.from_toml("[compliance.bridge]\norphans = 'ignore'\n[plugins]\ndiagrams = false\ncustom_weasel_words = ['somewhat', 'a.b']")
    session = editor.Session(w.docs).with_settings(own)
    assert sorted(r.code for r in session.diagnostics("file:///a.adoc").collect()) == ["DOC101", "QUALITY001", "QUALITY002"]
    assert session.diagnostics("file:///index.adoc").count() == 0
    assert rules.bridge(own).run(w).count() == 0 and rules.bridge().run(w).count() == 1
    assert editor.diagnostics(w, settings.from_toml("[plugins]\nwriting_quality = false\ndiagrams = false")).count() == 1


# editor


def test_places_of_diagnostics(spark):
    w = ws(spark, a="= T\n\npara\nmore\n\n== S\n\nlast one")
    rows = [("L", 3, 2, None, None, None), ("O", None, None, 5, 9, None), ("E", None, None, 5, 900, None), ("B0", None, None, None, None, 0), ("B3", None, None, None, None, 3), ("B9", None, None, None, None, 9), ("N", None, None, None, None, None)]
    found = spark.createDataFrame([("file:///a.adoc", c, "warning", "m", *r) for c, *r in rows], "uri string, code string, severity string, message string, line int, col int, start int, end int, block int")
    got = {r.code: (r.start_ln, r.start_col, r.end_ln, r.end_col) for r in editor.placed(found, w).collect()}
    assert got == {"L": (2, 1, 2, 2), "O": (2, 0, 2, 4), "E": (2, 0, 7, 8), "B0": (0, 0, 0, 3), "B3": (7, 0, 7, 8), "B9": (0, 0, 0, 0), "N": (0, 0, 0, 0)}


def test_cursor_targets(spark):
    line = "[[one]] <<two,label>> {use} <<two>>"
    lns = ws(spark, a=line + "\n  :name: value").lines
    cursors = spark.createDataFrame([("file:///a.adoc", 0, c) for c in range(len(line) + 1)] + [("file:///a.adoc", 1, c) for c in range(8)], "uri string, ln int, col int")
    got = {(r.ln, r.col): (r.kind, r.name, r.start, r.end) for r in editor.rename_targets(lns, cursors).collect()}
    want = {(0, c): ("section_id", "one", 2, 5) for c in range(2, 5)} | {(0, c): ("reference", "two", 10, 13) for c in range(10, 13)} | {(0, c): ("attribute_usage", "use", 23, 26) for c in range(23, 26)}
    want |= {(0, c): ("reference", "two", 30, 33) for c in range(30, 33)} | {(1, c): ("attribute", "name", 3, 7) for c in range(3, 7)}
    assert got == want
    inline = {(r.ln, r.col): (r.start, r.end) for r in editor.inline_at(lns, cursors).collect()}
    assert inline[(0, 8)] == (8, 21) and inline[(0, 11)] == (10, 13) and inline[(0, 22)] == (22, 27) and (0, 3) not in inline


def test_session(spark):
    w = ws(spark, a="= ADR 1\n:status: Odd\n\n== Context\n\n[[x-1]]\n== decision\n\n\n", b="[[x-2]] see <<x-1>>")
    s = editor.Session(w.docs)
    a = "file:///a.adoc"
    assert sorted(r.label for r in s.complete("file:///b.adoc", "see <<x-").collect()) == ["x-1", "x-2"]
    assert [r.label for r in s.complete(a, ":status: dep").collect()] == ["Deprecated"]
    assert {r.name for r in s.find_symbols("x-").collect()} == {"x-1", "x-2"} and {r.name for r in s.symbols(a).collect()} >= {"x-1", "decision"}
    assert s.folding(a).count() >= 1 and s.tokens(a).count() >= 4 and s.rename("x-1", "y").count() == 2
    assert s.selection(spark.createDataFrame([(a, 3)], "uri string, ln int")).count() >= 2
    assert [r.name for r in s.can_rename(spark.createDataFrame([(a, 5, 3)], "uri string, ln int, col int")).collect()] == ["x-1"]
    got = {r.title: (r.ln, r.new_text, r.preferred) for r in s.actions(a).collect()}
    assert got["Insert 'Consequences' section"] == (7, "\n== Consequences\n\n// TODO: Describes the resulting context, after applying the decision.\n", False)
    assert got["Change status to 'Draft'"] == (1, "Draft", True) and len(got) == 7
    both = fixes.section_inserts(ws(spark, a=":status: Draft\n== context\n")).where("preferred").first()
    assert both.title == "Insert all missing ADR sections" and both.new_text.index("Decision") < both.new_text.index("Consequences")


def test_domains_are_registered(spark):
    memo = domains.Domain("memo", lambda t: F.when(t.startswith("MEMO"), 0.9).otherwise(0.0), lambda ws: rules.diagnostics(ws.docs, "MEMO1", "info", F.lit("a memo")))
    own = domains.standard().register(memo)
    docs = ws(spark, a="MEMO to all", b="= RFC 7\n== Abstract", c="plain").docs
    assert {r.uri[-6]: r.domain for r in own.choose(docs).collect()} == {"a": "memo", "b": "rfc", "c": "generic"}
    assert own.get("memo") is memo and own.get("generic") is own.fallback and own.get("none") is None
    assert [r.code for r in own.validate(g.Workspace(docs)).collect()] == ["MEMO1"]
    bare = domains.Domains([], own.fallback)
    assert bare.choose(docs).where("domain <> 'generic'").count() == 0


def test_old_rules(spark):
    w = ws(spark, a="= ADR 2\n:status: Proposd\n\n==== CONTEXT\n= Decision\n", b=":status: New", c="plain")
    got = sorted((r.uri[-6], r.code, r.ln, r.subject) for r in domains.old_rules(w).collect())
    assert got == [("a", "ADR001", 5, "Consequences"), ("a", "DOM001", 1, "Proposd"), ("b", "DOM001", 0, "New")]


def test_slide_paths(spark):
    docs = spark.createDataFrame([("u", "= T\n:template: x\n\nimage::a.png[A,width=3]\n\nimage::b.png[B,width=3]")], "uri string, text string")
    found = dual.blocks(docs).withColumn("slide_path", F.when(F.col("path") == "a.png", "a.png").otherwise("small.png"))
    assert [(r.code, r.message) for r in dual.lint_blocks(found, dual.metadata(docs)).collect()] == [("DUAL003", "slide_path is same as path for image 'a.png'")]
    assert [r.path for r in dual.for_format(found, dual.metadata(docs), "slide").orderBy("idx").collect()] == ["a.png", "small.png"]


# packages


def test_eleven_layouts_and_a_theme(spark):
    out, ns = BytesIO(), 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    with ZipFile(out, "w") as z:
        for i in range(1, 12):
            z.writestr(f"ppt/slideLayouts/slideLayout{i}.xml", f'<p:sldLayout {ns}><p:cSld name="{"Picture" if i == 10 else "Two" if i == 2 else "Content"}"/></p:sldLayout>')
        z.writestr("ppt/slideLayouts/slideLayout0.xml", f'<p:sldLayout {ns}/>')
        z.writestr("ppt/theme/theme1.xml", '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" name="Plain"><a:majorFont><a:latin typeface="Head"/></a:majorFont></a:theme>')
    files = spark.createDataFrame([("t", out.getvalue())], "uri string, content binary")
    layouts = ooxml.slide_layouts(files)
    assert {r.layout_index: r.layout for r in layouts.collect()} == {i: "image" if i == 10 else "two_column" if i == 2 else "content" for i in range(1, 12)}
    rows = spark.createDataFrame([("t", "image"), ("t", "two_column")], "uri string, layout_hint string")
    assert {r.layout_hint: r.layout_index for r in ooxml.layout_for(rows, layouts).collect()} == {"image": 10, "two_column": 2}
    assert tuple(ooxml.themes(files).first()) == ("t", "Plain", "Head", "Calibri")


def test_relationships_are_added_and_written(spark):
    rels = spark.createDataFrame([("d", "rId2", "styles.xml", "styles", False), ("d", "rId10", "a&b.png", "image", False)], "uri string, rid string, target string, type string, external boolean")
    new = spark.createDataFrame([("d", 1, "http://x/<y>", "hyperlink"), ("d", 0, "#z", "hyperlink"), ("e", 0, "m.png", "image")], "uri string, pos int, target string, type string")
    got = ooxml.added_relationships(rels, new)
    assert sorted((r.uri, r.rid, r.external) for r in got.collect()) == [("d", "rId10", False), ("d", "rId11", False), ("d", "rId12", True), ("d", "rId2", False), ("e", "rId1", False)]
    out = BytesIO()
    with ZipFile(out, "w") as z:
        z.writestr("word/_rels/document.xml.rels", ooxml.relationships_xml(got).where("uri = 'd'").first()["xml"])
    back = ooxml.relationships(spark.createDataFrame([("d", out.getvalue())], "uri string, content binary"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, got.where("uri = 'd'").collect()))


def test_layout_and_placeholder_codes(spark):
    rows = spark.createDataFrame([(k, v) for k, v in ooxml.LAYOUT_TYPES.items()], "k string, v string")
    assert rows.where((ooxml.layout_code(F.col("k")) != F.col("v")) | (ooxml.layout_of_code(F.col("v")) != F.col("k"))).count() == 0
    assert one(spark, ooxml.layout_of_code(F.col("t")), t="title") == "title" and one(spark, ooxml.layout_of_code(F.col("t")), t="odd") == "custom" and one(spark, ooxml.layout_code(F.col("t")), t="custom") is None
    assert one(spark, ooxml.placeholder_code(F.col("t")), t="footer") == "ftr" and one(spark, ooxml.placeholder_of_code(F.col("t")), t="clipArt") == "other" and one(spark, ooxml.placeholder_code(F.col("t")), t="other") == ""


def test_manifests(spark):
    rows = spark.createDataFrame([("d", "f1", "figure", "a.mmd", "h", None), ("d", "t1", "table", None, None, "x")], "uri string, id string, type string, source string, hash string, description string")
    made = ooxml.manifests(rows, F.lit("2025-01-01T00:00:00Z"))
    assert json.loads(made.first()["json"]) == {"version": "1.0", "generator": "docloom", "generated_at": "2025-01-01T00:00:00Z", "elements": {"f1": {"type": "figure", "source": "a.mmd", "hash": "h"}, "t1": {"type": "table", "description": "x"}}}
    assert sorted(map(str, ooxml.read_manifests(made).collect())) == sorted(map(str, rows.collect()))
    assert ooxml.read_manifests(spark.createDataFrame([("d", "{"), ("e", "[]")], "uri string, json string")).count() == 0
    m = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    got = m.select(ooxml.with_element(F.col("m"), F.lit("b"), F.lit(2)).alias("b"), ooxml.with_element(F.col("m"), F.lit("a"), F.lit(3)).alias("a"), ooxml.without_element(F.col("m"), F.lit("a")).alias("n"), ooxml.element_of(F.col("m"), F.lit("z")).alias("z")).first()
    assert (got.b, got.a, got.n, got.z) == ({"a": 1, "b": 2}, {"a": 3}, {}, None)


# reports and stamps


def test_whole_reports(spark):
    w = ws(spark, index="<<gone>>", a="[[a]] x < y", b="z")
    found = rules.Registry().add("links", rules.broken_links).add("orphaned", rules.orphaned).run(w)
    score = rules.score(found, w.docs, 2)
    joined = lambda rows: "\n".join(r.text for r in sorted(rows.collect(), key=lambda r: r.section))
    got = json.loads(joined(reports.json_report(found, score, F.lit("2026-01-01T00:00:00Z"))))
    assert got["status"] == "passing_with_warnings" and got["summary"] == {"total_documents": 3, "errors": 0, "warnings": 3, "info": 0, "compliance_score": 0}
    assert sorted(v["code"] for v in got["violations"]) == ["BRIDGE003", "BRIDGE003", "WS001"]
    assert next(v for v in got["violations"] if v["code"] == "WS001")["location"] == {"uri": "file:///index.adoc", "range": {"start": {"line": 0, "character": 2}, "end": {"line": 0, "character": 6}}}
    page = joined(reports.html(found, score, {"WS001": "links & <ids>"}, F.lit("now")))
    assert page.startswith("<!DOCTYPE html>") and page.endswith("</html>") and "PASSING (with warnings)" in page and "links &amp; &lt;ids&gt;" in page and "index.adoc:1:3" in page and page.count('class="found"') == 3
    clean = rules.score(found.limit(0), w.docs, 2)
    assert json.loads(joined(reports.json_report(found.limit(0), clean, F.lit("t"))))["violations"] == []
    assert "All compliance checks passed!" in joined(reports.html(found.limit(0), clean))


def test_stamps(spark):
    assert [one(spark, fx.utc_stamp(F.col("s")), s=s) for s in (0, 951_782_399, 951_782_400, 4_102_444_800)] == ["1970-01-01T00:00:00Z", "2000-02-28T23:59:59Z", "2000-02-29T00:00:00Z", "2100-01-01T00:00:00Z"]


def test_stamps_beyond_9999(spark):
    assert [one(spark, fx.utc_stamp(F.col("s")), s=s) for s in (253_402_300_799, 253_402_300_800, 2_332_800_000_000)] == ["9999-12-31T23:59:59Z", "10000-01-01T00:00:00Z", "75893-06-28T00:00:00Z"]


def test_a_rule_may_have_many_results(spark):
    docs = spark.createDataFrame([("u", "= T")], "uri string, text string")
    assert plugins.run(docs, {"many": lambda doc: (str(i) for i in range(12_000))}).count() == 12_000
