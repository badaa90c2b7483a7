"""What is asked of one document alone is told by its own row: as from relations, without a shuffle."""

from pyspark.sql import functions as F

from docloom.operators import blocks, diagrams, domains, editor, fixes, outline, plugins, slides
from docloom.operators import graph as g
from docloom.plans import packages
from docloom.sources import ooxml

TEXTS = [
    "= T\n:description: d\n:a: 1\n\n=== Early\ntext\n=== Second\n* a\n== Main\n:icons: x\np\n=== Sub\n==== Deep\nq\n=== Last\nr\n",
    "== One\n\n|===\n|a |b\n|c\n\n|d\n|===\n\n[source,sql]\n----\nx\n\ny\n----\n\n. n\n.. m\n* u\n\nimage::p.png[alt, width=1]\ninclude::q\n",
    "=== Only\nx\n==== Deep\n",
    "= Title only\n",
    "plain: \n:odd:\n:\n----\nunclosed",
    "",
    None,
    "[mermaid]\n----\ngraph\na(b\nc[d(e\n----\n[plantuml]\n----\nA \"\n----\n[mermaid]\n----\n----\n[mermaid]\n----\nodd (\n",
    "= ADR 1\n:status: Draft\n\n==  CONTEXT \n\n=== Decisions\n\nx\n  \n\n",
    "= ADR 2\n",
    "==== Third\nx\n==== Fourth\ny\n== Main\n",
]


def docs_of(spark):
    return spark.createDataFrame([(f"u{i}", i, t) for i, t in enumerate(TEXTS)], "uri string, load_ord long, text string")


def rows(df):
    return sorted(map(str, df.collect()))


def moves(df) -> bool:
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_documents_hold_their_blocks_and_headers(spark):
    docs = docs_of(spark)
    for strict in (True, False):
        own = blocks.documents(docs, strict)
        assert rows(own.select("uri", F.inline("blocks"))) == rows(blocks.blocks(docs, strict)) and not moves(own)
        assert rows(own.select("uri", "title", "attributes")) == rows(blocks.document_headers(docs))
    full = own.where(F.size("blocks") > 0)
    assert rows(full.select("uri", blocks.generated(F.col("blocks")).alias("text"))) == rows(blocks.generate(blocks.blocks(docs, False)))
    assert blocks.documents(docs, keep=("load_ord",)).columns == ["uri", "load_ord", "title", "attributes", "blocks"]


def test_slides_of_a_row(spark):
    docs = docs_of(spark)
    made = slides.slides_within(blocks.documents(docs, False))
    assert rows(made.select("uri", "number", "layout_hint", "title", "subtitle", "content")) == rows(slides.slides(blocks.blocks(docs, False), blocks.document_headers(docs)))
    assert not moves(made) and made.count() == 15


def test_editor_diagnostics_of_a_row(spark):
    docs = docs_of(spark)
    heads = blocks.blocks(docs).where("kind = 'heading'").withColumn("idx", F.col("ln"))
    jumps = outline.jumps_within(blocks.documents(docs))
    assert rows(jumps) == rows(outline.heading_jumps(heads)) and jumps.count() == 3
    found = editor.diagnostics(g.Workspace(docs))
    assert found._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") == 2 and not moves(found)
    got = sorted((r.code, r.ln, r.end_col) for r in diagrams.lint(g.Workspace(docs)).collect())
    assert got == [("DIAGRAM001", 10, 10), ("DIAGRAM002", 14, 3), ("DIAGRAM003", 2, 3), ("DIAGRAM003", 3, 5), ("DIAGRAM003", 3, 5), ("DIAGRAM003", 14, 5), ("DIAGRAM004", 7, 10), ("DIAGRAM005", 8, 10), ("DIAGRAM006", 7, 3)]


def test_a_pattern_is_one_step_of_a_rule(spark):
    docs = spark.createDataFrame([("u", "A " * 50 + "\n\nIt had been so.\n\nNone.")], "uri string, text string")
    got = plugins.run(docs, {"voice": plugins.no_passive_voice}, steps=40).collect()
    assert [(r.code, r.context) for r in got] == [("STYLE001", "It had been so.")]
    assert [plugins.has_passive_pattern(x) for x in ("IT WAS x", "wash", "was", "beings", "been.")] == [True, False, False, False, False]


def test_missing_sections_of_a_row(spark):
    ws = g.Workspace(docs_of(spark))
    assert sorted((r.uri, r.section, r["rank"], r.ln) for r in domains.old_missing(ws).collect()) == [("u8", "Consequences", 2, 8), ("u8", "Decision", 1, 8), ("u9", "Consequences", 2, 1), ("u9", "Context", 0, 1), ("u9", "Decision", 1, 1)]
    edits = fixes.section_inserts(ws)
    assert not moves(edits) and edits.count() == 7
    every = edits.where("preferred and uri = 'u8'").first()
    assert every.new_text.index("Decision") < every.new_text.index("Consequences") and every.ln == 8


def test_anchors_from_one_reading(spark):
    run = lambda text: f"<w:r><w:t>{text}</w:t></w:r>"
    para = lambda style, inner: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{inner}</w:p>'
    mark = lambda name: f'<w:bookmarkStart w:name="{name}"/>'
    body = para("N", mark("_Ref0")) + para("H", mark("_Toc1") + run("1. One") + run(" a")) + para("Heading9", mark("mine") + run("no style of that name")) + para("heading2", run("Two") + mark("_Hlk2") + mark("_Toc3")) + f"<w:tbl><w:tr><w:tc><w:p>{mark('cell')}{run('x')}</w:p></w:tc></w:tr></w:tbl>"
    styles = '<w:style w:styleId="H"><w:pPr><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="heading2"/><w:style w:styleId="N"/>'
    content = {"word/document.xml": f"<w:document {packages.NS}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {packages.NS}>{styles}</w:styles>"}
    files = spark.createDataFrame([("a", packages._zipped(content)), ("b", packages._zipped({k: v for k, v in content.items() if "styles" not in k})), ("c", b"no archive"), ("d", None)], "uri string, content binary")
    found = ooxml.anchors_of(files)
    assert rows(found) == rows(ooxml.anchors(ooxml.word_blocks(files), ooxml.styles(files))) and not moves(found)
    assert [r.target_heading for r in found.where("uri = 'a' and bookmark in ('mine', 'cell')").orderBy("bookmark").collect()] == ["Two", "1. One a"]


def test_tracing_begins_once_for_many_documents(monkeypatch):
    import sys

    import pytest

    def endless(doc):
        while True:
            pass

    own, calls = sys.settrace, []
    before = sys.gettrace()
    limits = plugins.Limits(100, 5.0)
    monkeypatch.setattr(sys, "settrace", lambda f: (calls.append(f), own(f)))
    with limits.within():
        found = [limits.results("r", lambda doc: [doc["n"]], {"n": n}) for n in range(5)]
        assert len(calls) == 1
        for _ in range(2):
            with pytest.raises(plugins.RuleError, match="r: more than 100 steps"):
                limits.results("r", endless, {})
    assert found == [[n] for n in range(5)] and sys.gettrace() == before
